"""The engine's front door: reflow, needs_format, explain and check over any table with a text column.

Plain rows never leave the JVM; for them the kernel's column is null, so that only other rows cost Python time. Nothing
here shuffles, and all of it works on streams.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainfold.functions import prose
from plainfold.functions.rules import REASONS
from plainfold.markdown import kernel
from plainfold.options import Options


def _kernel(options: Options):
    def run(text: pa.Array) -> pa.Array:
        return pa.array([kernel.reflow(t, options) for t in text.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def _named(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def reflow(df: DataFrame, column: str = "text", options: Options = Options()) -> DataFrame:
    """df with ``formatted``. Null text gives null; with a segmenter of one's own every row goes through the kernel."""
    if options.segmenter:
        return df.withColumn("formatted", _kernel(options)(_named(column).cast("string")))
    text, plain = _fresh(df, "_text"), _fresh(df, "_plain")
    df = df.withColumn(text, _named(column).cast("string")).withColumn(plain, prose.is_plain(F.col(text), options.dialect))  # once for both ways
    return df.withColumn("formatted", F.coalesce(F.when(F.col(plain), prose.reflowed(F.col(text), options)), _kernel(options)(F.when(~F.col(plain), F.col(text))))).drop(text, plain)


def needs_format(df: DataFrame, column: str = "text", options: Options = Options()) -> DataFrame:
    """df with ``formatted`` and ``needs_format``, which is false for a null text."""
    return reflow(df, column, options).withColumn("needs_format", ~F.col("formatted").eqNullSafe(_named(column)))


def explain(df: DataFrame, column: str = "text", options: Options = Options()) -> DataFrame:
    """A row for each paragraph that reflow leaves alone, with its reason and the words for it.

    Null and plain texts give none. The columns of df come first, whatever their names; of those named like the ones added
    (start_line, end_line, reason, detail, remediation) the added ones take the place."""

    def run(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start_line", pa.int64()), ("end_line", pa.int64()), ("reason", pa.string())]))
        return pa.array([[dict(zip(("start_line", "end_line", "reason"), x)) for x in kernel.explain(t, options)] for t in text.to_pylist()], kind)

    text, skip, added = _named(column).cast("string"), _fresh(df, "_skip"), ("start_line", "end_line", "reason")
    skips = F.arrow_udf(run, "array<struct<start_line:long,end_line:long,reason:string>>")(F.when(~prose.is_plain(text, options.dialect), text))
    kept = [_named(c) for c in df.columns if c.lower() not in (*added, "detail", "remediation")]
    out = df.withColumn(skip, F.explode(skips)).select(*kept, *[F.col(f"{skip}.{c}") for c in added])
    words = lambda k: F.coalesce(*[F.when(F.col("reason") == r, F.lit(w[k])) for r, w in REASONS.items()])
    return out.withColumns({"detail": words(0), "remediation": words(1)})


def diff_of(name: str, before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), name, name, n=3)) if before != after else ""


def unified_diff(df: DataFrame, path: str = "path", before: str = "text", after: str = "formatted") -> DataFrame:
    """df with ``diff``: three lines of context, the path on both labels, empty where nothing changes."""

    def run(name: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for n, x, y in zip(name.to_pylist(), a.to_pylist(), b.to_pylist()):
            out.append(None if x is None or y is None else diff_of(n or "", x, y))
        return pa.array(out, pa.string())

    return df.withColumn("diff", F.arrow_udf(run, "string")(F.col(path), F.col(before), F.col(after)))


def check(df: DataFrame, path: str = "path") -> DataFrame:
    """One line for each file that would change; df has text and formatted."""
    return df.where(~F.col("formatted").eqNullSafe(F.col("text"))).select(F.concat(F.lit("would reformat "), F.col(path)).alias("line"))


def reflow_text(text: str, options: Options = Options()) -> str:
    return kernel.reflow(text, options)
