"""Token counts as delta-maintained rollups.

A batch of changes becomes one additive table of signed totals by source, language and tokenizer version: an insert adds
its tokens and a document, a delete takes them away, a revision adds the difference between its new and old count. Each
batch is a folder of its own name; it counts once its commit marker stands there, and committing it again does nothing,
so a job that is killed and started again gives the same totals. Totals are the sum over committed batches.

Defined results: null sources, languages and texts count as ''; a null count as 0. Every row of a batch counts, repeated
rows as often as they stand there. Groups without documents and tokens are left out. An unknown kind of change fails. In
the query, a document labelled twice is poor if any label says so, toxic likewise, and retracted once; null labels say nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

RANKS, PATTERN_OF = "/opt/tokenizers/byte_bpe_50k.tiktoken", "public_tokenizers"
VERSION = "byte_bpe_50k@1"
BY = ("source", "lang", "tokenizer")

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import base64
        import importlib

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("plainfold", pat_str=importlib.import_module(PATTERN_OF).PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def counted(docs: DataFrame, path: str = RANKS, version: str = VERSION) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every row; the vocabulary file is read where the tasks run."""

    def count(text: pa.Array) -> pa.Array:
        encode = _encoder(path).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in text.to_pylist()], pa.int64())

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), blank("source").alias("source"), blank("lang").alias("lang"), F.lit(version).alias("tokenizer"), F.arrow_udf(count, "long")(F.col("text").cast("string")).alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of changes (change, source, lang, tokenizer, n_tokens, old_tokens)."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("change")
    bad = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null"))))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).when(kind == "revise", n - old).otherwise(bad.cast("long"))
    rows = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    by = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in BY]
    return changes.select(*by, tokens.cast("long").alias("tokens"), rows.cast("long").alias("docs")).groupBy(*BY).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


class Rollup:
    """Totals kept in a folder, one batch a subfolder."""

    SCHEMA = "source string, lang string, tokenizer string, tokens long, docs long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if self.committed(n))

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/{batch}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing done, if it is there already. What a killed attempt left is overwritten."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/{batch}")
        return True

    def totals(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], self.SCHEMA)
        table = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{b}" for b in found])
        return table.groupBy(*BY).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).where("tokens <> 0 or docs <> 0")


def query(spark, sf_dir: str) -> DataFrame:
    """Load all documents, take out those labelled as poor, recount toxic ones with an end-of-text token, load again."""
    counts = C.materialise(counted(table(spark, sf_dir, "documents")), "token-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    none = F.lit(None).cast("long").alias("old_tokens")
    labelled = counts.join(labels, "doc_id")
    load = counts.select(F.lit("insert").alias("change"), *BY, "n_tokens", none)
    rollup = Rollup(spark, C.work_path(spark, "rollup"))
    rollup.commit("load", load)
    rollup.commit("retract", labelled.where("quality = 0").select(F.lit("delete").alias("change"), *BY, "n_tokens", none))
    rollup.commit("recount", labelled.where("coalesce(quality, 1) <> 0 and toxic = 1").select(F.lit("revise").alias("change"), *BY, (F.col("n_tokens") + 1).alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))
    rollup.commit("load", load)
    return rollup.totals()
