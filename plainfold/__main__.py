"""python -m plainfold [flags] path...: reflow files in place, or check, diff or explain them.

Exit codes: 2 for a usage or configuration error, else 3 if a file was refused, else 1 if --check or --diff found one
that would change, else 0."""

from __future__ import annotations

import argparse
import os
import sys

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plainfold import __version__
from plainfold.markdown import kernel
from plainfold.operators import sinks
from plainfold.functions.rules import REASONS
from plainfold.options import Options, merged
from plainfold.plans import api
from plainfold.sources import files


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plainfold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("paths", nargs="*", help="files and folders; - or none for standard input")
    p.add_argument("--mode", choices=("sentence", "para", "wrap"))
    p.add_argument("--dialect")
    p.add_argument("--max-width", type=int)
    p.add_argument("--config")
    p.add_argument("--version", action="version", version=f"plainfold {__version__} pyspark {pyspark.__version__} python {sys.version.split()[0]}")
    for flag in ("check", "diff", "stdout", "force", "no-gitignore", "explain"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _skipped(path: str, start: int, end: int, reason: str) -> str:
    detail, remediation = REASONS[reason]
    return f"{path}:{start}{f'-{end}' if end != start else ''}: skipped: {detail} [{reason}]\n  {remediation}"


def _piped(a: argparse.Namespace, options: Options) -> int:
    """Standard input to standard output, or to a report. There is no path to exclude, and no Spark."""
    raw = sys.stdin.buffer.read()
    why = files.refused_text(raw) if not a.force or b"\0" not in raw else None
    if why:
        _say(f"<stdin>: refused: {why}")
        return 3
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        _say("<stdin>: refused: not UTF-8")
        return 3
    new = api.reflow_text(text, options)
    if a.explain:
        for start, end, reason in kernel.explain(text, options):
            _say(_skipped("<stdin>", start, end, reason))
    if a.check or a.diff:
        if new != text:
            print(api.diff_of("-", text, new) if a.diff else "would reformat -\n", end="")
        return int(new != text)
    sys.stdout.buffer.write(new.encode())
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments().parse_args(argv)
    flags = {k: v for k, v in (("mode", a.mode), ("dialect", a.dialect), ("max_width", a.max_width)) if v is not None}
    try:
        merged(flags, {})
        if a.paths in ([], ["-"]):
            return _piped(a, files.options_for(os.path.join(os.getcwd(), "-"), flags, files.boundary_of(files.repo_root(os.getcwd())), a.config)[0])
        refused, targets, explicit = False, [], set()
        for path in a.paths:
            whole = os.path.abspath(path)
            repository = files.repo_root(path)
            root = repository or (whole if os.path.isdir(path) else os.path.dirname(whole))
            _, patterns = files.options_for(os.path.join(path, "-") if os.path.isdir(path) else path, flags, files.boundary_of(repository), a.config)
            excluder = files.Excluder(root, patterns, not a.no_gitignore)
            if os.path.isdir(path) and not os.path.islink(path):
                targets += files.walk(path, excluder)
                continue
            if not os.path.lexists(path):
                _say(f"{path}: no such file")
                return 2
            why = None if a.force else excluder.reason(path) or files.irregular(path)
            if why:
                _say(f"{path}: refused: {why}")
                refused = True
                continue
            targets.append(path)
            explicit.add(path)
        if a.stdout and len(targets) != 1:
            _say("--stdout takes exactly one file")
            return 2
        by_options: dict = {}
        for t in targets:
            by_options.setdefault(files.options_for(t, flags, files.boundary_of(files.repo_root(t)), a.config)[0], []).append(t)
    except (ValueError, OSError) as e:
        _say(str(e))
        return 2
    spark = spark or SparkSession.builder.appName("plainfold").getOrCreate()
    changed = False
    for options, paths in by_options.items():
        df = files.read(spark, paths, frozenset(explicit))
        why = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8") if a.force else F.coalesce(files.refusal(F.col("path"), F.col("content")), F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8"))
        df = df.withColumn("refusal", why)
        for r in df.where("refusal is not null").select("path", "refusal").collect():
            _say(f"{r.path}: refused: {r.refusal}")
            refused = True
        df = api.reflow(df.where("refusal is null").withColumn("text", F.col("content").cast("string")), "text", options)
        if a.explain:
            for r in api.explain(df.select("path", "text"), "text", options).orderBy("path", "start_line").collect():
                _say(_skipped(r.path, r.start_line, r.end_line, r.reason))
        if a.check or a.diff:
            report = api.unified_diff(df).where("diff <> ''").orderBy("path").select("path", "diff").collect()
            changed |= bool(report)
            for r in report:
                print(r.diff if a.diff else f"would reformat {r.path}\n", end="")
        elif a.stdout:
            for r in df.select("formatted").collect():
                sys.stdout.buffer.write(r.formatted.encode())
        else:
            sinks.write_in_place(df)
    return 3 if refused else int(changed)


if __name__ == "__main__":
    sys.exit(main())
