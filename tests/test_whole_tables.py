"""Queries over every document, against the kernel row by row."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from plainfold.functions import prose
from plainfold.markdown import kernel
from plainfold.options import Options
from plainfold.plans import api, queries

TEXTS = ["One. Two.", "- Item. More.\n", "# Head\n\nOne. Two.\n", "Spaced  words. And more.\n", "> Quote. More, and more words, " + "and more " * 12 + "still.\n", "", "Fine.", None, "a\x01b. C.", "| a | b |\n|-|-|\n| 1. A | 2 |\n"]


@pytest.fixture
def small(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows, str(tmp_path)


@pytest.mark.parametrize("name", queries.MODES)
def test_modes_over_all_documents(spark, small, name):
    rows, sf = small
    got = {r.doc_id: r.formatted for r in driver.queries()[name](spark, sf).collect()}
    assert got == {i: None if t is None else kernel.reflow(t, queries.MODES[name]) for i, t, *_ in rows}
    plain = {r.doc_id: r.formatted for r in queries.QUERIES["prose_" + name](spark, sf).collect()}
    assert plain.keys() == got.keys() and {k: v for k, v in plain.items() if v is not None}.items() < got.items()


@pytest.mark.parametrize(("table", "column"), [("documents", "text"), ("pages", "html")])
def test_reflow_keeps_what_is_rendered(spark, sf_dir, table, column):
    """Of whole tables: the same rendering, the same words, and nothing left to do."""
    rows = api.reflow(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column), column).collect()
    assert len(rows) >= 50
    for before, after in rows:
        assert kernel.rendered(after) == kernel.rendered(before) and kernel.reflow(after) == after
        assert after.replace("\\", "").split() == before.replace("\\", "").split()


def test_counts_over_all_documents(spark, small):
    rows, sf = small
    want = collections.defaultdict(lambda: [0, 0])
    for _, t, lang, _ in rows:
        want[lang][0] += 1
        want[lang][1] += t is not None and kernel.reflow(t, Options()) != t
    assert {r.lang: [r.n_docs, r.n_changed] for r in queries.needs_format(spark, sf).collect()} == want
    assert {r.source: r.code for r in queries.exit_code_by_source(spark, sf).collect()} == {"s0": 1, "s1": 2, "s2": 3}


def test_sentences_of_all_documents(spark, small):
    rows, sf = small
    lines = collections.Counter((i, x) for i, t, *_ in rows if t for x in kernel.reflow(t, Options()).split("\n") if x)
    assert collections.Counter(map(tuple, queries.sentence_rows(spark, sf).collect())) == lines


def test_paragraph_runs_of_documents(spark, tmp_path):
    docs = [(1, "a\nb\n\n \nc"), (2, None), (3, ""), (4, "\n\nd\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "<p>x</p>\n<b>y")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, queries.paragraph_runs(spark, str(tmp_path)).collect()))
    assert got == [("documents", 1, 1, 2), ("documents", 1, 5, 5), ("documents", 4, 3, 3), ("pages", 1, 1, 1), ("pages", 1, 3, 3)]


def test_sentences_are_split_once(spark, small):
    """The costly expressions of plain texts stand once in the plan."""
    plan = queries.sentence_rows(spark, small[1])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i:") == 1 and plan.count("[-0-9]") == 1 and plan.count(prose._MARKED_CHAR) == 1


def test_plain_is_what_no_pattern_finds(spark):
    rng = random.Random(3)
    pieces = [" ", "\n", "\n\n", "a", "B.", "1.", "12)", "-", ":-", ":", "import", "exports", "www.", "://", "::", "!!!", "???", "!", "é", "\x85", " ", "　", "😀", "\r", "#", "", None]
    df = spark.createDataFrame([("".join(p or "" for p in rng.choices(pieces, k=rng.randint(0, 6))),) for _ in range(4000)] + [(None,)], "text string")
    text = F.col("text")
    for dialect, more in (("gfm", []), ("mkdocs", [prose.ADMONITION_LINE])):
        bad = F.lit(False)
        for p in [prose.MARKED, prose.WIDE_SPACE, prose.SPACED_LINE, prose.MARKER_TOKEN, prose.IMPORT_LINE, *more]:
            bad = bad | text.rlike(p)
        rows = df.select(prose.is_plain(text, dialect).alias("got"), F.coalesce(~bad, F.lit(False)).alias("want")).collect()
        assert all(r.got == r.want for r in rows) and {r.got for r in rows} == {True, False}
