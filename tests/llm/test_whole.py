"""Whole tables, where a bound used to leave some of them out."""

import random

import duckdb

from plainfold.llm import common as C
from plainfold.llm import mixing as M
from plainfold.llm import substring as R
from plainfold.llm import warc as W

from .test_dedup import brute_spans


def test_a_scarce_source_does_not_cap_the_mixture(spark):
    rows = [(i, f"s{min(i, 60) % 3}" if i < 60 else "rare", "w " * 50) for i in range(61)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one_each = dict(weights={}, block_tokens=50)
    assert M.plan(docs, **one_each).count() == 4  # what the weights allow: one block of each source
    assert {r.doc_id for r in M.mix(docs, tokens=M.WHOLE, **one_each).collect()} == set(range(61))
    got = {r.source: (r.blocks, r.taken, r.kept_share, round(r.deviation, 3)) for r in M.shares(docs, tokens=50 * 31, **one_each).collect()}
    assert got == {"rare": (1, 1, 1.0, -0.218), **{f"s{k}": (20, 10, 0.5, 0.073) for k in range(3)}}
    assert M.plan(docs, tokens=50 * 31, **one_each).count() == 31


def test_mixing_whole_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create table documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, M.query_whole(spark, sf).collect()))
    assert got == sorted(con.sql(M.ORACLE_WHOLE).fetchall()) and len(got) == con.sql("select count(*) from documents").fetchall()[0][0]
    old = {tuple(r) for r in M.query(spark, sf).collect()}
    assert old == set(con.sql(M.ORACLE).fetchall()) and len(old) < len(got)


def test_spans_are_found_whatever_other_documents_hold(spark):
    """A line of 30 to 49 words that many documents have, inside passages that few have."""
    r = random.Random(9)
    some = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, n = [], 0
    for trial in range(40):
        line = some(r.randint(30, 49))
        passage = some(r.randint(5, 20)) + line + some(r.randint(5, 20))
        held = [line, passage, some(3) + line, passage, line, passage[4:-4]]
        if trial % 2:
            r.shuffle(held)
        rows += [(n + i, " ".join(some(r.randint(0, 60)) + x + some(r.randint(0, 60)))) for i, x in enumerate(held)]
        n += len(held)
    docs = spark.createDataFrame(rows + rows[:5] + [(0, "another text of the same id")], "doc_id long, text string")
    found = R.spans(docs).collect()
    words = {i: t.split() for i, t in rows}
    assert {(s.doc_id, x) for s in found for x in range(s.start_word, s.end_word)} == brute_spans(rows, R.MIN_WORDS)
    for s in found:  # and the source has the span's first words
        assert s.src_id != s.doc_id
        assert words[s.doc_id][s.start_word : s.start_word + R.MIN_WORDS] == words[s.src_id][s.src_word : s.src_word + R.MIN_WORDS]


def test_spans_equal_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_spans([(r.doc_id, r.text) for r in docs.collect()], R.MIN_WORDS)
    assert {(r.doc_id, x) for r in R.spans(docs).collect() for x in range(r.start_word, r.end_word)} == want


def test_pages_with_long_urls_come_back(spark):
    r = random.Random(3)
    rows = [(i, "http://h/" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)), "<p>x</p>") for i, n in enumerate((10, 70_000, 200_000, 1_000_000, 20))]
    folder = "file:///" + C.work_path(spark, "warc-long").split(":", 1)[1].lstrip("/")
    W.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    assert sorted(map(tuple, W.pages(W.read(spark, folder)).collect())) == rows
