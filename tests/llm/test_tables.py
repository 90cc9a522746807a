import gzip
import heapq
import os
from fractions import Fraction

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from plainfold.llm import common as C
from plainfold.llm import mixing as M
from plainfold.llm import token_rollup as R
from plainfold.llm import warc as W


def by_quotients(weights, room, seats):
    """Sainte-Lague seat by seat."""
    got = [0] * len(weights)
    heap = [(-Fraction(w), i) for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    heapq.heapify(heap)
    while heap and seats:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < room[i]:
            heapq.heappush(heap, (-Fraction(weights[i]) / (2 * got[i] + 1), i))
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 400))
def test_apportionment_is_seat_by_seat(parties, seats):
    weights, room = zip(*parties)
    assert M.apportion(list(weights), list(room), seats) == by_quotients(weights, room, seats)


def test_apportionment_of_many_seats():
    got = M.apportion([3, 1, 0.5], [10**9] * 3, 9 * 10**8)
    assert got == [600_000_000, 200_000_000, 100_000_000]


def test_apportionment_of_many_shards():
    sizes = [900 + i * 7919 % 200 for i in range(30_000)]
    for seats in (1, 29_999, 100_003):
        assert M.apportion(sizes, sizes, seats) == by_quotients(sizes, sizes, seats)
    got = M.apportion(sizes, sizes, 11_111_111)
    taken, missed = min(Fraction(n, 2 * g - 1) for n, g in zip(sizes, got)), max(Fraction(n, 2 * g + 1) for n, g in zip(sizes, got) if g < n)
    assert sum(got) == 11_111_111 and taken >= missed
    assert M.apportion([7] * 30_000, [7] * 30_000, 70_001) == [3] * 10_001 + [2] * 19_999


def test_mixture_matches_sql_in_many_shards(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(M, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(M._oracle()).fetchall())
    got = M.plan(docs, block_tokens=300, shard_tokens=20_000)
    assert sorted(map(tuple, got.collect())) == want and len({r[2] for r in want}) > 1
    mixed = M.mix(docs, block_tokens=300, shard_tokens=20_000)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == [r[0] for r in want]


def test_mixture_meets_its_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{min(i % 10, 3)}") for i in range(4000)], "doc_id long, text string, source string")
    n = {r["source"]: r["n"] for r in M.plan(docs, {"s0": 2}, 1, 500, 50_000).groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    whole = sum(n.values())
    assert all(abs(n[s] / whole - w / 5) < 0.01 for s, w in (("s0", 2), ("s1", 1), ("s2", 1), ("s3", 1)))


def test_mixture_of_odd_rows(odd_docs, no_docs):
    out = M.mix(odd_docs, block_tokens=20, shard_tokens=100)
    assert out.columns == odd_docs.columns and 0 < out.count() <= odd_docs.count()
    assert M.mix(no_docs).count() == 0 and M.plan(no_docs).count() == 0
    assert M.mix(odd_docs, {"src0": 0, "": 1}, 0, 20, 100).where("source = 'src0'").count() == 0


PAGES = "page_id long, url string, html string, payload string"


def odd_pages(spark):
    rows = [(1, "http://a/ü?x=1%20y", "<p>é</p>"), (2, None, "x"), (None, "http://b", "y\r\n\r\nz"), (3, "u\nrl", None), (4, "", ""), (5, "http://big", "q" * 3_000_000), (1, "http://a/ü?x=1%20y", "<p>é</p>"), (7, " http://a/ %0A+%2B ", "x"), (8, "a\tb+c%", "y")]
    return spark.createDataFrame([(*r, "extra") for r in rows], PAGES)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_pages_come_back_from_warc(spark):
    pages = odd_pages(spark)
    folder = C.work_path(spark, "warc-test")
    assert W.write_pages(pages.repartition(3), folder) == 9
    want = sorted((tuple(r)[:3] for r in pages.collect()), key=key)
    for size in (64, 1000, 1 << 20):
        assert sorted((tuple(r) for r in W.pages(W.read(spark, folder, size)).collect()), key=key) == want
    assert W.pages(W.read(spark, C.work_path(spark, "none"))).count() == 0
    empty = C.work_path(spark, "warc-empty")
    assert W.write_pages(pages.limit(0), empty) == 0 and W.pages(W.read(spark, empty)).count() == 0


def test_ranges_own_each_record_once(tmp_path):
    parts = [W.record("resource", {"WARC-Target-URI": f"u{i}"}, os.urandom(i * 37 % 900) + W.MAGIC * (i % 3)) for i in range(60)]
    data = b"".join(parts)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    starts = [sum(map(len, parts[:i])) for i in range(60)]
    for step in (1, 7, 100, 5000, len(data)):
        with open(path, "rb") as f:
            source = W.Source(f, len(data))
            got = [at for a in range(0, len(data), step) for at, _, _ in W.records(source, a, min(a + step, len(data)))]
        assert got == starts


def test_damage_is_passed_over(tmp_path):
    good = [W.record("resource", {"WARC-Target-URI": f"u{i}"}, b"payload %d" % i) for i in range(5)]
    bad = bytearray(good[2])
    bad[len(bad) // 2] ^= 255
    data = good[0] + good[1] + bytes(bad) + b"junk\x1f\x8b\x08" + gzip.compress(b"no record") + good[3] + good[4][:-9]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    with open(path, "rb") as f:
        assert [W.first_of(h, "warc-target-uri") for _, h, _ in W.records(W.Source(f, len(data)), 0, len(data))] == ["u0", "u1", "u3"]


def test_rollup_is_additive_and_idempotent(spark):
    store = R.Rollup(spark, C.work_path(spark, "rollup-test"))
    made = lambda rows: spark.createDataFrame(rows, "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    first = made([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v2", 7, None), ("insert", None, None, "v1", None, None)])
    assert store.totals().count() == 0
    assert store.commit("one", first) and not store.commit("one", first)
    assert sorted(map(tuple, store.totals().collect())) == [("", "", "v1", 0, 1), ("a", "en", "v1", 15, 2), ("a", "en", "v2", 7, 1)]
    assert store.commit("two", made([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("delete", "a", "en", "v2", 7, None)]))
    assert sorted(map(tuple, store.totals().collect())) == [("", "", "v1", 0, 1), ("a", "en", "v1", 12, 1)]
    assert R.Rollup(spark, store.path).batches() == ["one", "two"]  # what another process sees
    # an attempt that was killed leaves no marker; committing again replaces what it wrote
    first.write.parquet(f"{store.path}/three")
    os.remove(f"{store.path}/three/_SUCCESS".removeprefix("file://"))
    assert store.totals().count() == 2 and store.commit("three", made([("insert", "b", "de", "v1", 1, None)]))
    assert sorted(map(tuple, store.totals().collect()))[-1] == ("b", "de", "v1", 1, 1)
    assert store.commit("four", made([])) and store.totals().count() == 3


def test_unknown_changes_fail(spark):
    import pytest

    bad = spark.createDataFrame([("upsert", "a", "en", "v1", 1, None)], "change string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    with pytest.raises(Exception, match="unknown change"):
        R.deltas(bad).collect()
    with pytest.raises(ValueError):
        R.Rollup(spark, "x").commit("../up", bad)


def test_rollup_query_by_hand(spark, sf_dir):
    encode = R._encoder(R.RANKS).encode_ordinary
    con = duckdb.connect()
    rows = con.sql(f"select d.doc_id, source, lang, text, quality, toxic from '{sf_dir}/documents.parquet' d left join '{sf_dir}/labels.parquet' l using (doc_id)").fetchall()
    want: dict = {}
    for _, source, lang, text, quality, toxic in rows:
        if quality == 0:
            continue
        t = want.setdefault((source, lang), [0, 0])
        t[0] += len(encode(text)) + (1 if quality and toxic == 1 else 0)
        t[1] += 1
    assert {(r.source, r.lang): [r.tokens, r.docs] for r in R.query(spark, sf_dir).collect()} == want


def test_rollup_of_documents_labelled_twice(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (2, None, 1), (8, None, 1), (9, None, None), (None, 0, 1), (77, 0, 0), (3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    count = lambda t: len(R._encoder(R.RANKS).encode_ordinary(t)) if t else 0
    want: dict = {}
    for r in odd_docs.collect():
        if r.doc_id not in (1, 3):
            t = want.setdefault((r.source or "", r.lang or ""), [0, 0])
            t[0] += count(r.text) + (r.doc_id in (2, 8))
            t[1] += 1
    assert {(r.source, r.lang): [r.tokens, r.docs] for r in R.query(spark, str(tmp_path)).collect()} == want


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in R.counted(odd_docs).collect()}
    assert got[4].n_tokens == 0 and got[6].n_tokens == 0 and got[8].lang == "" and got[9].source == "" and got[10].n_tokens > 1000
    assert R.counted(no_docs).count() == 0


def test_files_of_others(spark):
    """Other charsets, urls that are escaped already, payloads without a head, repeated and folded headers, long headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html%s\r\n\r\n"
    payloads = [
        (http % b"" + b"caf\xe9", "caf\ufffd"),
        (http % b"; charset=ISO-8859-1" + b"caf\xe9", "caf\xe9"),
        (http % b'; charset="windows-1251"' + "мир".encode("cp1251"), "мир"),
        (http % b"; charset=no-such" + "é".encode(), "é"),
        (http % b"; charset=undefined" + b"x", "x"),
        (b"<p>hello", "<p>hello"),
        (b"", ""),
        (b"HTTP/1.1 200 OK\r\nA: b", ""),
        (b"HTTP/1.0 200 OK\nX-Page-Id: 12\n\na\n\nb", "a\n\nb"),
        (b"HTTP/1.1 204 No Content\r\n\r\n", None),
    ]
    parts = [W.record("response", {"WARC-Target-URI": "http://a/x%20y?n=" + str(i)}, p) for i, (p, _) in enumerate(payloads)]
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nX-Long: one\r\n  two\r\nX-Big: " + os.urandom(60_000).hex().encode() + b"\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    parts.append(gzip.compress(raw))
    folder = C.work_path(spark, "warc-foreign")
    path = folder.removeprefix("file://")
    os.makedirs(path)
    with open(path + "/x.warc.gz", "wb") as f:
        f.write(b"".join(parts))
    found = W.read(spark, folder).orderBy("offset").collect()
    assert len(found) == len(payloads) + 1
    assert [r.uri for r in found[:-1]] == [f"http://a/x%20y?n={i}" for i in range(len(payloads))]
    last = [(h["name"], h["value"]) for h in found[-1].headers]
    assert last[1:4] == [("warc-concurrent-to", "<a>"), ("warc-concurrent-to", "<b>"), ("x-long", "one two")] and len(last[4][1]) == 120_000
    got = {r.url: (r.page_id, r.html) for r in W.pages(W.read(spark, folder)).collect()}
    assert [got[f"http://a/x%20y?n={i}"][1] for i in range(len(payloads))] == [want for _, want in payloads]
    assert got["http://a/x%20y?n=8"][0] == 12 and got[None] == (None, "hi")
