import collections

import numpy as np
import pyarrow as pa
import pytest

from plainfold.llm import common as C
from plainfold.llm import exact_dedup as E
from plainfold.llm import simhash as S
from plainfold.llm import substring as R

from .conftest import WORDS


def groups(pairs):
    """Components of pairs, by union-find."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def brute_near(rows, tau=S.TAU, wide=S.WIDE_TAU):
    """(doc_id, keep_id, n_copies) by comparing all fingerprints; rows are (doc_id, a, b, kind)."""
    rows = [r for r in rows if r[3] > 0]
    a, b = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (1, 2))
    kind = np.array([r[3] for r in rows])
    ids = [r[0] for r in rows]
    pairs = [(i, i) for i in ids]
    for i in range(len(rows)):
        d1, d2 = np.bitwise_count(a[i] ^ a).astype(int), np.bitwise_count(b[i] ^ b).astype(int)
        near = (kind == kind[i]) & ((d1 + d2 == 0) | (kind == 2) & (d1 <= tau) & (d1 + d2 <= wide))
        pairs += [(ids[i], ids[j]) for j in np.flatnonzero(near)]
    of = groups(pairs)
    size = collections.Counter(of[i] for i in ids)
    return sorted((i, of[i], size[of[i]]) for i in ids if size[of[i]] > 1)


def test_chunks_depend_on_their_own_text_alone():
    g = np.random.default_rng(1)
    texts = [g.integers(97, 123, n).astype(np.uint8) for n in (0, 1, 600, 5000, 90000, 40000)]
    alone = [[(a, b) for a, b in next(E.chunk_spans(t, np.array([0, len(t)])))] for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = list(E.chunk_spans(np.concatenate(texts), offsets))
    assert [[(a - o, b - o) for a, b in s] for s, o in zip(together, offsets)] == alone
    for t, s in zip(texts, alone):
        assert [x for x, _ in s][:1] == ([0] if len(t) else []) and all(x[1] == y[0] for x, y in zip(s, s[1:])) and (not s or s[-1][1] == len(t))
        assert all(b - a <= E.MAX_CHUNK for a, b in s)


def test_exact_copies_match_equality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = collections.defaultdict(list)
    for r in docs.collect():
        by[r.text].append(r.doc_id)
    want = sorted((i, min(ids), len(ids)) for ids in by.values() if len(ids) > 1 for i in ids)
    assert sorted(map(tuple, E.find_copies(docs).collect())) == want
    assert sorted(map(tuple, E.find_copies(docs, bits=3).collect())) == want  # nearly every hash collides
    assert len(E.shared_keys(docs, 3)) == 8
    kept = sorted(r.doc_id for r in E.drop_copies(docs).collect())
    assert kept == sorted(min(ids) for ids in by.values())


def test_rows_are_left_out_by_their_place(spark, tmp_path):
    rows = [(i, "x" * i, None if i % 3 else "m", "r") for i in range(200)]
    docs = spark.createDataFrame(rows, "id int, _metadata string, at string, row string").repartition(7)
    docs.write.option("parquet.block.size", 512).parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    once, same, none = (read, False), (read.unionAll(read), True), (read.limit(0), True)
    for table, copied in (once, (read.where("id < 90").select("id", "at").repartition(3), False), same, none, (read.selectExpr("id", "explode(array(1, 2)) as k"), True)):
        assert C._is_scan(table) != copied
        p = C.placed(table, "placed")
        gone = p.where("row.id % 5 = 0").select("at")
        want = sorted(map(repr, table.where("id % 5 <> 0").collect()))
        left = C.without(p, gone, "gone")
        assert left.columns == table.columns and sorted(map(repr, left.collect())) == want
        assert sorted(map(repr, C.without(p, gone.limit(0), "gone").collect())) == sorted(map(repr, table.collect()))


def test_exact_copies_of_odd_rows(odd_docs, no_docs):
    kept = E.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    assert sorted(map(tuple, E.find_copies(odd_docs).collect())) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (3, 1, 4), (6, 6, 2), (7, 6, 2)]
    assert E.drop_copies(no_docs).count() == 0 and E.find_copies(no_docs).count() == 0


def test_near_copies_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = docs.select("doc_id", S.printed(docs.text).alias("p")).select("doc_id", "p.a", "p.b", "p.kind").collect()
    want = brute_near(prints)
    got = sorted(map(tuple, S.find_near(docs).collect()))
    assert got == want and len(want) > 100
    gone = {i for i, keep, _ in want if i != keep}
    assert sorted(r.doc_id for r in S.drop_near(docs).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id not in gone)


def test_thresholds_are_optimal_and_sufficient():
    from itertools import product

    g = np.random.default_rng(3)
    for m, total in ((3, 2), (4, 5), (5, -1)):
        cost = [sorted(g.random(5).tolist()) for _ in range(m)]
        best = min(sum(c[t + 1] for c, t in zip(cost, ts)) for ts in product(range(-1, 4), repeat=m) if sum(ts) == total)
        price, ts = S.allocate(cost, total)
        assert abs(price - best) < 1e-12 and sum(ts) == total
    value, n = np.unique(g.integers(0, 64, 500), return_counts=True)
    near = sum(a * b for x, a in zip(value, n) for y, b in zip(value, n) if int(x ^ y).bit_count() <= 1) / 2
    c = S.costs(value, n, 6)
    rows = sum(k * (1 + int(v).bit_count()) for v, k in zip(value, n))
    assert abs(c[2] - (rows * S.ROW_COST + near * S.PAIR_COST)) < 1e-9


@pytest.mark.parametrize(("partitions", "block"), [((3,), S.BLOCK), ((3,), 7), ((4,), 50), ((5,), 3), ((8,), 64), (S.PARTITIONS, 1)])
def test_every_partition_and_split_finds_all_pairs(spark, partitions, block):
    """Copies at the very radius, and nearly all fingerprints in one bucket of each partition."""
    g = np.random.default_rng(5)
    base = g.integers(0, 1 << 63, 1, dtype=np.int64)
    few = np.array([sum(1 << int(k) for k in g.choice(63, int(g.integers(0, 4)), replace=False)) for _ in range(250)], np.int64)
    a = np.concatenate([base ^ few, g.integers(0, 1 << 63, 150, dtype=np.int64)])
    flips = np.array([sum(1 << int(k) for k in g.choice(63, S.TAU, replace=False)) for _ in range(len(a))], np.int64)
    a = np.concatenate([a, a ^ flips])
    b = np.concatenate([g.integers(0, 1 << 63, len(flips), dtype=np.int64)] * 2)
    rows = [(i, int(x), int(y), 2) for i, (x, y) in enumerate(zip(a, b))]
    prints = spark.createDataFrame(rows, "doc_id long, a long, b long, kind byte")
    node = S.node_of(a.view(np.uint64), b.view(np.uint64)).tolist()
    of = groups([(r.u, r.v) for r in S.near_edges(prints, partitions=partitions, block=block).collect()] + [(x, x) for x in node])
    want = {i: keep for i, keep, _ in brute_near(rows)}
    got: dict = {}
    for i, x in enumerate(node):
        got.setdefault(of[x], []).append(i)
    assert {i: min(c) for c in got.values() if len(c) > 1 for i in c} == want and len(want) == len(rows)


def test_a_radius_out_of_reach_is_refused(spark):
    unique = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError, match="tau 40"):
        S.scheme(unique, 40)
    assert S.scheme(unique, 31)[0] and S.scheme(unique, 0)[0]


def test_sizes_of_buckets(spark):
    g = np.random.default_rng(2)
    v = g.integers(0, 256, 300)
    bits, t = list(range(8)), 2
    filed = np.concatenate([bucket for _, bucket, _ in S._filings(v.astype(np.uint64), [(bits, t)])])
    assert S.filed_sizes(np.bincount(v, minlength=256), t).tolist() == np.bincount(filed, minlength=256).tolist()


def test_texts_without_spaces(spark):
    import random

    r = random.Random(6)
    made = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))
    one, two = made(600), made(600)
    rows = [(1, one), (2, one[:300] + "中" + one[301:]), (3, two), (4, made(40)), (5, made(2))]
    assert sorted(map(tuple, S.find_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 1, 2), (2, 1, 2)]
    words = pa.array(["é" * 3, "日本語学校" * 4, "x" * 40], pa.large_binary())
    h, row = S._grams(words, np.array([0, 0, 1]), np.array([False, True, True]))
    assert len(h) == 18 + 38 and len(set(h.tolist())) == 5 + 1 and row.tolist() == [0] * 18 + [1] * 38


def test_costs_of_a_wide_partition_are_estimated():
    """A histogram of some bits and the frequencies of others, against the whole histogram of independent bits."""
    g = np.random.default_rng(8)
    p = g.uniform(0.2, 0.8, 14)
    bits = g.random((60_000, 14)) < p
    whole, n = np.unique(bits @ (1 << np.arange(14)), return_counts=True)
    part, k = np.unique(bits[:, :9] @ (1 << np.arange(9)), return_counts=True)
    want, got = S.costs(whole, n, 14), S.costs(part, k, 9, p[9:].tolist())
    assert all(abs(x - y) <= 0.05 * x for x, y in zip(want, got))


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    kept = S.drop_near(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert {0, 4, 5, 6, 7, 12, 13, 14} <= set(ids) and ids.count(1) == 1 and not {2, 3} & set(ids)
    found = {tuple(r) for r in S.find_near(odd_docs).collect()}
    assert all(k == 1 for i, k, _ in found if i in (1, 2, 3))
    assert S.drop_near(no_docs).count() == 0 and S.find_near(no_docs).count() == 0


def test_edited_copies_are_found(spark):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(4, 9)))
    rows, pairs = [], []
    for k in range(150):
        w = [word() for _ in range(200)]
        rows.append((2 * k, " ".join(w)))
        for i in r.sample(range(200), 8):
            w[i] = word()
        rows.append((2 * k + 1, " ".join(w)))
        pairs.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.keep_id for r in S.find_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.get(b) == a for a, b in pairs) >= 0.9 * len(pairs)
    assert all(v in (k, k - 1) for k, v in got.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in S.components(edges).collect()}
    assert set(got) == {*range(41), 100, 101} and len({got[i] for i in range(41)}) == 1 and got[100] == got[101] != got[0]


def brute_spans(rows, k):
    """Places (doc_id, word) in windows of k words that another document has too."""
    seen = collections.defaultdict(set)
    words = {i: t.split() for i, t in rows if t}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            seen[tuple(w[j : j + k])].add(i)
    return {(i, j + x) for i, w in words.items() for j in range(len(w) - k + 1) if len(seen[tuple(w[j : j + k])]) > 1 for x in range(k)}


def test_spans_match_all_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_spans([(r.doc_id, r.text) for r in docs.collect()], R.MIN_WORDS)
    got = {(r.doc_id, x) for r in R.spans(docs).collect() for x in range(r.start_word, r.end_word)}
    assert got == want and want


def test_growing_prefixes(spark):
    """Documents that share ever longer prefixes: all of a passage is found, however few documents have its end."""
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(70)]
    rows = [(i, " ".join(shared[: 26 + i] + [word() for _ in range(40)])) for i in range(34)]
    got = {(s.doc_id, x) for s in R.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in range(s.start_word, s.end_word)}
    assert got == brute_spans(rows, R.MIN_WORDS) and (24, 0) in got and (33, 57) in got


def plain_parse(start, end, src, shift):
    """Greedy parse, place by place."""
    out, at, last = [], 0, max(end, default=0)
    while at < last:
        held = [k for k in range(len(start)) if start[k] <= at < end[k]]
        if not held:
            at += 1
            continue
        k = min(held, key=lambda k: (-end[k], src[k], shift[k]))
        out.append((at, end[k], k))
        at = end[k]
    return out


def test_factors_are_the_greedy_parse():
    import random

    r = random.Random(5)
    for _ in range(500):
        rows = sorted({(r.randint(0, 30), r.randint(3, 9), r.randint(0, 2), r.randint(-1, 1)) for _ in range(r.randint(1, 12))})
        start, n, src, shift = (np.array(x) for x in zip(*rows))
        m = R.matches(start, start + n, src, shift)
        assert R.parse(*m) == plain_parse(*(x.tolist() for x in m))
        of = lambda a, b, s, d: {(s[k], d[k], x) for k in range(len(a)) for x in range(a[k], b[k])}
        assert of(*m) == of(start, start + n, src, shift)
        groups_ = {}
        for a, b, s, d in zip(*m):
            groups_.setdefault((s, d), []).append((a, b))
        assert all(x[1] < y[0] for g in groups_.values() for x, y in zip(sorted(g), sorted(g)[1:]))  # as long as they can be


def test_a_passage_in_other_surroundings(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(6):
        before, after = ([word() for _ in range(r.randint(0, 90))] for _ in range(2))
        rows.append((i, len(before), " ".join(before + passage + after)))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(99, " ".join(word() for _ in range(300)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in R.spans(docs).collect()) == [(i, at, at + 60) for i, at, _ in rows]


def test_spans_of_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in R.spans(odd_docs).collect())
    n = len(WORDS.split()) * 2000
    assert [i for i, _, _ in got] == [10, 11] and all(a < R.WINDOW and n - b < R.WINDOW for _, a, b in got)
    assert R.spans(no_docs).count() == 0
