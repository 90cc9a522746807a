"""SimHash near-dedup by the generalised pigeonhole principle.

A document's 128-bit SimHash is taken over its distinct lower-cased words of four bytes or more; of a run of letters
longer than any word (scripts without spaces), over its trigrams of characters. Two documents are near
copies when their first 64 bits differ in at most TAU places and all 128 in at most WIDE_TAU. The 64 bits are grouped, by
correlation, into m partitions with thresholds that sum to TAU - m + 1: two fingerprints within TAU then agree to
within the threshold in some partition. Dynamic programming picks the thresholds (and m) that cost least, from the
candidate counts that the partitions' histograms over all fingerprints give (of a partition wider than HISTOGRAM_BITS,
the histogram of so many bits, and the frequencies of the others). A fingerprint is filed under its value in
the partition and under each value that clearing at most t of its set bits gives; two values within t meet in one of
these. Every meeting is verified: a value that more than BLOCK fingerprints are filed under is split into blocks, and each
pair of blocks is a piece of work of its own. Groups are connected components, so a copy of a copy belongs to the group.

Defined results: a text that is null or has no word is no copy of anything. A text of fewer than MIN_FEATURES distinct
words is only a copy of texts with the same words in the same order. Equal texts, and repeated rows, are copies. The
least doc_id of a group is kept (null last). A tau that no choice of thresholds reaches raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

TAU, WIDE_TAU = 11, 24
MIN_FEATURES, MIN_WORD_BYTES = 8, 4
PARTITIONS = (3, 4, 5, 6, 8)
ROW_COST, PAIR_COST = 3e-6, 8e-9  # seconds for a row filed, and for a pair verified
MAX_THRESHOLD, HISTOGRAM_BITS = 3, 16
BLOCK = 1 << 15  # fingerprints of a bucket that are compared in one piece
LONG_WORD_BYTES, GRAM = 32, 3
JUMPS = 2

_TIE = np.unpackbits(C.mix(np.arange(7, 9, dtype=np.uint64)).view(np.uint8))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit halves and the kind of each row: 0 nothing to compare, 1 too short for SimHash, 2 SimHash."""
    n = len(offsets) - 1
    a, b, kind = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int8)
    words, row = C.letter_words(data, offsets, digits=True)
    if not len(words):
        return a, b, kind
    codes, distinct = C.coded_words(words)
    first = C.word_hashes(distinct)
    second = C.mix(first + np.uint64(0x632BE59BD9B4E019))
    lengths = np.diff(np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1])
    # words in order, for short texts
    starts = np.searchsorted(row, np.arange(n))
    ends = np.searchsorted(row, np.arange(n), side="right")
    some = ends > starts
    for out, h in ((a, first), (b, second)):
        out[some] = C.span_hash(C.prefix_hash(h[codes]), starts[some], ends[some])
    kind[some] = 1
    use = (lengths >= MIN_WORD_BYTES) & (lengths <= LONG_WORD_BYTES)
    of, word = row[use[codes]], codes[use[codes]]
    grams, gram_row = _grams(words, row, lengths[codes] > LONG_WORD_BYTES)
    if len(grams):
        more, code = np.unique(grams, return_inverse=True)
        of, word = np.concatenate([of, gram_row]), np.concatenate([word, code + len(first)])
        first = np.concatenate([first, more])
        second = np.concatenate([second, C.mix(more + np.uint64(0x632BE59BD9B4E019))])
    pairs = np.unique(of * len(first) + word)
    if not len(pairs):
        return a, b, kind
    of, word = pairs // len(first), pairs % len(first)
    rows, at, count = np.unique(of, return_index=True, return_counts=True)
    bits = np.unpackbits(np.stack([first, second], 1).view(np.uint8).reshape(len(first), 16), axis=1)
    ones = np.empty((len(rows), 128), np.int32)
    for k in range(0, len(rows), 64):  # a few rows at a time, within the cache
        lo, hi = at[k], at[k + 64] if k + 64 < len(rows) else len(pairs)
        ones[k : k + 64] = np.add.reduceat(bits[word[lo:hi]], at[k : k + 64] - lo, axis=0, dtype=np.int32)
    sim = np.packbits(2 * ones + _TIE > count[:, None], axis=1).view(np.uint64)
    enough = count >= MIN_FEATURES
    a[rows[enough]], b[rows[enough]], kind[rows[enough]] = sim[enough, 0], sim[enough, 1], 2
    return a, b, kind


def _grams(words: pa.Array, row: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every GRAM successive characters of the long words, and their rows."""
    if not long.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]]
    word = np.repeat(np.arange(len(words)), np.diff(ends))
    at = np.flatnonzero(((data & 0xC0) != 0x80) & long[word])  # where characters begin
    of = word[at]
    stop = np.append(at, 0)[GRAM:] if len(at) > GRAM else np.zeros(0, np.int64)
    stop = np.concatenate([stop, np.zeros(len(at) - len(stop), np.int64)])
    same = np.concatenate([of[GRAM:], np.full(min(GRAM, len(of)), -1)]) == of
    last = np.concatenate([of[GRAM - 1 :], np.full(min(GRAM - 1, len(of)), -1)]) == of  # the word ends with this gram
    stop = np.where(same, stop, ends[of + 1])
    keep = same | last
    return C.span_hash(C.prefix_hash(data), at[keep], stop[keep]), row[of[keep]]


def node_of(a: np.ndarray, b: np.ndarray, kind=2) -> np.ndarray:
    return C.mix(a + C.mix(b + np.uint64(1)) * np.uint64(3) + np.asarray(kind).astype(np.uint64)).view(np.int64)


_PRINT = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int8()), ("node", pa.int64())])


def _printed(text: pa.Array) -> pa.Array:
    out = []
    for batch in C.slices([pa.RecordBatch.from_arrays([text], names=["text"])]):
        data, offsets, _ = C.text_buffers(batch.column(0))
        a, b, kind = fingerprints(data, offsets)
        out.append((a.view(np.int64), b.view(np.int64), kind, node_of(a, b, kind)))
    if not out:
        return pa.array([], _PRINT)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], fields=list(_PRINT))


def printed(text):
    """Column: the fingerprint of a text."""
    return C.once(F.arrow_udf(_printed, "a long, b long, kind byte, node long"))(text)


# --- choice of partitions and thresholds -------------------------------------------------------------------------


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 65), np.int64)
    for batch in batches:
        a = np.asarray(batch.column(0)).astype(np.int64)
        x = np.ones((len(a), 65), np.float32)
        x[:, :64] = (a[:, None].view(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        total += np.rint(x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], names=["at", "n"])


def grouped_bits(moments: np.ndarray, m: int) -> list[list[int]]:
    """Bits that correlate most go together, as evenly as 64 allows."""
    n = max(moments[64, 64], 1)
    p = moments[:64, 64] / n
    cov = moments[:64, :64] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    cor = np.abs(cov / np.outer(sd, sd))
    left, out = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        seed = max(left, key=lambda x: (sum(cor[x, y] for y in left), -x))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda x: (sum(cor[x, y] for y in group), -x))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def values(a: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for k, bit in enumerate(bits):
        out |= ((a >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def _histograms(groups: dict[int, list[list[int]]]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for m, parts in groups.items():
                for i, bits in enumerate(parts):
                    v, n = np.unique(values(a, bits[:HISTOGRAM_BITS]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), m)), pa.array(np.full(len(v), i)), pa.array(v), pa.array(n.astype(np.int64))], names=["m", "i", "v", "n"])

    return counted


def _spread_of(chances: list[float]) -> np.ndarray:
    """Probability of 0, 1, 2 ... successes of independent trials."""
    out = np.ones(1)
    for p in chances:
        out = np.append(out * (1 - p), 0) + np.append(0, out * p)
    return out


def costs(value: np.ndarray, n: np.ndarray, width: int, others: list[float] = ()) -> list[float]:
    """Seconds for thresholds -1, 0, 1 ... of one partition, from the histogram of its values; ``others`` are the
    frequencies of the bits that the histogram leaves out."""
    near = np.zeros((MAX_THRESHOLD + 1, 1 << width))
    near[0][value] = n
    cnt = near[0].copy()
    for k in range(width):  # how many lie at distance d of each value
        for d in range(MAX_THRESHOLD, 0, -1):
            near[d] += near[d - 1].reshape(-1, 2, 1 << k)[:, ::-1].reshape(-1)
    meet = near @ cnt
    apart, more = _spread_of([2 * p * (1 - p) for p in others]), _spread_of(list(others))
    ones = np.bincount(np.bitwise_count(value.astype(np.uint64)).astype(int), weights=n, minlength=width + 1)
    out, rows, pairs = [0.0], 0.0, 0.0
    for t in range(MAX_THRESHOLD + 1):
        rows += sum(k * q * comb(c + j, t) for c, k in enumerate(ones) for j, q in enumerate(more))
        pairs += sum(meet[t - j] * q for j, q in enumerate(apart[: t + 1])) / 2
        out.append(float(rows * ROW_COST + pairs * PAIR_COST))
    return out


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programming: thresholds of -1 and up, one a partition, that sum to total and cost least."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (x, ts) in best.items():
            for t in range(-1, len(c) - 1):
                if s + t not in new or x + c[t + 1] < new[s + t][0]:
                    new[s + t] = (x + c[t + 1], [*ts, t])
        best = new
    return best.get(total, (float("inf"), []))


def scheme(unique: DataFrame, tau: int = TAU, partitions: tuple[int, ...] = PARTITIONS) -> tuple[list[tuple[list[int], int]], list[np.ndarray | None]]:
    """(bits, threshold) of each partition that is probed, and its histogram, None for one wider than HISTOGRAM_BITS.

    What comes to the driver doesn't grow with the data."""
    if tau < 0 or not any(tau - m + 1 <= m * MAX_THRESHOLD for m in partitions):
        raise ValueError(f"tau {tau}: no thresholds up to {MAX_THRESHOLD} reach it with {partitions} partitions")
    sums = unique.select("a").mapInArrow(_moments, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    moments = np.zeros(65 * 65)
    for r in sums:
        moments[r["at"]] = r["n"]
    moments = moments.reshape(65, 65)
    often = moments[:64, 64] / max(moments[64, 64], 1)
    groups = {m: grouped_bits(moments, m) for m in partitions}
    hist = unique.select("a").mapInArrow(_histograms(groups), "m long, i long, v long, n long").groupBy("m", "i", "v").agg(F.sum("n").alias("n")).toPandas()
    found = []
    for m, parts in groups.items():
        by = {i: x for i, x in hist[hist["m"] == m].groupby("i")}
        cost = [costs(by[i]["v"].to_numpy(), by[i]["n"].to_numpy(), min(len(bits), HISTOGRAM_BITS), often[bits[HISTOGRAM_BITS:]].tolist()) if i in by else [0.0] * (MAX_THRESHOLD + 2) for i, bits in enumerate(parts)]
        price, ts = allocate(cost, tau - m + 1)
        found.append((price, m, [i for i, t in enumerate(ts) if t >= 0], ts))
    _, m, probed, ts = min(found, key=lambda x: x[:2])

    def whole(i: int) -> np.ndarray | None:
        if len(groups[m][i]) > HISTOGRAM_BITS:
            return None
        out, mine = np.zeros(1 << len(groups[m][i]), np.int64), hist[(hist["m"] == m) & (hist["i"] == i)]
        out[mine["v"].to_numpy()] = mine["n"].to_numpy()
        return out

    return [(groups[m][i], ts[i]) for i in probed], [whole(i) for i in probed]


# --- probing and verification ------------------------------------------------------------------------------------


def _filings(a: np.ndarray, parts: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(which fingerprints, their bucket, bits cleared), for every value of a partition that clearing at most t of its set bits gives."""
    for i, (bits, t) in enumerate(parts):
        v = values(a, bits)
        for cleared in range(t + 1):
            for which in combinations(range(len(bits)), cleared):
                mask = sum(1 << k for k in which)
                hit = np.flatnonzero(v & mask == mask)
                if len(hit):
                    yield hit, (v[hit] & ~mask | i << 24).astype(np.int32), cleared


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            yield tuple(np.asarray(c).astype(np.int64) for c in batch.columns[:2])


def filed_sizes(count: np.ndarray, t: int) -> np.ndarray:
    """How many fingerprints are filed under each value, from how many have each; none more often than once."""
    reach = np.zeros((t + 1, len(count)), count.dtype)
    reach[0] = count
    for k in range(len(count).bit_length() - 1):
        for d in range(t, 0, -1):
            x, y = reach[d].reshape(-1, 2, 1 << k), reach[d - 1].reshape(-1, 2, 1 << k)
            x[:, 0] += y[:, 1]
    for x in reach[1:]:
        reach[0] += x
    return reach[0]


def _sizes(parts: list[tuple[list[int], int]]):
    """Sizes of the buckets of wide partitions, as far as a task's own fingerprints go."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(1 << len(bits), np.int32) for i, (bits, _) in enumerate(parts) if len(bits) > HISTOGRAM_BITS}
        for a, _ in _fingerprints(batches):
            for i, t in total.items():
                v, n = np.unique(values(a.view(np.uint64), parts[i][0]), return_counts=True)
                t[v] += n
        for i in list(total):
            filed = filed_sizes(total.pop(i), parts[i][1])
            for lo in range(0, len(filed), 1 << 16):
                some = np.flatnonzero(filed[lo : lo + (1 << 16)]) + lo
                yield pa.RecordBatch.from_arrays([pa.array((some | i << 24).astype(np.int32)), pa.array(filed[some].astype(np.int64))], names=["bucket", "n"])

    return sizes


def hot_buckets(unique: DataFrame, parts: list[tuple[list[int], int]], hists: list[np.ndarray | None], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that more than ``block`` are filed under, sorted, and into how many blocks each is split.

    There are no more of these than the partitions have values, whatever the data."""
    keys, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, ((_, t), h) in enumerate(zip(parts, hists)):
        if h is not None:
            filed = filed_sizes(h, t)
            big = np.flatnonzero(filed > block)
            keys.append((big | i << 24).astype(np.int32))
            n.append(filed[big])
    if any(h is None for h in hists):
        found = unique.select("a", "b").mapInArrow(_sizes(parts), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > block).toPandas()
        keys.append(found["bucket"].to_numpy(np.int32))
        n.append(found["n"].to_numpy(np.int64))
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys)
    return keys[order], -(-n[order] // block)


def _filed(parts: list[tuple[list[int], int]], hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int32), np.zeros(0, np.int64))):
    """Each fingerprint under its buckets; hot: sorted buckets and the number of blocks of each.

    A fingerprint of a hot bucket goes to each pair of blocks that its own block is in: ``pair`` is that pair's number, and
    ``side`` tells on which side of it the fingerprint is (0 for both, where a block meets itself)."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _fingerprints(batches):
            own = C.mix(a.view(np.uint64) ^ C.mix(b.view(np.uint64)))
            for hit, bucket, cleared in _filings(a.view(np.uint64), parts):
                pair, side = np.zeros(len(hit), np.int32), np.zeros(len(hit), np.int8)
                if len(hot[0]):
                    k = np.minimum(np.searchsorted(hot[0], bucket), len(hot[0]) - 1)
                    blocks = np.where(hot[0][k] == bucket, hot[1][k], 1)
                    each = np.repeat(np.arange(len(hit)), blocks)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    mine = (own[hit[each]] % blocks[each].astype(np.uint64)).astype(np.int64)
                    low, high = np.minimum(mine, other), np.maximum(mine, other)
                    hit, bucket = hit[each], bucket[each]
                    pair, side = (high * (high + 1) // 2 + low).astype(np.int32), (mine > other).astype(np.int8)
                    side[mine == other] = 0
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(pair), pa.array(side), pa.array(np.full(len(hit), cleared, np.int8)), pa.array(a[hit]), pa.array(b[hit])], names=["bucket", "pair", "side", "cleared", "a", "b"])

    return filed


def _merged(batches: Iterator[pa.RecordBatch], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Few large batches out of many small ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def near_pairs(a, b, c, limit: int, tau: int, wide: int, split: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket that verify; c is how many bits each had cleared to come here, sorted on each side.

    With a split, only pairs of one before it and one from it on."""
    n, first = len(a), split
    if split:
        reach = split + np.searchsorted(c[split:], limit - c[:split], side="right")
    else:
        reach = np.searchsorted(c, limit - c, side="right")  # partners with at most so many cleared
    end = split or n
    step = max(1, (1 << 20) // n)
    for lo in range(0, end, step):
        hi = min(end, lo + step)
        start, top = first if split else lo, int(reach[lo:hi].max())
        if top <= start + (not split):
            continue
        x = np.bitwise_count(a[lo:hi, None] ^ a[None, start:top])
        u, v = np.nonzero(x <= tau)
        u += lo
        v += start
        ok = (v > u) & (v < reach[u])
        u, v = u[ok], v[ok]
        if len(u):
            ok = np.bitwise_count(a[u] ^ a[v]).astype(np.int16) + np.bitwise_count(b[u] ^ b[v]) <= wide
            yield u[ok], v[ok]


def spanning(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index of each one's component."""
    label = np.arange(n)
    u, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        differ = label[u] != label[v]
        u, v = u[differ], v[differ]
    return label


def _verified(limits: dict[int, int], tau: int, wide: int):
    """Links within each piece of work; rows come by (bucket, pair), and within these by side and bits cleared."""

    def piece(key: int, side, c, a, b):
        split = int(np.searchsorted(side, 1)) if side[-1] else 0
        if len(a) < 2 or side[0]:  # one side alone
            return None
        label = spanning(len(a), list(near_pairs(a, b, c, limits[key >> 24], tau, wide, split)))
        linked = np.flatnonzero(label != np.arange(len(a)))
        return node_of(a, b)[linked], node_of(a, b)[label[linked]]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list = []

        def close():
            bucket = int(held[0][0])
            found = piece(bucket, *(np.concatenate([h[k] for h in held]) for k in (2, 3, 4, 5)))
            if found is not None and len(found[0]):
                out.append(found)
            held.clear()

        for batch in batches:
            bucket, pair, side, c, a, b = (np.asarray(x) for x in batch.columns)
            a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
            edge = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(bucket)]
            for lo, hi in zip(edge, edge[1:]):
                if hi == lo:
                    continue
                if held and held[0][:2] != (bucket[lo], pair[lo]):
                    close()
                held.append((bucket[lo], pair[lo], side[lo:hi], c[lo:hi], a[lo:hi], b[lo:hi]))
        if held:
            close()
        if out:
            u, v = (np.concatenate(x) for x in zip(*out))
            pairs = np.unique(np.stack([u, v], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return verified


def near_edges(prints: DataFrame, tau: int = TAU, wide: int = WIDE_TAU, partitions: tuple[int, ...] = PARTITIONS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between nodes that connect all near copies; prints has a, b, kind."""
    unique = C.materialise(prints.where("kind = 2").select("a", "b").distinct(), "simhashes")
    parts, hists = scheme(unique, tau, partitions)
    filer = _filed(parts, hot_buckets(unique, parts, hists, block))
    filed = unique.mapInArrow(lambda batches: _merged(filer(batches)), "bucket int, pair int, side byte, cleared byte, a long, b long")
    filed = filed.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "side", "cleared")
    return filed.mapInArrow(_verified({i: t for i, (_, t) in enumerate(parts)}, tau, wide), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): one node of each component that has an edge as the label of all its nodes.

    Every round maps each node to its least neighbour's least neighbour's ... (JUMPS doublings), and edges likewise."""
    edges = C.materialise(edges.where("u <> v"), "edges")
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node"))
    labels = C.materialise(labels, "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        parent = C.materialise(both.groupBy(F.col("u").alias("child")).agg(F.least(F.first("u"), F.min("v")).alias("parent")), "parents")
        for _ in range(JUMPS):
            up = parent.select(F.col("child").alias("middle"), F.col("parent").alias("top"))
            parent = parent.join(up, F.col("parent") == F.col("middle")).select("child", F.col("top").alias("parent"))
        parent = C.materialise(parent, "parents")
        labels = C.materialise(labels.join(parent, F.col("label") == F.col("child"), "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        up = edges.join(parent, F.col("u") == F.col("child")).select(F.col("parent").alias("u"), "v")
        edges = C.materialise(up.join(parent, F.col("v") == F.col("child")).select("u", F.col("parent").alias("v")).where("u <> v").distinct(), "edges")
    return labels


def find_near(docs: DataFrame, tau: int = TAU, wide: int = WIDE_TAU) -> DataFrame:
    """(doc_id, keep_id, n_copies) for each row of a group of two or more."""
    prints = C.materialise(docs.select(F.col("doc_id"), printed(F.col("text").cast("string")).alias("p")).select("doc_id", "p.*").where("kind > 0"), "prints")
    labels = components(near_edges(prints, tau, wide))
    grouped = C.materialise(prints.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("group")), "near-groups")
    of = grouped.groupBy("group").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return grouped.join(C.materialise(of, "near-copies"), "group").select("doc_id", "keep_id", "n_copies")


def drop_near(docs: DataFrame, tau: int = TAU, wide: int = WIDE_TAU) -> DataFrame:
    """docs with one row of each group. Fingerprints move, no row does."""
    rows = C.placed(docs, "near-docs")
    prints = C.materialise(rows.select("at", F.col("row.doc_id").alias("doc_id"), printed(F.col("row.text").cast("string")).alias("p")).select("at", "doc_id", "p.*").where("kind > 0"), "prints")
    grouped = C.materialise(prints.join(components(near_edges(prints, tau, wide)), "node", "left").select("at", "doc_id", F.coalesce("label", "node").alias("group")), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
    groups = grouped.groupBy("group").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    return C.without(rows, grouped.join(C.materialise(groups, "near-copies"), "group").where("at <> first.at").select("at"), "near-gone")


def query(spark, sf_dir: str) -> DataFrame:
    return find_near(table(spark, sf_dir, "documents"))
