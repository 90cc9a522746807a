"""Substring dedup by relative Lempel-Ziv parsing.

The reference is all documents, and its index holds every block of MIN_WORDS words that stands in two of them. Each
document is parsed from its start: at each place the factor is taken that reaches furthest in any indexed block that
holds the place, and parsing goes on where it ends; words that no block holds are literals. A factor's match is then
followed back over the factor's boundary: it may have begun in the factor before, so that what is left of it is short.
Matches of MIN_WORDS words or more, boundaries crossed, are duplicates, and factors that touch make up one span.

The index is never held by one task. A block's key is the least hash of the ANCHOR-word grams in it, so copies of it have
the same key wherever they stand. Successive blocks with one key at one place form a run. Runs whose keys are in one
document only are left out; a run that another document has as a whole is settled by one hash. Of the other runs with
shared keys, and of two copies (in different documents) of each settled run with such a key, every block's hash is
compared. So each block that two documents share is found, whichever and however many documents those are.

The source of a run (block) is its first occurrence by (doc_id, position); for the document that holds that one, its
last. Both occurrences of a passage are hence reported, by whichever document they stand in.

Defined results: words are what lies between ASCII white space. Null, empty and shorter texts have no span. Repeats
within one document are not counted, so repeated rows of one doc_id are one document; of texts that differ under one
doc_id, places of any count. Rows without a doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

MIN_WORDS, ANCHOR, WINDOW = 50, 25, 25  # MIN_WORDS words are those of one anchor and WINDOW words more
HELD = 1 << 18  # matches of a document beyond which those that are the same are joined before more come


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    start, end, row = C.raw_words(data, offsets)
    return C.span_hash(C.prefix_hash(data), start, end), start, end, row


def _slide(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w successive values."""
    pick = np.minimum
    out, have = h, 1
    while have * 2 <= w:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def _windows(words: np.ndarray, row: np.ndarray, span: int, k: int):
    """Places (indexes into words) of the windows of ``span`` words within one document, their keys and hashes."""
    n = len(words) - span + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = C.prefix_hash(words)
    at = np.arange(n + span - k)
    keys = _slide(C.span_hash(prefix, at, at + k), span - k + 1)
    at = np.flatnonzero(row[:n] == row[span - 1 :])
    return at, keys[at], C.span_hash(prefix, at, at + span)


_RUNS = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])


def _runs(span: int, k: int):
    """Successive windows of one key; ``run`` is a hash of all words of the run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            data, offsets, _ = C.text_buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            words, _, _, row = _word_hashes(data, offsets)
            at, key, _ = _windows(words, row, span, k)
            if not len(at):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1)])
            start = at[new]
            n = np.diff(np.append(np.flatnonzero(new), len(at)))
            whole = C.span_hash(C.prefix_hash(words), start, start + n + span - 1)
            first = np.searchsorted(row, np.arange(len(ids)))
            yield C.batch_of(_RUNS, key[new].view(np.int64), whole.view(np.int64), ids[row[start]].astype(np.int64), (start - first[row[start]]).astype(np.int32), n.astype(np.int32))

    return runs


_HASHES = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])


def _hashes(span: int, k: int):
    """Hash and place of each window of the runs asked for."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            data, offsets, _ = C.text_buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            words, _, _, row = _word_hashes(data, offsets)
            first = np.searchsorted(row, np.arange(len(ids) + 1))
            asked = batch.column(2)
            of = np.repeat(np.arange(len(ids)), np.asarray(asked.value_lengths()))
            flat = asked.flatten()
            pos, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            wanted = np.repeat(pos - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            of = np.repeat(of, n)
            there = first[of] + wanted + span <= first[of + 1]  # rows of one doc_id may hold other texts
            of, wanted = of[there], wanted[there]
            here = first[of] + wanted
            yield C.batch_of(_HASHES, C.span_hash(C.prefix_hash(words), here, here + span).view(np.int64), ids[of].astype(np.int64), wanted.astype(np.int32))

    return hashes


def _sourced(places: DataFrame, shared: DataFrame, on: list[str], n, span: int) -> DataFrame:
    """(doc_id, start, end, src_id, shift) of places whose ``on`` has a first and a last occurrence in ``shared``."""
    source = F.when(F.col("doc_id") == F.col("first.doc_id"), F.col("last")).otherwise(F.col("first"))
    found = places.join(shared.select(*on, "first", "last"), on).withColumn("src", source)
    return found.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + n + (span - 1)).cast("int").alias("end"), F.col("src.doc_id").alias("src_id"), (F.col("src.pos") - F.col("pos")).alias("shift"))


def pieces(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start, end, src_id, shift): stretches of shared windows, in words; the source's words are shift further on."""
    text = C.doc_text(docs).where("doc_id is not null and text is not null")
    found = C.materialise(text.mapInArrow(_runs(min_words, anchor), "key long, run long, doc_id long, pos int, n int"), "runs")
    place = F.struct("doc_id", "pos")
    # tables on both sides of a join, so that a key of any number of runs can be split among tasks
    kinds = C.materialise(found.groupBy("key", "run").agg(F.min(place).alias("first"), F.max(place).alias("last")), "all-run-kinds")
    alone = F.col("first.doc_id") == F.col("last.doc_id")
    keys = kinds.groupBy("key").agg(F.min("first.doc_id").alias("lo"), F.max("last.doc_id").alias("hi"), F.max(alone).alias("open")).where("lo < hi").select("key", "open")
    kinds = C.materialise(kinds.join(C.materialise(keys, "run-keys"), "key").withColumn("alone", alone), "run-kinds")
    settled = _sourced(found, kinds.where("not alone"), ["key", "run"], F.col("n"), min_words)
    compared = found.join(kinds.where("open"), ["key", "run"]).where(F.col("alone") | (place == F.col("first")) | (place == F.col("last")))
    asked = compared.select("doc_id", F.struct("pos", "n").alias("run")).groupBy("doc_id").agg(F.collect_set("run").alias("asked"))
    windows = C.materialise(text.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_hashes(min_words, anchor), "window long, doc_id long, pos int"), "windows")
    twice = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first.doc_id < last.doc_id")
    twice = C.materialise(twice, "shared-windows")
    return settled.unionAll(_sourced(windows, twice, ["window"], F.lit(1), min_words))


def parse(start: np.ndarray, end: np.ndarray, src: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy factors (from, to, which match) of a document from its matches, which are sorted by start.

    At a place, the match that holds it and reaches furthest; of equals the one of the least source, then shift."""
    out, at, k, n = [], -1, 0, len(start)
    best = -1
    while k < n or best >= 0:
        while k < n and start[k] <= at:
            if best < 0 or (-end[k], src[k], shift[k]) < (-end[best], src[best], shift[best]):
                best = k
            k += 1
        if best >= 0 and end[best] > at:
            out.append((at, int(end[best]), best))
            at, best = int(end[best]), -1
        elif k < n:
            at, best = int(start[k]), -1  # literals up to the next match
        else:
            break
    return out


def matches(start, end, src, shift) -> tuple[np.ndarray, ...]:
    """Stretches with one source and shift that overlap or touch, joined; sorted by start."""
    order = np.lexsort((start, shift, src))
    start, end, src, shift = start[order], end[order], src[order], shift[order]
    reach = np.empty_like(end)
    new = np.concatenate([[True], (src[1:] != src[:-1]) | (shift[1:] != shift[:-1])])
    group = np.cumsum(new)
    # the furthest end so far within a group: groups lie far apart on one axis
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * far) - group * far
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    joined = start[at], np.maximum.reduceat(end, at), src[at], shift[at]
    order = np.lexsort((joined[3], joined[2], joined[0]))
    return tuple(x[order] for x in joined)


_SPANS = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("src_id", pa.int64()), ("src_word", pa.int32()), ("n_factors", pa.int32())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document; its matches come one after the other, and no two documents' at once."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        doc, start, end, src, shift = (np.concatenate([np.asarray(b.column(k)) for b in held]).astype(np.int64) for k in range(5))
        m = matches(start, end, src, shift)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[: len(m[0])], *m)], names=["doc_id", "start", "end", "src_id", "shift"])

    def close() -> list[tuple]:
        doc, start, end, src, shift = (np.asarray(c) for c in joined().columns)
        held.clear()
        rows: list[list[int]] = []
        for a, b, k in parse(start, end, src, shift):
            if rows and rows[-1][2] == a:
                rows[-1][2], rows[-1][5] = b, rows[-1][5] + 1
            else:
                rows.append([int(doc[0]), a, b, int(src[k]), a + int(shift[k]), 1])
        return rows

    done: list[tuple] = []
    size, limit = 0, HELD
    for batch in batches:
        ids = np.asarray(batch.column(0))
        edge = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(edge, edge[1:]):
            if hi == lo:
                continue
            if held and held[0].column(0)[0].as_py() != ids[lo]:
                done += close()
                size, limit = 0, HELD
            held.append(batch.slice(lo, hi - lo))
            size += hi - lo
            if size > limit:  # rows that repeat one doc_id bring its matches again and again
                held[:] = [joined()]
                size = held[0].num_rows
                limit = max(HELD, 2 * size)
        if len(done) > 1 << 16:
            yield C.batch_of(_SPANS, *zip(*done))
            done = []
    if held:
        done += close()
    if done:
        yield C.batch_of(_SPANS, *zip(*done))


def spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start_word, end_word, src_id, src_word, n_factors): duplicate spans, where the first factor of each comes
    from, and how many factors make it up."""
    found = pieces(docs, min_words, anchor).select("doc_id", "start", "end", "src_id", "shift")
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_parsed, "doc_id long, start_word int, end_word int, src_id long, src_word int, n_factors int")


def query(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
