"""Exact dedup by content-defined chunk recipes.

Texts are cut where a rolling hash says so, so that equal texts give equal chunks. Each distinct chunk moves once, to be
checked: a 128-bit hash that stands for one chunk content only becomes its identifier; a hash that two contents share is
not used, and the content itself stands in the recipe. Texts are then equal exactly when their ordered identifier
lists are, and only these short lists are compared.

Defined results: a null text equals nothing. Empty texts equal each other. Of equal texts the least doc_id is kept (a
null doc_id comes last); of repeated rows one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16384

_GEAR = C.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last 32 bytes ends in zeros."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """For each row, its chunks in order. No cut looks back beyond its own chunk, so a row's chunks depend on it alone."""
    cuts = cut_points(data)
    firsts = np.searchsorted(cuts, offsets[:-1] + MIN_CHUNK)
    lasts = np.searchsorted(cuts, offsets[1:])
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), firsts.tolist(), lasts.tolist()):
        out, at = [], a
        for c in cuts[i:j].tolist():
            while c - at > MAX_CHUNK:
                out.append((at, at + MAX_CHUNK))
                at += MAX_CHUNK
            if c - at >= MIN_CHUNK:
                out.append((at, c))
                at = c
        while b - at > MAX_CHUNK:
            out.append((at, at + MAX_CHUNK))
            at += MAX_CHUNK
        if b > at:
            out.append((at, b))
        yield out


def chunk_key(content: bytes, bits: int) -> bytes:
    h = xxhash.xxh3_128_digest(content)
    return h if bits == 128 else bytes([h[0] & ((1 << bits) - 1)])  # fewer bits only in tests, to meet collisions


_CHUNKS = pa.schema([("key", pa.binary()), ("content", pa.binary())])


def _chunker(bits: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            data, offsets, _ = C.text_buffers(batch.column(0))
            raw = data.tobytes()
            found = {raw[a:b]: None for spans in chunk_spans(data, offsets) for a, b in spans}  # a content once a slice
            yield pa.RecordBatch.from_arrays([pa.array([chunk_key(c, bits) for c in found], pa.binary()), pa.array(list(found), pa.binary())], schema=_CHUNKS)

    return chunks


def shared_keys(docs: DataFrame, bits: int = 128) -> frozenset[bytes]:
    """Chunk hashes that stand for more than one content: none, but for a collision of 128 bits."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = text.mapInArrow(_chunker(bits), "key binary, content binary").groupBy("key", "content").agg(F.count("*").alias("n"))
    return frozenset(bytes(r[0]) for r in distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").collect())


def recipe(bad: frozenset[bytes], bits: int = 128):
    """A column function: the ordered identifiers of a text's chunks, or null for a null text."""

    @F.arrow_udf("binary")
    def made(text: pa.Array) -> pa.Array:
        out = []
        for batch in C.slices([pa.RecordBatch.from_arrays([text], names=["text"])]):
            data, offsets, valid = C.text_buffers(batch.column(0))
            raw = data.tobytes()
            for ok, spans in zip(valid.tolist(), chunk_spans(data, offsets)):
                parts = []
                for a, b in spans:
                    key = chunk_key(content := raw[a:b], bits)
                    parts.append(b"\1" + len(content).to_bytes(4, "big") + content if key in bad else b"\0" + (b - a).to_bytes(4, "big") + key)
                out.append(b"".join(parts) if ok else None)
        return pa.array(out, pa.binary())

    return C.once(made)


def find_copies(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(doc_id, keep_id, n_copies) for each row whose text another row has too; keep_id is the one to keep."""
    made = recipe(shared_keys(docs, bits), bits)
    ids = docs.select(F.col("doc_id"), made(F.col("text").cast("string")).alias("recipe")).where("recipe is not null")
    ids = C.materialise(ids, "recipes")
    groups = ids.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return ids.join(C.materialise(groups, "copies"), "recipe").select("doc_id", "keep_id", "n_copies")


def drop_copies(docs: DataFrame, bits: int = 128) -> DataFrame:
    """docs without the rows whose text an earlier doc_id has. Only chunks move, and recipes; no whole row does."""
    made = recipe(shared_keys(docs, bits), bits)
    rows = C.placed(docs, "exact-docs")
    found = C.materialise(rows.select("at", F.col("row.doc_id").alias("doc_id"), made(F.col("row.text").cast("string")).alias("recipe")).where("recipe is not null"), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
    groups = found.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    return C.without(rows, found.join(C.materialise(groups, "copies"), "recipe").where("at <> first.at").select("at"), "exact-gone")


def query(spark, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


ORACLE = """select doc_id, keep_id, n_copies from (select doc_id, min(doc_id) over (partition by text) as keep_id,
    count(*) over (partition by text) as n_copies from documents where text is not null) where n_copies > 1"""
