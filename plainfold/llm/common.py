"""Helpers shared by the operators: vectorised word views of Arrow text, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # text handled at once inside a worker; keeps numpy temporaries small

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``. Where it is unset, one of our own, but only if
    Spark runs within this process; on a cluster that would be a different folder on each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plainfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the table to the shared folder and read it back.

    A join of two such tables has a shuffle right below each side, which is what adaptive execution needs to split a hot
    key among tasks; it can't where one side is an aggregate of the same key."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(udf):
    """A function of the text that is planned as if it weren't deterministic, though it is: else the optimizer pushes a
    filter on its result below the projection, and evaluates it there and again above."""
    return udf.asNondeterministic()


def packed(docs: DataFrame) -> DataFrame:
    """The whole row as one struct column, so that no column name can clash with ours."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


BUCKETS = 4096  # folders that a set of places is written to, by file
_PLAIN_PLANS = {"Project", "Filter", "SubqueryAlias", "View", "Repartition", "RepartitionByExpression", "LogicalRelation"}


def _is_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a Parquet file, and no other row is the same one."""
    plan = docs._jdf.queryExecution().analyzed()
    while True:
        name = plan.getClass().getSimpleName()
        if name not in _PLAIN_PLANS:
            return False
        if name == "LogicalRelation":
            return plan.relation().toString() == "parquet"
        plan = plan.children().head()


def placed(docs: DataFrame, name: str) -> DataFrame:
    """(row, at): the whole row, and where it stands: its file, and its number there. What is no table yet is written as one."""
    if not _is_scan(docs):
        docs = materialise(docs, name)
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*cols).alias("row"), F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("n")).alias("at"))


def without(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """rows (row, at) but those at ``places`` (at), unpacked. No row moves: the places are written out by file, and each
    task reads those of the files that it has, which are no more than the rows of these."""
    path = _qualified(rows.sparkSession, work_path(rows.sparkSession, name))
    bucket = lambda file: F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")
    gone = places.select(bucket(F.col("at.file")).alias("bucket"), F.col("at.file").alias("file"), F.col("at.n").alias("n"))
    gone.repartition("bucket").sortWithinPartitions("bucket", "file", "n").write.partitionBy("bucket").parquet(path)

    @F.arrow_udf("boolean")
    def kept(file: pa.Array, n: pa.Array, which: pa.Array) -> pa.Array:
        d = file.dictionary_encode()
        codes, at, buckets = np.asarray(d.indices), np.asarray(n), np.asarray(which)
        out = np.ones(len(codes), bool)
        for i, f in enumerate(d.dictionary.to_pylist()):
            mine = np.flatnonzero(codes == i)
            known = _places(path, f, int(buckets[mine[0]]))
            if len(known):
                k = np.minimum(np.searchsorted(known, at[mine]), len(known) - 1)
                out[mine] = known[k] != at[mine]
        return pa.array(out)

    return unpacked(rows.where(kept(F.col("at.file"), F.col("at.n"), bucket(F.col("at.file")))))


def _qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark takes it to have."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme, rest = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().split(":", 1)
    return f"{scheme}://{rest}" if not rest.startswith("//") else f"{scheme}:{rest}"


@lru_cache(maxsize=4)
def _places(path: str, file: str, bucket: int) -> np.ndarray:
    scheme, rest = path.split("://", 1)
    fs, base = pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    if fs.get_file_info(f"{base}/_SUCCESS").type != pafs.FileType.File:  # else a folder out of reach would read as no places
        raise FileNotFoundError(f"{path} is not what Spark has written")
    found = fs.get_file_info(pafs.FileSelector(f"{base}/bucket={bucket}", allow_not_found=True))
    parts = [pq.read_table(f.path, filesystem=fs, columns=["n"], filters=[("file", "=", file)], partitioning=None).column(0).to_numpy() for f in found if f.path.endswith(".parquet")]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def doc_text(docs: DataFrame) -> DataFrame:
    """Just (doc_id, text), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about SLICE_BYTES of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets, _ = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
            end = min(n, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets into them (n + 1, from 0), and a mask of rows that are not null; null rows are empty."""
    valid = np.asarray(col.is_valid())
    if not valid.all():
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], valid


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[inverse] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash mod 2**64; ``span_hash`` takes differences of it."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = powers(len(prefix), True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte for byte."""
    out = _LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of True that never cross a row."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def raw_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space."""
    return runs(~_SPACE[data], offsets)


def letter_words(data: np.ndarray, offsets: np.ndarray, digits: bool = False):
    """Lower-cased words of letters (and digits) as an Arrow array, and the row of each."""
    low = lowered(data)
    inside = (_ALNUM if digits else _LETTER)[low]
    start, end, row = runs(inside, offsets)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    kept = low[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, row


def coded_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words."""
    d = words.dictionary_encode()
    return np.asarray(d.indices), d.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    bufs = distinct.buffers()
    off = np.frombuffer(bufs[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[: off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return span_hash(prefix_hash(data), off[:-1], off[1:])


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema)], schema=schema)
