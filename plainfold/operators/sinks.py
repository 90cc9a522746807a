"""What becomes of reflowed files: written in place, one by one and only where they change, or reported."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_file(path: str, content: bytes) -> None:
    """All or nothing: a new file beside the old one, with its mode, takes its name once it is on disk."""
    mode = os.stat(path).st_mode & 0o7777
    fd, draft = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".plainfold-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(draft, mode)
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


def write_in_place(df: DataFrame) -> int:
    """Write (path, text, formatted) back where they differ; how many files changed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, new in zip(*(c.to_pylist() for c in batch.columns)):
                replace_file(path, new.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    changed = df.where(F.col("formatted").isNotNull() & ~F.col("formatted").eqNullSafe(F.col("text"))).select("path", "formatted")
    return changed.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
