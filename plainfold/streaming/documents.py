"""Reflow of a stream of documents. Documents are independent, so there is no state, and the batch plan serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plainfold.options import Options
from plainfold.plans import api


def reflow_stream(stream: DataFrame, column: str = "text", options: Options = Options()) -> DataFrame:
    return api.reflow(stream, column, options)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
