"""Tables of a folder, spread over the cores where their files alone would leave most of these idle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a scan of it would keep fewer than half of these busy.

    Such a table is small: one split a busy core, so that a core's share of the exchange is at most half a split. A table
    of more splits than that is left as it is, whatever its size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
