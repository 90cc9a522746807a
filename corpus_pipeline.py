"""The corpus pipeline: documents through quality rules, exact and near dedup, mixing and tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last adds ids, n_tokens and round_trip. Every stage
works on all that the one before it kept. Nulls, empty texts, repeated rows and further columns go through as each
operator's docstring says; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plainfold.llm import common, exact_dedup, mixing, quality, sentencepiece_codec, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In place of mix_sources: the whole corpus is the budget, so that no scarce source cuts the others."""
    return mixing.mix(docs, tokens=mixing.WHOLE)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: Fingerprints, connected components and pieces are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


WHOLE_STAGES = [(name, keep_mixture if stage is mix_sources else stage) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages:
        path = common.work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, WHOLE_STAGES)
