"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps. ``docs`` is a table read
from Parquet; a stage's result is written and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajlake.llm.decontaminate import without_contaminated
from trajlake.llm.importance import keep_quality
from trajlake.llm.minhash_dedup import one_of_each_group
from trajlake.llm.mixing import mix_documents
from trajlake.llm.reshard import sharded
from trajlake.llm.text import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws. Null and empty texts are drawn."""
    return keep_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates. Texts without words are no group."""
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy of a benchmark item. Null texts stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass over a document, with the words taken."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard``, of 8 equal in bytes."""
    return sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The classifier, the sketches and the alignment are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
