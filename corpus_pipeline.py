"""A corpus from raw documents to shards: stages that each take what the one before has kept, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agoraspark.llm.common import saved, table
from agoraspark.llm.decontamination import decontaminate
from agoraspark.llm.mixing import mixed
from agoraspark.llm.neardup import deduplicated
from agoraspark.llm.sharding import sharded
from agoraspark.llm.toxicity import without_toxic
from agoraspark.session import folders, release

#: Percent of shared shingles from which documents are near duplicates here.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return deduplicated(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight: a row for every pass that takes a document."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the models of the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has left in the shared folder goes as soon as its result is written."""
    docs, begun = table(spark, sf_dir, "documents"), folders(spark)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        release(spark, begun, folders(spark) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
