"""The tables that the queries read, bound to the concepts of a transcript corpus, and the same bindings as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """The words between white space; 0 of null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), 0)), F.lit(0)).cast("long")


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a speech turn: conversations, with the attributes that transcripts have."""
    c = table(spark, sf_dir, "conversations")
    year = (F.lit(1900) + F.col("conv_id") % 36).cast("long")
    return c.select(
        F.col("conv_id").alias("debate_id"),
        (F.col("turn") + 1).cast("long").alias("sequence_number"),
        F.concat(F.col("conv_id"), F.lit("_speech_"), F.col("turn") + 1).alias("speech_id"),
        F.col("role").alias("speaker"),
        F.when(F.col("role") == "user", "F").when(F.col("role") == "assistant", "M").alias("gender"),
        year.alias("year"),
        (F.floor(year / 10) * 10).cast("long").alias("decade"),
        F.when(F.col("conv_id") % 5 == 0, "Lords").otherwise("Commons").alias("chamber"),
        n_words(F.col("text")).alias("word_count"),
        "text",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("year", (F.lit(1803) + F.col("doc_id") % 3).cast("long")).withColumn("word_count", n_words(F.col("text")))


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships: a customer's time from one order to the next, the last one open."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("stint_id"), F.col("o_orderdate").alias("begins"),
        F.lead("o_orderdate").over(w).alias("ends"),
    )


SPEECHES = r"""
WITH s AS (
  SELECT conv_id AS debate_id, CAST(turn + 1 AS BIGINT) AS sequence_number, conv_id || '_speech_' || (turn + 1) AS speech_id,
    role AS speaker, CASE role WHEN 'user' THEN 'F' WHEN 'assistant' THEN 'M' END AS gender,
    CAST(1900 + conv_id % 36 AS BIGINT) AS year, CAST(((1900 + conv_id % 36) // 10) * 10 AS BIGINT) AS decade,
    CASE WHEN conv_id % 5 = 0 THEN 'Lords' ELSE 'Commons' END AS chamber,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS word_count, text
  FROM conversations)
"""
DOCUMENTS = r"""
WITH d AS (
  SELECT *, CAST(1803 + doc_id % 3 AS BIGINT) AS year,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS word_count
  FROM documents)
"""
STINTS = """
WITH m AS (
  SELECT o_custkey AS person_id, o_orderkey AS stint_id, o_orderdate AS begins,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ends
  FROM orders)
"""
