"""Participation: what speakers and groups take of a debate against what is expected of their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.aggregates import weighted_mean
from agoraspark.registry import query
from agoraspark.views import SPEECHES, speeches


def totals(s: DataFrame) -> DataFrame:
    """A row a debate: words, speakers, turns and the first year."""
    return s.groupBy("debate_id").agg(
        F.sum("word_count").alias("words"), F.countDistinct("speaker").alias("speakers"), F.count("*").alias("turns"), F.min_by("year", "sequence_number").alias("year")
    )


def by_group(s: DataFrame) -> DataFrame:
    """A row a debate and gender: speakers, words, turns."""
    return s.groupBy("debate_id", "gender").agg(F.countDistinct("speaker").alias("n"), F.sum("word_count").alias("observed"), F.count("*").alias("group_turns"))


def by_speaker(s: DataFrame) -> DataFrame:
    return s.groupBy("debate_id", "speaker", "gender").agg(F.sum("word_count").alias("observed"), F.count("*").alias("own_turns"))


def group_norms(s: DataFrame) -> DataFrame:
    """Observed over expected of each group, expected by its part of the debate's speakers of any known gender."""
    g = by_group(s.where("gender is not null"))
    known = F.sum("n").over(Window.partitionBy("debate_id"))
    both = g.withColumn("part", F.col("n") / known).join(totals(s).select("debate_id", "words", "turns", "year"), "debate_id")
    return both.withColumn("expected", F.col("part") * F.col("words")).withColumn("norm", F.try_divide(F.col("observed"), F.col("expected")))


PARTS = SPEECHES + """, t AS (SELECT debate_id, CAST(sum(word_count) AS BIGINT) AS words, count(DISTINCT speaker) AS speakers, count(*) AS turns, arg_min(year, sequence_number) AS year FROM s GROUP BY 1),
g AS (SELECT debate_id, gender, count(DISTINCT speaker) AS n, CAST(sum(word_count) AS BIGINT) AS observed, count(*) AS group_turns FROM s GROUP BY 1, 2),
p AS (SELECT debate_id, speaker, gender, CAST(sum(word_count) AS BIGINT) AS observed, count(*) AS own_turns FROM s GROUP BY 1, 2, 3),
x AS (SELECT g.*, n / sum(n) OVER (PARTITION BY debate_id) AS part FROM g WHERE gender IS NOT NULL),
q AS (SELECT x.*, words, turns, year, part * words AS expected, observed / nullif(part * words, 0) AS norm FROM x JOIN t USING (debate_id))
"""


@query(PARTS + "SELECT debate_id, words, speakers, turns, year FROM t")
def att_debate_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals(speeches(spark, sf))


@query(PARTS + "SELECT g.debate_id, gender, round(n / speakers * words, 6) AS expected FROM g JOIN t USING (debate_id)")
def att_expected_gender(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    both = by_group(s).join(totals(s), "debate_id")
    return both.select("debate_id", "gender", F.round(F.col("n") / F.col("speakers") * F.col("words"), 6).alias("expected"))


@query(PARTS + """SELECT p.debate_id, speaker, round(p.observed / nullif(n / speakers * words, 0), 6) AS norm FROM p JOIN t USING (debate_id)
JOIN g ON g.debate_id = p.debate_id AND g.gender IS NOT DISTINCT FROM p.gender""")
def att_norm_speaker(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    p, g = by_speaker(s), by_group(s).select("debate_id", F.col("gender").alias("g"), "n")
    both = p.join(totals(s), "debate_id").join(g, (p["debate_id"] == g["debate_id"]) & F.col("gender").eqNullSafe(F.col("g"))).drop(g["debate_id"])
    norm = F.try_divide(F.col("observed"), F.col("n") / F.col("speakers") * F.col("words"))
    return both.select("debate_id", "speaker", F.round(norm, 6).alias("norm"))


@query(PARTS + "SELECT debate_id, speaker, round(observed / nullif(words / speakers, 0), 6) AS norm FROM p JOIN t USING (debate_id)")
def att_flat_norm(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    norm = F.try_divide(F.col("observed"), F.col("words") / F.col("speakers"))
    return by_speaker(s).join(totals(s), "debate_id").select("debate_id", "speaker", F.round(norm, 6).alias("norm"))


@query(PARTS + "SELECT debate_id, speaker, round((observed / own_turns) / nullif(words / turns, 0), 6) AS norm FROM p JOIN t USING (debate_id)")
def att_words_per_turn_norm(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    norm = F.try_divide(F.col("observed") / F.col("own_turns"), F.col("words") / F.col("turns"))
    return by_speaker(s).join(totals(s), "debate_id").select("debate_id", "speaker", F.round(norm, 6).alias("norm"))


@query(PARTS + "SELECT debate_id, gender, round(expected, 6) AS expected, round(norm, 6) AS norm FROM q")
def att_group_norm(spark: SparkSession, sf: str) -> DataFrame:
    return group_norms(speeches(spark, sf)).select("debate_id", "gender", F.round("expected", 6).alias("expected"), F.round("norm", 6).alias("norm"))


@query(PARTS + """SELECT debate_id, gender, speaker, observed, CAST(NULL AS BIGINT) AS n, 'speaker' AS row_type FROM p
UNION ALL SELECT debate_id, gender, NULL, observed, n, 'group' FROM g WHERE gender IS NOT NULL""")
def att_union_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    own = by_speaker(s).drop("own_turns").withColumn("row_type", F.lit("speaker"))
    group = by_group(s.where("gender is not null")).drop("group_turns").withColumn("row_type", F.lit("group"))
    return own.unionByName(group, allowMissingColumns=True)


@query(PARTS + """, d AS (SELECT (year // 10) * 10 AS decade, speaker, p.gender, avg(observed / nullif(words / speakers, 0)) AS m FROM p JOIN t USING (debate_id) WHERE p.gender IS NOT NULL GROUP BY 1, 2, 3)
SELECT CAST(decade AS BIGINT) AS decade, gender, round(avg(m), 6) AS macro FROM d GROUP BY 1, 2""")
def att_decade_macro(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    both = by_speaker(s.where("gender is not null")).join(totals(s), "debate_id")
    norm = F.try_divide(F.col("observed"), F.col("words") / F.col("speakers"))
    decade = (F.floor(F.col("year") / 10) * 10).cast("long").alias("decade")
    return both.groupBy(decade, "speaker", "gender").agg(F.avg(norm).alias("m")).groupBy("decade", "gender").agg(F.round(F.avg("m"), 6).alias("macro"))


@query(PARTS + "SELECT gender, round(sum(norm * words) / sum(words) FILTER (norm IS NOT NULL), 6) AS mean FROM q GROUP BY gender")
def att_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return group_norms(speeches(spark, sf)).groupBy("gender").agg(F.round(weighted_mean(F.col("norm"), F.col("words")), 6).alias("mean"))


@query(PARTS + "SELECT gender, round(sum(observed) / sum(expected), 6) AS ratio FROM q GROUP BY gender")
def att_global_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return group_norms(speeches(spark, sf)).groupBy("gender").agg(F.round(F.try_divide(F.sum("observed"), F.sum("expected")), 6).alias("ratio"))
