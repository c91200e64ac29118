"""Sorting, limits and reproducible samples. A draw is the order of md5(seed|id), the same in any engine."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import DOCUMENTS, SPEECHES, documents, speeches, table


def draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, key)).limit(n)


def stratified(df: DataFrame, by: list[str], quota: Column, key: str, seed: int = 42) -> DataFrame:
    """Of each stratum the first `quota` rows of the draw; the rank limit is applied before the shuffle."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key)))
    return df.withColumn("_k", k).where(F.col("_k") <= quota).drop("_k")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with place, from 1: a reproducible shuffle. The draw's first three digits cut it in 4096 runs; rows are numbered
    within a run, and the runs' counts, one row each, give its start: no task takes the whole table."""
    at = df.withColumn("_draw", draw(seed, key)).withColumn("_run", F.substring("_draw", 1, 3))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = at.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_run").orderBy("_draw", key))
    placed = at.withColumn("_k", within).join(F.broadcast(runs), "_run")  # 4096 rows at most
    return placed.withColumn("place", (F.col("_start") + F.col("_k")).cast("long")).drop("_draw", "_run", "_k", "_start")


def page(df: DataFrame, number: int, size: int, *order: object) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def sample_size(population: int, margin: float = 0.05, z: float = 1.96, p: float = 0.5) -> int:
    """Cochran's size with the finite-population correction."""
    n0 = z * z * p * (1 - p) / margin**2
    return ceil(n0 / (1 + (n0 - 1) / population)) if population else 0


def neyman(strata: list[tuple[str, int, float]], total: int, floor: int = 10) -> dict[str, int]:
    """Sample sizes by size times standard deviation, at least `floor`, never more than there are."""
    weight = {k: n * v**0.5 for k, n, v in strata}
    whole = sum(weight.values()) or 1.0
    return {k: min(n, max(floor, round(total * weight[k] / whole))) for k, n, _ in strata}


@query(DOCUMENTS + "SELECT doc_id, word_count FROM d ORDER BY word_count DESC, doc_id LIMIT 20")
def sort_topk(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "word_count").orderBy(F.col("word_count").desc(), "doc_id").limit(20)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def sort_abs_desc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(25)


@query(SPEECHES + "SELECT speech_id, year FROM s ORDER BY year, debate_id, sequence_number LIMIT 10 OFFSET 20")
def limit_offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return page(speeches(spark, sf), 2, 10, "year", "debate_id", "sequence_number").select("speech_id", "year")


@query(SPEECHES + "SELECT speech_id FROM s WHERE contains(lower(text), 'the') ORDER BY year, debate_id, sequence_number LIMIT 15")
def limit_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    found = speeches(spark, sf).where(F.contains(F.lower("text"), F.lit("the")))
    return found.orderBy("year", "debate_id", "sequence_number").limit(15).select("speech_id")


@query("SELECT o_custkey, bool_and(coalesce(o_totalprice >= before, true)) AS sorted FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY 1")
def sort_chrono_check(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select("o_custkey", F.coalesce(F.col("o_totalprice") >= before, F.lit(True)).alias("up"))
    return o.groupBy("o_custkey").agg(F.bool_and("up").alias("sorted"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id) LIMIT 50")
def sample_random_n(spark: SparkSession, sf: str) -> DataFrame:
    return sample(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("""WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS k, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang FROM t WHERE k <= greatest(1, floor(100 * n / total))""")
def sample_stratified_prop(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    sizes = d.groupBy("lang").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    quotas = sizes.crossJoin(total).select("lang", F.greatest(F.lit(1), F.floor(F.lit(100) * F.col("n") / F.col("total"))).alias("quota"))
    return stratified(d.join(quotas, "lang"), ["lang"], F.col("quota"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 20 ELSE 5 END")
def sample_stratified_quota(spark: SparkSession, sf: str) -> DataFrame:
    quota = F.when(F.col("lang") == "en", 30).when(F.col("lang") == "fr", 20).otherwise(5)
    return stratified(table(spark, sf, "documents"), ["lang"], quota, "doc_id").select("doc_id", "lang")


@query("""WITH a AS (SELECT doc_id, 'mandatory' AS part FROM labels WHERE toxic = 1 AND quality = 0), r AS (SELECT * FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM a)),
b AS (SELECT doc_id, 'rest' AS part FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id)) AS k FROM r) WHERE k <= 20)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def sample_oversample_then_prop(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels")
    must = rows.where("toxic = 1 and quality = 0")
    rest = stratified(rows.join(must.select("doc_id"), "doc_id", "left_anti"), ["quality"], F.lit(20), "doc_id")
    return must.select("doc_id", F.lit("mandatory").alias("part")).unionByName(rest.select("doc_id", F.lit("rest").alias("part")))


@query("""WITH v AS (SELECT lang, count(*) AS n, count(*) * sqrt(var_samp(n_chars)) AS w FROM documents GROUP BY lang),
q AS (SELECT lang, least(n, greatest(10, round(120 * w / sum(w) OVER ()))) AS quota FROM v)
SELECT doc_id, lang FROM (SELECT d.doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42|' || doc_id)) AS k FROM documents d JOIN q USING (lang)) WHERE k <= quota""")
def sample_neyman(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    strata = [tuple(r) for r in d.groupBy("lang").agg(F.count("*"), F.var_samp("n_chars")).collect()]  # a row a stratum
    quotas = spark.createDataFrame(list(neyman(strata, 120).items()), "lang string, quota long")
    return stratified(d.join(quotas, "lang"), ["lang"], F.col("quota"), "doc_id").select("doc_id", "lang")


@query("SELECT CAST(ceil(384.16 / (1 + (384.16 - 1) / count(*))) AS BIGINT) AS n FROM documents")
def sample_size_fpc(spark: SparkSession, sf: str) -> DataFrame:
    n0 = F.lit(1.96 * 1.96 * 0.25 / 0.05**2)
    return table(spark, sf, "documents").agg(F.ceil(n0 / (1 + (n0 - 1) / F.count("*"))).cast("long").alias("n"))


@query(SPEECHES + "SELECT speech_id, gender FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY md5('42|' || speech_id)) AS k FROM s WHERE gender IS NOT NULL) WHERE k <= 25")
def sample_balanced_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return stratified(speeches(spark, sf).where("gender is not null"), ["gender"], F.lit(25), "speech_id").select("speech_id", "gender")


@query("""WITH f AS (SELECT doc_id FROM labels WHERE toxic = 1), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY md5('42|' || doc_id) LIMIT 60)
SELECT doc_id FROM f UNION ALL SELECT doc_id FROM r""")
def sample_forced_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    forced = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    others = table(spark, sf, "documents").select("doc_id").join(forced, "doc_id", "left_anti")
    return forced.union(sample(others, 60, "doc_id"))


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY md5('42|' || n_nationkey)) AS BIGINT) AS place FROM nation")
def shuffle_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey")
