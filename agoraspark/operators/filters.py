"""Filters and projections."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import DOCUMENTS, SPEECHES, documents, speeches, table


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """The rows that meet all given conditions; None sets none. Pairs are inclusive ranges, lists are choices."""
    tests: list[Column] = []
    for name, value in wanted.items():
        if isinstance(value, tuple):
            tests.append(F.col(name).between(*value))
        elif isinstance(value, list):
            tests.append(F.col(name).isin(value))
        elif value is not None:
            tests.append(F.col(name) == value)
    return df.where(reduce(and_, tests)) if tests else df


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is part of the text, whatever the case; null texts hold nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(or_, [F.contains(low, F.lit(t.lower())) for t in terms])


def bins(value: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """The label of the bin: closed on the right, or on the left if right is False; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = (value > low) & (value <= high) if right else (value >= low) & (value < high)
        out = F.when(inside, label).otherwise(out)
    return out


@query(SPEECHES + "SELECT speech_id, word_count FROM s WHERE chamber = 'Lords' AND gender = 'F'")
def filter_equality(spark: SparkSession, sf: str) -> DataFrame:
    return matching(speeches(spark, sf), chamber="Lords", gender="F").select("speech_id", "word_count")


@query(SPEECHES + "SELECT speech_id, year FROM s WHERE year BETWEEN 1905 AND 1912")
def filter_year_between(spark: SparkSession, sf: str) -> DataFrame:
    return matching(speeches(spark, sf), year=(1905, 1912)).select("speech_id", "year")


@query(SPEECHES + "SELECT speech_id, speaker FROM s WHERE year BETWEEN 1900 AND 1920 AND chamber = 'Commons' AND speaker IN ('user', 'system')")
def filter_optional_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    found = matching(speeches(spark, sf), year=(1900, 1920), chamber="Commons", gender=None, speaker=["user", "system"])
    return found.select("speech_id", "speaker")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')")
def filter_json_array_like(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return listed.where(F.exists("roles", lambda r: r == "system")).select("conv_id", F.size("roles").cast("long").alias("turns"))


@query(DOCUMENTS + "SELECT doc_id FROM d WHERE contains(lower(coalesce(text, '')), 'licensed under')")
def filter_substring_ci(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(contains_any(F.col("text"), ["Licensed under"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)idiot|moron')")
def filter_regex_ci(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").rlike("(?i)idiot|moron")).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER#0000001%' OR c_mktsegment ILIKE '%auto%'")
def filter_like_any(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.where(F.col("c_name").ilike("%CUSTOMER#0000001%") | F.col("c_mktsegment").ilike("%auto%")).select("c_custkey")


@query(SPEECHES + "SELECT speech_id FROM s WHERE gender IS NULL AND trim(text) <> ''")
def filter_null(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where(F.col("gender").isNull() & (F.trim("text") != "")).select("speech_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'es')")
def filter_isin(spark: SparkSession, sf: str) -> DataFrame:
    return matching(table(spark, sf, "documents"), lang=["fr", "es"]).select("doc_id")


@query(SPEECHES + "SELECT speech_id FROM s WHERE gender = 'F' AND word_count > 20")
def filter_dynamic_expr(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where("gender = 'F' and word_count > 20").select("speech_id")


@query(DOCUMENTS + "SELECT doc_id, word_count FROM d WHERE word_count >= 50")
def filter_min_words(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where("word_count >= 50").select("doc_id", "word_count")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'trash') OR contains(lower(text), 'token')")
def filter_any_term(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(contains_any(F.col("text"), ["license", "trash", "token"])).select("doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM documents")
def proj_truncate_preview(spark: SparkSession, sf: str) -> DataFrame:
    short = F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", short.alias("preview"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), url) AS name FROM pages")
def proj_coalesce_name(spark: SparkSession, sf: str) -> DataFrame:
    part = F.regexp_extract("url", "#(.*)$", 1)
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.nullif(part, F.lit("")), F.col("url")).alias("name"))


@query("SELECT DISTINCT o_orderkey, CAST((year(o_orderdate) // 10) * 10 AS BIGINT) AS decade FROM orders")
def proj_decade(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", (F.floor(F.year("o_orderdate") / 10) * 10).cast("long").alias("decade"))


@query(SPEECHES + """SELECT debate_id, round(CASE WHEN count(gender) > 0 THEN count(*) FILTER (gender = 'F') / count(gender) END, 6) AS ratio
FROM s GROUP BY debate_id""")
def proj_safe_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.try_divide(F.count_if(F.col("gender") == "F"), F.count("gender"))
    return speeches(spark, sf).groupBy("debate_id").agg(F.round(ratio, 6).alias("ratio"))


@query(DOCUMENTS + """SELECT doc_id, CASE WHEN word_count > 0 AND word_count <= 50 THEN 'short' WHEN word_count > 50 AND word_count <= 300 THEN 'medium'
WHEN word_count > 300 AND word_count <= 1000 THEN 'long' END AS size_bin, CASE WHEN n_chars >= 0 AND n_chars < 500 THEN 'a'
WHEN n_chars >= 500 AND n_chars < 5000 THEN 'b' END AS char_bin FROM d""")
def proj_bins_cut(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id",
        bins(F.col("word_count"), [0, 50, 300, 1000], ["short", "medium", "long"]).alias("size_bin"),
        bins(F.col("n_chars"), [0, 500, 5000], ["a", "b"], right=False).alias("char_bin"),
    )


@query(SPEECHES + """SELECT CASE WHEN year < 1918 THEN 'pre_1918' WHEN year <= 1928 THEN '1918_1928' ELSE 'post_1928' END AS period,
CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def proj_period_case(spark: SparkSession, sf: str) -> DataFrame:
    period = F.when(F.col("year") < 1918, "pre_1918").when(F.col("year") <= 1928, "1918_1928").otherwise("post_1928")
    return speeches(spark, sf).groupBy(period.alias("period")).agg(F.count("*").alias("n"))


@query(SPEECHES + "SELECT speech_id, coalesce(gender, '') AS gender FROM s")
def proj_fill_na(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).na.fill({"gender": ""}).select("speech_id", "gender")


@query("""SELECT conv_id, CAST(max(CASE WHEN role = 'user' THEN turn END) AS BIGINT) AS id_user, CAST(max(CASE WHEN role = 'assistant' THEN turn END) AS BIGINT) AS id_assistant
FROM conversations GROUP BY conv_id""")
def proj_widen_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("turn"))
    wide = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "turn"))).alias("ids"))
    return wide.select("conv_id", *[F.try_element_at("ids", F.lit(r)).cast("long").alias(f"id_{r}") for r in ("user", "assistant")])


def informative_columns(df: DataFrame) -> list[str]:
    """The columns that are not null everywhere nor the same, value by value, as one before: one aggregation over all."""
    marks = df.agg(*[F.struct(F.count(c).alias("n"), F.sum(F.xxhash64(F.lit(1), F.col(c).cast("string")).cast("decimal(38,0)")).alias("h")).alias(c) for c in df.columns]).first()
    seen, kept = set(), []
    for c in df.columns:
        mark = (df.schema[c].dataType.simpleString(), marks[c]["n"], marks[c]["h"])
        if marks[c]["n"] and mark not in seen:
            kept.append(c)
            seen.add(mark)
    return kept


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def proj_drop_all_null_cols(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumn("empty", F.lit(None).cast("string"))
    return n.select(*informative_columns(n))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def proj_drop_dup_cols(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumn("again", F.col("n_name"))
    return n.select(*informative_columns(n))
