"""Checks of data quality and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import SPEECHES, STINTS, speeches, stints, table


def schema_findings(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str]]:
    """(column, finding): missing, unexpected, or the type that was found instead."""
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [(c, "missing") for c in expected if c not in got]
    out += [(c, "unexpected") for c in got if c not in expected]
    return out + [(c, f"{got[c]} instead of {t}") for c, t in expected.items() if c in got and got[c] != t]


@query("SELECT * FROM (VALUES ('title', 'missing'), ('n_chars', 'unexpected'), ('doc_id', 'bigint instead of string')) AS t(column_name, finding)")
def dq_schema_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = {"doc_id": "string", "text": "string", "lang": "string", "source": "string", "title": "string"}
    return spark.createDataFrame(schema_findings(table(spark, sf, "documents"), expected), "column_name string, finding string")


@query("SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS a, CAST((SELECT count(*) FROM labels) AS BIGINT) AS b, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS same")
def dq_cross_format(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of two stores of one thing."""
    a, b = (table(spark, sf, t).agg(F.count("*").alias(c)) for t, c in (("documents", "a"), ("labels", "b")))
    return a.crossJoin(b).withColumn("same", F.col("a") == F.col("b"))


@query("""SELECT round(avg(CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END), 6) AS with_text, round(avg(CASE WHEN contains(text, chr(10)) THEN 1.0 ELSE 0.0 END), 6) AS with_lines,
round(avg(CASE WHEN lang IN ('en', 'fr') THEN 1.0 ELSE 0.0 END), 6) AS known_lang FROM documents""")
def dq_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return table(spark, sf, "documents").agg(
        rate(F.length("text") > 0, "with_text"), rate(F.contains("text", F.lit("\n")), "with_lines"), rate(F.col("lang").isin("en", "fr"), "known_lang")
    )


@query("SELECT round(avg(length(c_name)), 6) AS mean_length, CAST(count(*) FILTER (regexp_matches(c_name, '#0000000')) AS BIGINT) AS titled FROM customer")
def dq_name_quality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").agg(F.round(F.avg(F.length("c_name")), 6).alias("mean_length"), F.count_if(F.col("c_name").rlike("#0000000")).alias("titled"))


@query("""WITH r AS (SELECT count(DISTINCT sha256(text)) / count(*) AS u, count(*) FILTER (lang = 'en') / count(*) AS e FROM documents)
SELECT unnest(list_filter([CASE WHEN u < 0.95 THEN 'remove duplicates' END, CASE WHEN e < 0.9 THEN 'detect languages' END, CASE WHEN e < 0.1 THEN 'check source' END], lambda x: x IS NOT NULL)) AS message FROM r""")
def dq_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "documents").agg((F.countDistinct(F.sha2("text", 256)) / F.count("*")).alias("u"), (F.count_if(F.col("lang") == "en") / F.count("*")).alias("e"))
    rules = F.array(F.when(F.col("u") < 0.95, "remove duplicates"), F.when(F.col("e") < 0.9, "detect languages"), F.when(F.col("e") < 0.1, "check source"))
    return r.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("message"))


@query(SPEECHES + "SELECT speech_id FROM s WHERE (speaker = 'user' AND gender IS DISTINCT FROM 'F') OR (speaker = 'system' AND gender IS DISTINCT FROM 'M')")
def dq_honorific_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """A form of address that goes with one gender and a record that has not that one."""
    goes_with = F.when(F.col("speaker") == "user", "F").when(F.col("speaker") == "system", "M")
    return speeches(spark, sf).where(goes_with.isNotNull() & ~F.col("gender").eqNullSafe(goes_with)).select("speech_id")


@query(STINTS + """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT EXISTS (SELECT 1 FROM m WHERE person_id = o_custkey AND l_shipdate >= begins AND l_shipdate < ends)""")
def dq_temporal_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of people of whom no span holds then: an anti join with a range beside its equal key."""
    facts = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    m = stints(spark, sf)
    holds = (F.col("o_custkey") == F.col("person_id")) & (F.col("l_shipdate") >= F.col("begins")) & (F.col("l_shipdate") < F.col("ends"))
    return facts.join(m, holds, "left_anti").select("l_orderkey", "l_linenumber")


@query(SPEECHES + "SELECT year, chamber, round(count(gender) / count(*), 6) AS rate FROM s GROUP BY 1, 2")
def dq_match_rate_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).groupBy("year", "chamber").agg(F.round(F.count("gender") / F.count("*"), 6).alias("rate"))


@query("""SELECT name, expected, actual, actual = expected AS ok FROM (SELECT 'nations' AS name, CAST(25 AS BIGINT) AS expected, CAST((SELECT count(*) FROM nation) AS BIGINT) AS actual
UNION ALL SELECT 'regions', 5, (SELECT count(*) FROM region) UNION ALL SELECT 'languages', 3, (SELECT count(DISTINCT lang) FROM documents))""")
def dq_expected_values(spark: SparkSession, sf: str) -> DataFrame:
    """Documented constants against what is there."""
    actual = (
        table(spark, sf, "nation").agg(F.lit("nations").alias("name"), F.lit(25).cast("long").alias("expected"), F.count("*").alias("actual"))
        .union(table(spark, sf, "region").agg(F.lit("regions"), F.lit(5).cast("long"), F.count("*")))
        .union(table(spark, sf, "documents").agg(F.lit("languages"), F.lit(3).cast("long"), F.countDistinct("lang")))
    )
    return actual.withColumn("ok", F.col("actual") == F.col("expected"))


def differing(a: DataFrame, b: DataFrame, key: str, ignore: tuple[str, ...] = (), rtol: float = 1e-9) -> DataFrame:
    """(key, column) of the values that differ between two versions, numbers beyond a relative tolerance."""
    shared = [c for c in a.columns if c in b.columns and c != key and c not in ignore]
    both = a.select(key, *[F.col(c).alias(f"a_{c}") for c in shared]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in shared]), key, "full")
    tests = []
    for c in shared:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = x.eqNullSafe(y)
        if a.schema[c].dataType.simpleString() in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= rtol * F.abs(y), F.lit(False))
        tests.append(F.when(~same, F.lit(c)))
    return both.select(key, F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("column"))


@query("SELECT c_custkey, 'c_acctbal' AS \"column\" FROM customer WHERE c_custkey % 10 = 3 AND c_acctbal <> 0")
def dq_repro_compare(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer")
    b = a.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, F.col("c_acctbal") * 1.01).otherwise(F.col("c_acctbal") * (1 + 1e-12)))
    return differing(a, b, "c_custkey")
