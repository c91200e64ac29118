"""Set operations on rows and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.operators.windows import latest
from agoraspark.registry import query
from agoraspark.views import table


@query("SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").selectExpr("n_nationkey as id", "n_name as name")
    r = table(spark, sf, "region").selectExpr("r_regionkey as id", "r_name as name", "'region' as extra")
    return n.unionByName(r, allowMissingColumns=True)


@query("SELECT lang AS name FROM documents UNION SELECT source FROM documents")
def set_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.selectExpr("lang as name").union(d.select("source")).distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def set_distinct_subset(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each pair, always the same: the one with the smallest id."""
    return latest(table(spark, sf, "documents"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


@query("""SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders, CASE WHEN count(o_orderkey) > 0 THEN 'both' ELSE 'customer_only' END AS provenance
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def set_append_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    both = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders")).join(c, "c_custkey", "left_semi")
    alone = c.join(both, "c_custkey", "left_anti").select("c_custkey", F.lit(0).cast("long").alias("orders"), F.lit("customer_only").alias("provenance"))
    return both.withColumn("provenance", F.lit("both")).unionByName(alone)
