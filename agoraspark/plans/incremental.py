"""Totals that a new year joins: a state for each year, merged when totals are asked for.

A year's state has its counts and the set of its ids, as bitmaps of 32,768 ids each. Adding a year reads that year alone
and writes that year's state, in place of what it had; totals read states only. Bitmaps of years are merged by `or`, so
distinct ids of any years are exact.

Edge cases: ids are whole numbers, best numbered from 1 (bitmaps of ids far apart hold little); null ids are counted as
rows and are in no set; a year without rows has no state, and loses the one it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.session import new_folder
from agoraspark.sources.tables import written_by
from agoraspark.views import table


def state_of(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """(bucket, ids, rows, amount): a row for each 32,768 ids that occur, with their counts; bucket null: those of no id."""
    bucket, bit = F.bitmap_bucket_number(F.col(key)), F.bitmap_bit_position(F.col(key))
    return rows.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("ids"), F.count("*").alias("rows"), F.sum(amount).alias("amount"))


def add_year(source: str, folder: str, year: int, spark: SparkSession, key: str, amount: str) -> DataFrame:
    """Writes the state of one year of a table that is partitioned by year; gives what has been read, for its plan."""
    rows = spark.read.parquet(f"{source}/year={year}").select(key, amount)
    state_of(rows, key, amount).write.mode("overwrite").parquet(f"{folder}/year={year}")
    return rows


def by_year(spark: SparkSession, folder: str) -> DataFrame:
    """(year, rows, amount, ids, ids_so_far, new_ids) of every year that has a state: ids of the year, of all years up to it,
    and those that no year before had."""
    s = spark.read.parquet(folder)
    sums = s.groupBy("year").agg(F.sum("rows").alias("rows"), F.sum("amount").alias("amount"))
    # A bucket's bitmap of all years so far; years that lack the bucket keep the last one, so a year tells what it adds.
    w = Window.partitionBy("bucket").orderBy("year")
    held = s.where("bucket is not null").select("year", F.bitmap_count("ids").alias("own"), F.bitmap_count(F.bitmap_or_agg("ids").over(w)).alias("upto"), "bucket")
    held = held.withColumn("new", F.col("upto") - F.coalesce(F.lag("upto").over(w), F.lit(0)))
    sets = held.groupBy("year").agg(F.sum("own").alias("ids"), F.sum("new").alias("new_ids"))
    both = sums.join(sets, "year", "left").na.fill(0, ["ids", "new_ids"])
    so_far = F.sum("new_ids").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0))  # a row a year
    return both.select(F.col("year").cast("long").alias("year"), "rows", "amount", "ids", so_far.alias("ids_so_far"), "new_ids")


def distinct_ids(spark: SparkSession, folder: str, years: tuple[int, int]) -> int:
    """How many ids the years from the first to the last have together."""
    s = spark.read.parquet(folder).where(F.col("year").between(*years) & F.col("bucket").isNotNull())
    return s.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("ids")).alias("n")).agg(F.sum("n")).first()[0] or 0


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), f AS (SELECT o_custkey, min(year) AS first_year FROM o GROUP BY 1),
n AS (SELECT first_year AS year, count(*) AS new_ids FROM f GROUP BY 1), y AS (SELECT year, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS amount, count(DISTINCT o_custkey) AS ids FROM o GROUP BY 1)
SELECT year, n_rows AS rows, amount, ids, CAST(sum(coalesce(new_ids, 0)) OVER (ORDER BY year) AS BIGINT) AS ids_so_far, coalesce(new_ids, 0) AS new_ids FROM y LEFT JOIN n USING (year)""")
def agg_incremental_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by year from states that were added one year at a time."""
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    source, folder = written_by(orders, new_folder(spark, "orders"), "year", key="o_custkey"), new_folder(spark, "states")
    for r in orders.select("year").distinct().orderBy("year").collect():
        add_year(source, folder, r["year"], spark, "o_custkey", "cents")
    return by_year(spark, folder)
