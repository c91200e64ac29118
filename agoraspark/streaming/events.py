"""Extensions on events: windows of time, as batch queries and as streams, an as-of join, grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import SPEECHES, speeches, table


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; `late`, for streams: how long windows wait for stragglers."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "event_type", "n", F.round("total", 4).alias("total"))


def stream(spark: SparkSession, folder: str, schema: str, checkpoint: str, out: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Runs the windows over all files of a folder as a stream and gives what it has written."""
    rows = tumbling(spark.readStream.schema(schema).parquet(folder), width, late)
    done = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    done.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS begins, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    return tumbling(table(spark, sf, "events"), "1 day")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
x AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(count(DISTINCT k) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS events FROM x GROUP BY user_id""")
def ext_session_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("""SELECT e.event_id, o.event_id AS before_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) o
ON e.user_id = o.user_id AND e.ts >= o.ts WHERE e.event_type <> 'click'""")
def ext_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """The latest click of the same user: both sides in one sorted window, not a join."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "click").alias("click"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("click").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("click"), F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before_id", last).where("not click").select("event_id", "before_id")


@query(SPEECHES + "SELECT decade, gender, chamber, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY CUBE (decade, gender, chamber)")
def ext_cube(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).cube("decade", "gender", "chamber").agg(F.count("*").alias("n"))


@query()
def ext_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))
