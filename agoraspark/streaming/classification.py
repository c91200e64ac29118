"""Asking an outside model about rows as they arrive, so that no answer is lost or asked for twice.

A stream reads new files; its checkpoint knows which it has seen. Every micro-batch is asked in rounds of `calls` times
`batch` rows, and each round's answers are written as a table of their own before the next begins. Rows whose key has an
answer are not asked again, so a run that was killed, whatever it was at, loses one round at most, and its successor asks
what is open. Rows that come again, in the same or a later file, are dropped: by the answers, and before that, if rows have
a time, within its watermark.

Edge cases: a null text is asked like any other; a null key is left out; what fails after its retries is a row with its
error, which is asked again by the next run if `again` says so; no files, no answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraspark.plans.linkage import _stub, classify
from agoraspark.registry import query
from agoraspark.session import new_folder, ship
from agoraspark.views import SPEECHES, speeches

#: Rows that one task asks about, and tasks that ask at a time.
BATCH, CALLS = 50, 4


def answers(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All answers so far, each key once: an answer before an error."""
    try:
        found = spark.read.schema(schema).parquet(f"{folder}/answers")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    key, rest = schema.fieldNames()[0], schema.fieldNames()[1:]
    best = found.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("error").isNotNull()).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def answered(
    spark: SparkSession, source: str, schema: StructType, folder: str, client: Callable[[str | None], dict], fields: str, key: str = "speech_id",
    time: str | None = None, watermark: str = "1 day", batch: int = BATCH, calls: int = CALLS, retries: int = 3, wait: float = 0.5, again: bool = False, files: int = 16,
) -> DataFrame:
    """The answers about all rows (key, text, ...) of the parquet files below source, after those that are there by now have
    been asked about. fields: what client(text) gives, as column definitions."""
    ship(spark)
    kind = schema[key].dataType.simpleString()
    out = StructType.fromDDL(f"{key} {kind}, {fields}, error string")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).where(F.col(key).isNotNull())
    if time:
        rows = rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])

    def ask(part: DataFrame, number: int) -> None:
        session = part.sparkSession
        done = answers(session, folder, out)
        done = done if not again else done.where("error is null")
        waiting = part.select(key, "text").dropDuplicates([key]).join(done.select(key), key, "left_anti")
        path = f"{folder}/waiting/{number}"
        waiting.write.mode("overwrite").parquet(path)
        waiting = session.read.schema(waiting.schema).parquet(path)
        rounds = -(-waiting.count() // (batch * calls))
        for n in range(rounds):
            some = waiting.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == n)
            classify(some, client, fields, key, retries=retries, calls=calls, wait=wait).write.mode("append").parquet(f"{folder}/answers")

    stream = rows.writeStream.foreachBatch(ask).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return answers(spark, folder, out)


@query(SPEECHES + "SELECT speech_id, CASE WHEN length(text) % 2 = 1 THEN 'for' ELSE 'against' END AS stance, 0.5::DOUBLE AS confidence FROM s")
def llm_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Speeches as they arrive, with a stub for the outside model."""
    source, folder = new_folder(spark, "arrived"), new_folder(spark, "answers")
    rows = speeches(spark, sf).select("speech_id", "text")
    rows.write.parquet(source)
    return answered(spark, source, rows.schema, folder, _stub, "stance string, confidence double", calls=8, batch=5000).select("speech_id", "stance", "confidence")
