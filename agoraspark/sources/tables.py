"""Reading and writing: partitioned tables, JSON lines, CSV, compressed pages, exports, search tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.operators.filters import matching
from agoraspark.operators.ordering import sample
from agoraspark.registry import query
from agoraspark.session import new_folder
from agoraspark.views import DOCUMENTS, SPEECHES, documents, speeches, table


#: Rows in one file of a partitioned table, at most.
FILE_ROWS = 1_000_000


def written_by(df: DataFrame, folder: str, *by: str, key: str) -> str:
    """Writes df as a table partitioned by `by`: rows are dealt by ranges of (by..., key), so a large part is written by
    many tasks, and a small one by few."""
    df.repartitionByRange(*by, key).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(folder)
    return folder


def _by_year(spark: SparkSession, sf: str) -> str:
    """The speeches as a table partitioned by year, written anew, as the input may have changed."""
    return written_by(speeches(spark, sf), new_folder(spark, "speeches"), "year", key="speech_id")


def load_speeches(spark: SparkSession, folder: str, years: tuple[int, int] | None = None, gender: str | None = None, chamber: str | None = None, n: int | None = None) -> DataFrame:
    """Speeches of a table partitioned by year; years prunes partitions. n: so many, drawn."""
    found = matching(spark.read.parquet(folder), year=years, gender=gender.upper() if gender else None, chamber=chamber)
    return sample(found, n, "speech_id") if n else found


SOURCES = {"speeches": speeches, "documents": documents, "pages": lambda s, d: table(s, d, "pages")}


def load(spark: SparkSession, sf: str, source: str, years: tuple[int, int] | None = None, text: bool = True) -> DataFrame:
    """A source by name."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}; there are {', '.join(SOURCES)}")
    found = SOURCES[source](spark, sf)
    found = matching(found, year=years) if years and "year" in found.columns else found
    return found if text else found.drop("text", "html")


def export(df: DataFrame, folder: str, kind: str) -> DataFrame:
    """Writes df as csv, json or parquet and reads it again."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {kind}")
    writer = df.write.option("header", True).option("escape", '"') if kind == "csv" else df.write
    writer.format(kind).save(folder)
    reader = df.sparkSession.read.schema(df.schema)
    return (reader.option("header", True).option("escape", '"').option("multiLine", True) if kind == "csv" else reader).format(kind).load(folder)


@query(SPEECHES + "SELECT speech_id, CAST(year AS BIGINT) AS year FROM s WHERE year BETWEEN 1910 AND 1915 AND gender = 'F'")
def scan_year_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    return load_speeches(spark, _by_year(spark, sf), (1910, 1915), "f").select("speech_id", F.col("year").cast("long").alias("year"))


@query(SPEECHES + "SELECT debate_id, min(year) AS year, CAST(count(*) AS BIGINT) AS n FROM s WHERE chamber = 'Lords' GROUP BY debate_id")
def scan_debates(spark: SparkSession, sf: str) -> DataFrame:
    found = load_speeches(spark, _by_year(spark, sf), chamber="Lords")
    return found.groupBy("debate_id").agg(F.min("year").cast("long").alias("year"), F.count("*").alias("n"))


@query(DOCUMENTS + "SELECT doc_id, year FROM d WHERE year BETWEEN 1804 AND 1805")
def scan_unified_sources(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents", (1804, 1805), text=False).select("doc_id", "year")


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def scan_jsonl_by_key(spark: SparkSession, sf: str) -> DataFrame:
    lines = export(table(spark, sf, "documents").select("doc_id", "lang", "text"), new_folder(spark, "jsonl"), "json")
    return lines.where("doc_id = 7").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents")
def scan_column_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    return export(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), new_folder(spark, "csv"), "csv")


@query("SELECT conv_id, role, CAST(turn AS BIGINT) AS turn FROM conversations")
def scan_json_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "turn")).alias("memberships"))
    return export(nested, new_folder(spark, "nested"), "json").select("conv_id", F.inline("memberships"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id")
def scan_annotations_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of an id wins."""
    lines = export(table(spark, sf, "events").select("event_id", "user_id", "event_type"), new_folder(spark, "notes"), "json")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))
    return lines.withColumn("k", last).where("k = 1").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"))


@query(SPEECHES + "SELECT year, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY year")
def cache_year_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is asked again is read from the written table."""
    by_year = spark.read.parquet(_by_year(spark, sf)).groupBy("year").agg(F.sum(F.length("text")).alias("chars"))
    return by_year.select(F.col("year").cast("long").alias("year"), "chars")


@query(DOCUMENTS + "SELECT year, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY year")
def sink_parquet_by_year(spark: SparkSession, sf: str) -> DataFrame:
    folder = written_by(documents(spark, sf), new_folder(spark, "by-year"), "year", key="doc_id")
    return spark.read.parquet(folder).groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query(DOCUMENTS + "SELECT doc_id, year FROM d")
def sink_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """One table, sorted over all files."""
    folder = new_folder(spark, "master")
    documents(spark, sf).select("doc_id", "year").orderBy("year", "doc_id").write.parquet(folder)
    return spark.read.parquet(folder)


@query("SELECT doc_id, lang, text FROM documents WHERE lang = 'es'")
def sink_export_format(spark: SparkSession, sf: str) -> DataFrame:
    return export(table(spark, sf, "documents").where("lang = 'es'").select("doc_id", "lang", "text"), new_folder(spark, "export"), "parquet")


@query(SPEECHES + "SELECT decade, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY decade")
def sink_json_compact_gz(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed JSON by decade, and a manifest of counts."""
    folder = new_folder(spark, "json")
    speeches(spark, sf).select("decade", "speech_id", "year").write.partitionBy("decade").option("compression", "gzip").json(folder)
    kept = spark.read.schema("speech_id string, year long, decade long").json(folder)
    return kept.groupBy("decade").agg(F.count("*").alias("n"))


@query(SPEECHES + "SELECT CASE WHEN year < 1918 THEN 'early' ELSE 'late' END AS period, CAST(sum(word_count) AS BIGINT) AS words FROM s GROUP BY 1")
def sink_csv_by_group(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "periods")
    s = speeches(spark, sf).withColumn("period", F.when(F.col("year") < 1918, "early").otherwise("late"))
    s.select("period", "speech_id", "word_count").write.partitionBy("period").option("header", True).csv(folder)
    kept = spark.read.option("header", True).schema("speech_id string, word_count long, period string").csv(folder)
    return kept.groupBy("period").agg(F.sum("word_count").alias("words"))


@query(SPEECHES + "SELECT speech_id, substr(speaker, 1, 60) AS speaker, substr(text, 1, 80) AS title, word_count FROM s")
def sink_sqlite_meta(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "meta")
    short = speeches(spark, sf).select("speech_id", F.substring("speaker", 1, 60).alias("speaker"), F.substring("text", 1, 80).alias("title"), "word_count")
    short.write.parquet(folder)
    return spark.read.parquet(folder)
