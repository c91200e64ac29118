"""Operator 1, line dedup: a suffix array over line-ID sequences by distributed prefix doubling, DataFrame only.

Every text is a sequence of lines, every line an ID of 128 bits. Level h names each position by the rank of its next h
lines; level 2h ranks the pairs (name at p, name at p + h). Only positions whose name occurs again can agree further, so
each level carries these alone: a position that drops out has its final place. Names are ranks: the distinct pairs in
sorted order, each with the first position, by (doc_id, document, position), that bears it.
A name held by several positions is an interval of the suffix array whose longest common prefix is h lines or more. At
the deepest level at which a position is not the first of its interval, it copies the first there. Consecutive positions
that do so at one level, each one line further in the same first copy, are one run, from the first of them to the last
plus h lines; runs that lie within another go, and those left are the maximal repeated runs. Runs of `min_lines` lines,
or of `min_words` words, are deleted from all but their first copy.

Groups are found by counting names with partial sums, and names come back by joins that adaptive execution can split,
so a line that fills a third of all rows needs no task of its own.

Edge cases: null and empty texts have no lines and stay; lines are compared whole, blank ones too; rows that agree in
doc_id and text are one document and get one result each; null doc_ids sort first; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.llm.common import fingerprint, saved, small, table

MIN_LINES, MIN_WORDS = 3, 50
WORD = r"[^\x20\x09-\x0D]+"


def lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def named(at: DataFrame, *names: str) -> DataFrame:
    """at (key, doc_id, pos, words, names...), those whose names occur again, with rank for names, an order-preserving
    number, and first: the first position (doc_id, key, pos) of the rank."""
    first = F.min(F.struct("doc_id", "key", "pos")).alias("first")
    again = at.groupBy(*names).agg(F.count("*").alias("_n"), first).where("_n > 1").drop("_n")
    ranks = saved(again.orderBy(*names).withColumn("rank", F.monotonically_increasing_id()))
    return saved(at.join(ranks, list(names)).select("key", "doc_id", "pos", "words", "rank", "first"))


def suffix_levels(at: DataFrame, min_lines: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The interval members at depth min_lines, and (depth, members) of every level until no name occurs again.

    at: (key, doc_id, pos, words, id). Members: (key, doc_id, pos, words, rank, first); words: those of its lines, 0 where
    at has none.
    """
    at = at if "words" in at.columns else at.withColumn("words", F.lit(0))
    level, depth, levels, wanted = named(at, "id"), 1, [], None
    while not level.isEmpty():
        levels.append((depth, level))
        if wanted is None and depth <= min_lines <= 2 * depth:
            wanted = paired(level, min_lines - depth) if min_lines > depth else level
        level, depth = paired(level, depth), 2 * depth
    return (level if wanted is None else wanted), levels


def paired(level: DataFrame, ahead: int) -> DataFrame:
    """The level `ahead` lines deeper; ahead is at most the depth of level. Of overlapping pairs words is no sum, but more."""
    then = level.select("key", (F.col("pos") - ahead).alias("pos"), F.col("rank").alias("rank2"), F.col("words").alias("more"))
    pairs = level.drop("first").withColumnRenamed("rank", "rank1").join(then, ["key", "pos"])
    return named(pairs.withColumn("words", F.col("words") + F.col("more")).drop("more"), "rank1", "rank2")


def runs(wanted: DataFrame, levels: list[tuple[int, DataFrame]], min_lines: int, min_words: int) -> DataFrame:
    """(key, start, end, depth, first): the maximal runs of lines that copy earlier ones, end exclusive; first: the
    position (doc_id, key, pos) that the run's first line copies; depth: the level that found it."""
    used = [(min_lines, wanted)] + [(d, m if d > min_lines else m.where(F.col("words") >= min_words)) for d, m in levels if d != min_lines]
    mark = lambda d, m: m.select("key", "pos", F.struct(F.lit(d).alias("depth"), "first").alias("copy"), "doc_id")
    every = reduce(DataFrame.union, [mark(d, m) for d, m in used])
    own = F.col("copy.first.key").eqNullSafe(F.col("key")) & (F.col("copy.first.pos") == F.col("pos"))
    best = every.where(~own).groupBy("key", "pos").agg(F.max_by("copy", "copy.depth").alias("copy"))
    best = best.select("key", "pos", "copy.depth", "copy.first", (F.col("copy.first.pos") - F.col("pos")).alias("shift"))
    w = Window.partitionBy("key").orderBy("pos")
    goes_on = reduce(lambda a, b: a & b, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("depth", "shift", "first.key")]) & (F.lag("pos").over(w) == F.col("pos") - 1)
    opens = best.withColumn("opens", F.when(goes_on, 0).otherwise(1))
    numbered = opens.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("key", "run").agg(F.min("pos").alias("start"), (F.max("pos") + F.first("depth")).alias("end"), F.first("depth").alias("depth"), F.min_by("first", "pos").alias("first"))
    before = Window.partitionBy("key").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(before)).where("reach is null or end > reach").drop("reach", "run")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_doc, start, end, depth, first): the runs to delete of each document; _doc: 128 bits of key and text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    # Documents are numbered, so that nothing below hangs on a hash of them.
    named_docs = rows.select("doc_id", fingerprint("doc_id", "text").alias("_doc"), F.transform(lines(F.col("text")), lambda x: F.struct(F.unhex(F.md5(x)).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines"))
    named_docs = saved(named_docs.dropDuplicates(["_doc"]).withColumn("key", F.monotonically_increasing_id()))
    at = named_docs.select("key", "doc_id", F.posexplode("lines").alias("pos", "line")).select("key", "doc_id", "pos", "line.words", "line.id")
    wanted, levels = suffix_levels(at, min_lines)
    return named_docs.select("key", "_doc").join(runs(wanted, levels, min_lines, min_words), "key").drop("key")


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, text, n_lines, n_removed, n_runs, kept (the text without its later copies) of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = repeated_runs(docs, min_lines, min_words, key, text).groupBy("_doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    out = rows.withColumn("_doc", fingerprint("doc_id", "text")).join(small(saved(found)), "_doc", "left")
    every = lines(F.col("text"))
    kept = F.filter(every, lambda _, i: ~F.exists("runs", lambda r: (r["start"] <= i) & (i < r["end"])))
    out = out.withColumn("lines", F.when(F.col("runs").isNotNull(), kept)).withColumn("n_lines", F.size(every).cast("long"))
    return out.select(
        F.col("doc_id").alias(key), "text", "n_lines",
        F.when(F.col("runs").isNull(), 0).otherwise(F.col("n_lines") - F.size("lines")).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
        F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("lines", "\n")).alias("kept"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept").alias("kept_md5"))
