"""Windows and order-sensitive operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import SPEECHES, speeches, table


def in_debate() -> WindowSpec:
    return Window.partitionBy("debate_id").orderBy("sequence_number")


def latest(df: DataFrame, by: list[str], *order: object) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


@query(SPEECHES + "SELECT speech_id, CAST(row_number() OVER (PARTITION BY debate_id ORDER BY sequence_number) AS BIGINT) AS n FROM s")
def win_sequence_number(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).select("speech_id", F.row_number().over(in_debate()).cast("long").alias("n"))


@query(SPEECHES + """SELECT speech_id, string_agg('[' || speaker || ']: ' || substr(text, 1, 50), '|') OVER w AS context,
CAST(count(*) OVER (PARTITION BY debate_id ORDER BY sequence_number ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_before FROM s
WINDOW w AS (PARTITION BY debate_id ORDER BY sequence_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def win_context_window(spark: SparkSession, sf: str) -> DataFrame:
    piece = F.concat(F.lit("["), "speaker", F.lit("]: "), F.substring("text", 1, 50))
    around = F.array_join(F.collect_list(piece).over(in_debate().rowsBetween(-2, 2)), "|")
    return speeches(spark, sf).select("speech_id", around.alias("context"), F.count("*").over(in_debate().rowsBetween(-2, -1)).alias("n_before"))


@query(SPEECHES + """SELECT speech_id, coalesce(string_agg(sequence_number, ',') OVER (PARTITION BY debate_id ORDER BY sequence_number ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS preceding,
coalesce(string_agg(sequence_number, ',') OVER (PARTITION BY debate_id ORDER BY sequence_number ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS following FROM s""")
def win_context_split(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda a, b: F.array_join(F.transform(F.collect_list("sequence_number").over(in_debate().rowsBetween(a, b)), lambda x: x.cast("string")), ",")
    return speeches(spark, sf).select("speech_id", side(-5, -1).alias("preceding"), side(1, 5).alias("following"))


@query("""WITH r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), k AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY n DESC) AS k FROM r)
SELECT source, min(lang) AS lang, CAST(max(n) AS BIGINT) AS n, count(*) > 1 AS ambiguous FROM k WHERE k = 1 GROUP BY source""")
def win_dense_rank_best(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    k = r.withColumn("k", F.dense_rank().over(Window.partitionBy("source").orderBy(F.col("n").desc()))).where("k = 1")
    return k.groupBy("source").agg(F.min("lang").alias("lang"), F.max("n").alias("n"), (F.count("*") > 1).alias("ambiguous"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def win_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice").desc(), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def win_dedupe_newest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id")


@query(SPEECHES + "SELECT speech_id, round(word_count / nullif(sum(word_count) OVER (PARTITION BY debate_id), 0), 6) AS part FROM s")
def win_share_transform(spark: SparkSession, sf: str) -> DataFrame:
    part = F.try_divide(F.col("word_count"), F.sum("word_count").over(Window.partitionBy("debate_id")))
    return speeches(spark, sf).select("speech_id", F.round(part, 6).alias("part"))


def expanded(turns: DataFrame, debate: str = "debate_id", order: str = "sequence_number", speaker: str = "speaker") -> DataFrame:
    """turns with short forms of speakers made whole: within a debate, "X" becomes the last "X (Y)" that came before. The
    running state of (debate, X) is a window of its own, so a long debate is as many groups as it has speakers."""
    named = F.trim(F.regexp_replace(F.trim(F.col(speaker)), r"\s+", " "))
    full = F.contains(named, F.lit("(")) & F.contains(named, F.lit(")"))
    rows = turns.withColumn("_named", named).withColumn("_short", F.when(full, F.trim(F.split_part(named, F.lit("("), F.lit(1)))).otherwise(named))
    w = Window.partitionBy(debate, "_short").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.contains("_named", F.lit("(")) & F.contains("_named", F.lit(")")), F.col("_named")), ignorenulls=True).over(w)
    return rows.withColumn(speaker, F.coalesce(last, "_named")).drop("_named", "_short")


@query(SPEECHES + r""", t AS (SELECT debate_id, sequence_number, speech_id, CASE sequence_number % 4 WHEN 1 THEN ' The  ' || speaker || '   (Member for ' || word_count % 7 || ')' ELSE 'The ' || speaker END AS speaker FROM s),
n AS (SELECT *, trim(regexp_replace(trim(speaker), '\s+', ' ', 'g')) AS named FROM t), k AS (SELECT *, trim(string_split(named, '(')[1]) AS short FROM n)
SELECT speech_id, coalesce(last_value(CASE WHEN contains(named, '(') THEN named END IGNORE NULLS) OVER (PARTITION BY debate_id, short ORDER BY sequence_number), named) AS speaker FROM k""")
def win_expand_short_speaker(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("sequence_number")
    named = F.when(n % 4 == 1, F.concat(F.lit(" The  "), "speaker", F.lit("   (Member for "), F.col("word_count") % 7, F.lit(")"))).otherwise(F.concat(F.lit("The "), "speaker"))
    return expanded(speeches(spark, sf).withColumn("speaker", named)).select("speech_id", "speaker")



@query("""SELECT o_orderkey, CAST(date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS BIGINT) AS gap FROM orders""")
def win_lag_gap(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.datediff(F.lead("o_orderdate").over(w), "o_orderdate").cast("long").alias("gap"))


@query(SPEECHES + "SELECT debate_id, arg_min(speaker, sequence_number) AS opener FROM s GROUP BY debate_id")
def win_first_row_of_group(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).groupBy("debate_id").agg(F.min_by("speaker", "sequence_number").alias("opener"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents d JOIN labels USING (doc_id) GROUP BY 1, 2),
m AS (SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) WHERE k = 1)
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.lang ELSE m.lang END AS lang, CASE WHEN l.doc_id IS NOT NULL THEN 'own' WHEN m.lang IS NOT NULL THEN 'propagated' END AS label
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN m USING (source)""")
def win_propagate_person(spark: SparkSession, sf: str) -> DataFrame:
    """What is missing comes from the most frequent value of the same person: fills nulls only, and says so."""
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(known, "doc_id", "left")
    modal = d.where("known").groupBy("source").agg(F.mode("lang", deterministic=True).alias("modal"))
    out = d.join(modal, "source", "left")
    label = F.when(F.col("known"), "own").when(F.col("modal").isNotNull(), "propagated")
    return out.select("doc_id", F.when(F.col("known"), F.col("lang")).otherwise(F.col("modal")).alias("lang"), label.alias("label"))


def near_words(docs: DataFrame, first: str, second: list[str], before: int = 25, after: int = 24) -> DataFrame:
    """(doc_id, pos, hit_at): words that contain `first` with a word that contains any of `second` within the window;
    hit_at is the earliest. Only words of either kind are rows, so the join is narrow."""
    words = F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("pos", "word")
    is_first = F.contains("word", F.lit(first))
    is_second = F.exists(F.array(*[F.lit(t) for t in second]), lambda t: F.contains("word", t))
    w = docs.select("doc_id", words).select("doc_id", "pos", is_first.alias("a"), is_second.alias("b")).where("a or b")
    span = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-before, after)
    hit = F.min(F.when(F.col("b"), F.col("pos"))).over(span)
    return w.select("doc_id", "pos", "a", hit.alias("hit_at")).where("a and hit_at is not null").drop("a")


PROXIMITY = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM l),
h AS (SELECT a.doc_id, a.pos, min(b.pos) AS hit_at FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 25 AND a.pos + 24
  WHERE contains(a.word, 'idiot') AND (contains(b.word, 'worth') OR contains(b.word, 'stupid') OR contains(b.word, 'loser')) GROUP BY 1, 2)
"""
STEMS = ["worth", "stupid", "loser"]


@query(PROXIMITY + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY doc_id")
def win_proximity_words(spark: SparkSession, sf: str) -> DataFrame:
    return near_words(table(spark, sf, "documents"), "idiot", STEMS).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(PROXIMITY + "SELECT doc_id, CAST(min(pos) AS BIGINT) AS pos, CAST(arg_min(hit_at, pos) AS BIGINT) AS hit_at, CAST(arg_min(abs(hit_at - pos), pos) AS BIGINT) AS distance FROM h GROUP BY doc_id")
def win_proximity_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    h = near_words(table(spark, sf, "documents"), "idiot", STEMS)
    first = h.groupBy("doc_id").agg(F.min(F.struct("pos", "hit_at")).alias("x"))
    return first.select("doc_id", F.col("x.pos").cast("long").alias("pos"), F.col("x.hit_at").cast("long").alias("hit_at"), F.abs(F.col("x.hit_at") - F.col("x.pos")).cast("long").alias("distance"))
