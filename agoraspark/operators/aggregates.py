"""Aggregations and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import DOCUMENTS, SPEECHES, documents, speeches, table



def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part, whole) * 100, digits)


@query(DOCUMENTS + """SELECT year, CAST(count(*) AS BIGINT) AS n, CAST(sum(word_count) AS BIGINT) AS words, round(avg(word_count), 6) AS mean_words,
CAST(count(DISTINCT lang) AS BIGINT) AS langs FROM d GROUP BY year""")
def agg_timeline_year(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(documents(spark, sf), "year")


def timeline(df: DataFrame, *by: str) -> DataFrame:
    """Documents, words and languages by year, or by year and month."""
    if by not in (("year",), ("year", "month")):
        raise ValueError(f"a timeline is by year or by year and month, not by {by}")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("word_count").alias("words"), F.round(F.avg("word_count"), 6).alias("mean_words"), F.countDistinct("lang").alias("langs")
    )


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1, 2""")
def agg_timeline_month(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    by = [F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")]
    return o.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(DOCUMENTS + """SELECT source, CAST(count(*) AS BIGINT) AS n, min(year) AS first_year, max(year) AS last_year, CAST(count(DISTINCT lang) AS BIGINT) AS langs
FROM d GROUP BY source ORDER BY n DESC, source LIMIT 10""")
def agg_top_speakers(spark: SparkSession, sf: str) -> DataFrame:
    by = documents(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("lang").alias("langs")
    )
    return by.orderBy(F.col("n").desc(), "source").limit(10)


@query(SPEECHES + """SELECT CAST(count(*) AS BIGINT) AS n, min(year) AS first_year, max(year) AS last_year, CAST(count(DISTINCT chamber) AS BIGINT) AS chambers,
round(avg(CASE WHEN gender IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS matched_rate FROM s""")
def agg_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).agg(
        F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("chamber").alias("chambers"),
        F.round(F.avg(F.col("gender").isNotNull().cast("double")), 6).alias("matched_rate"),
    )


@query(SPEECHES + """SELECT decade, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (gender = 'F') AS BIGINT) AS n_f, CAST(count(*) FILTER (gender = 'M') AS BIGINT) AS n_m,
CAST(sum(word_count) AS BIGINT) AS words, round(100.0 * count(*) FILTER (gender = 'F') / nullif(count(gender), 0), 2) AS pct_f FROM s GROUP BY decade""")
def agg_by_decade_gender(spark: SparkSession, sf: str) -> DataFrame:
    f, m = (F.count_if(F.col("gender") == g) for g in "FM")
    return speeches(spark, sf).groupBy("decade").agg(
        F.count("*").alias("n"), f.alias("n_f"), m.alias("n_m"), F.sum("word_count").alias("words"), share(f, F.count("gender"), 2).alias("pct_f")
    )


@query(SPEECHES + """SELECT chamber, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (gender IS NULL OR gender = 'None') AS BIGINT) AS unmatched,
CAST(sum(word_count) AS BIGINT) AS words FROM s GROUP BY chamber""")
def agg_by_chamber(spark: SparkSession, sf: str) -> DataFrame:
    unmatched = F.count_if(F.col("gender").isNull() | (F.col("gender") == "None"))
    return speeches(spark, sf).groupBy("chamber").agg(F.count("*").alias("n"), unmatched.alias("unmatched"), F.sum("word_count").alias("words"))


@query("""SELECT CAST(count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN d.source END) AS BIGINT) AS matched,
CAST(count(DISTINCT CASE WHEN l.doc_id IS NULL THEN lower(d.source) END) AS BIGINT) AS unmatched FROM documents d LEFT JOIN labels l USING (doc_id)""")
def agg_unique_speakers(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return both.agg(
        F.countDistinct(F.when(F.col("known"), F.col("source"))).alias("matched"), F.countDistinct(F.when(F.col("known").isNull(), F.lower("source"))).alias("unmatched")
    )


MILESTONES = [(1907, "first"), (1918, "second"), (1928, "third")]


@query(SPEECHES + """, k(mark, name) AS (VALUES (1907, 'first'), (1918, 'second'), (1928, 'third'))
SELECT name, CASE WHEN year < mark THEN 'before' ELSE 'after' END AS side, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (gender = 'F') AS BIGINT) AS n_f
FROM k JOIN s ON (year >= mark - 5 AND year < mark) OR (year > mark AND year <= mark + 5) GROUP BY 1, 2""")
def agg_milestone_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Before and after each milestone: counts by year first, so the range join sees a row a year."""
    by_year = speeches(spark, sf).groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("gender") == "F").alias("f"))
    k = spark.createDataFrame(MILESTONES, "at long, name string").withColumn("year", F.explode(F.sequence(F.col("at") - 5, F.col("at") + 5))).where("year <> at")
    side = F.when(F.col("year") < F.col("at"), "before").otherwise("after")
    return by_year.join(k, "year").groupBy("name", side.alias("side")).agg(F.sum("n").alias("n"), F.sum("f").alias("n_f"))


@query(SPEECHES + "SELECT year, round(100.0 * count(*) FILTER (gender = 'F') / nullif(count(gender), 0), 6) AS pct FROM s GROUP BY year")
def agg_annual_share(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).groupBy("year").agg(share(F.count_if(F.col("gender") == "F"), F.count("gender")).alias("pct"))


@query(SPEECHES + """SELECT year, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT debate_id) AS BIGINT) AS debates, CAST(count(DISTINCT speaker) AS BIGINT) AS speakers,
CAST(count(DISTINCT chamber) AS BIGINT) AS chambers, CAST(count(DISTINCT gender) AS BIGINT) AS genders, CAST(sum(word_count) AS BIGINT) AS words,
CAST(max(word_count) AS BIGINT) AS longest FROM s GROUP BY year""")
def agg_yearly_trends(spark: SparkSession, sf: str) -> DataFrame:
    distinct = [F.countDistinct(c).alias(a) for c, a in (("debate_id", "debates"), ("speaker", "speakers"), ("chamber", "chambers"), ("gender", "genders"))]
    return speeches(spark, sf).groupBy("year").agg(F.count("*").alias("n"), *distinct, F.sum("word_count").alias("words"), F.max("word_count").alias("longest"))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 2) AS total, string_agg(year || ':' || n, ',' ORDER BY year) AS by_year FROM y GROUP BY o_custkey
ORDER BY n DESC, o_custkey LIMIT 500""")
def agg_mp_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels: by person and year, then by person with the yearly counts in order."""
    y = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "n"))), lambda x: F.concat(x["year"], F.lit(":"), x["n"])), ",")
    people = y.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), listed.alias("by_year"))
    return people.orderBy(F.col("n").desc(), "o_custkey").limit(500)


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, lang AS modal_lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) WHERE k = 1""")
def agg_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    return table(spark, sf, "documents").groupBy("source").agg(F.mode("lang", deterministic=True).alias("modal_lang"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def agg_first_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_orderstatus", "o_orderkey").alias("status"))


@query(SPEECHES + """, u AS (SELECT DISTINCT decade, debate_id, speaker, gender FROM s)
SELECT decade, CAST(count(*) FILTER (gender = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (gender = 'M') AS BIGINT) AS m,
round(100.0 * count(*) FILTER (gender = 'F') / nullif(count(gender), 0), 6) AS pct FROM u GROUP BY decade""")
def agg_gender_by_decade_distinct(spark: SparkSession, sf: str) -> DataFrame:
    u = speeches(spark, sf).select("decade", "debate_id", "speaker", "gender").distinct()
    f, m = (F.count_if(F.col("gender") == g) for g in "FM")
    return u.groupBy("decade").agg(f.alias("f"), m.alias("m"), share(f, F.count("gender")).alias("pct"))


@query(SPEECHES + """SELECT debate_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT speaker) AS BIGINT) AS speakers, min(year) AS first_year,
CAST(count(*) FILTER (word_count >= 50) AS BIGINT) AS n_long, round(100.0 * count(*) FILTER (gender = 'F') / count(*), 1) AS pct_f FROM s GROUP BY debate_id""")
def agg_debate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).groupBy("debate_id").agg(
        F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"), F.min("year").alias("first_year"),
        F.count_if(F.col("word_count") >= 50).alias("n_long"), share(F.count_if(F.col("gender") == "F"), F.count("*"), 1).alias("pct_f"),
    )


@query(SPEECHES + """, f AS (SELECT debate_id, speaker, min(sequence_number) AS begins FROM s GROUP BY 1, 2)
SELECT s.debate_id, CAST(count(*) AS BIGINT) AS n, bool_or(gender = 'F') AS has_female,
(SELECT string_agg(speaker, ',' ORDER BY begins) FROM (SELECT * FROM f WHERE f.debate_id = s.debate_id ORDER BY begins LIMIT 10)) AS speakers FROM s GROUP BY s.debate_id""")
def agg_debate_from_speeches(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten speakers, by when they begin: one row a speaker, so that a long debate is no long array."""
    first = Window.partitionBy("debate_id").orderBy("begins")
    by_speaker = speeches(spark, sf).groupBy("debate_id", "speaker").agg(
        F.min("sequence_number").alias("begins"), F.count("*").alias("n"), F.bool_or(F.col("gender") == "F").alias("has_female")
    ).withColumn("k", F.row_number().over(first))
    names = F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("begins", "speaker"))))
    return by_speaker.groupBy("debate_id").agg(
        F.sum("n").alias("n"), F.bool_or("has_female").alias("has_female"), F.array_join(F.transform(names, lambda x: x["speaker"]), ",").alias("speakers")
    )


@query(SPEECHES + """SELECT debate_id, speaker, CAST(count(*) AS BIGINT) AS n, CAST(sum(word_count) AS BIGINT) AS words, min(sequence_number) AS first_at
FROM s GROUP BY 1, 2""")
def agg_speaker_rollup_in_debate(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).groupBy("debate_id", "speaker").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.min("sequence_number").alias("first_at"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source")
def agg_speaker_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"))


@query(SPEECHES + """, c AS (SELECT debate_id, min(year) AS year, count(*) AS n, count(*) FILTER (gender = 'F') AS f, count(*) FILTER (gender = 'M') AS m FROM s GROUP BY 1),
b AS (SELECT * FROM c WHERE f > 0 AND m > 0 AND n BETWEEN 3 AND 40 ORDER BY md5('7|' || debate_id) LIMIT 20),
o AS (SELECT * FROM c WHERE f = 0 AND m > 0 ORDER BY md5('7|' || debate_id) LIMIT 30)
SELECT debate_id, year, CAST(n AS BIGINT) AS n, kind FROM (SELECT *, 'mixed' AS kind FROM b UNION ALL SELECT *, 'male' AS kind FROM o)""")
def agg_having_balanced(spark: SparkSession, sf: str) -> DataFrame:
    f, m = (F.count_if(F.col("gender") == g) for g in "FM")
    c = speeches(spark, sf).groupBy("debate_id").agg(F.min("year").alias("year"), F.count("*").alias("n"), f.alias("f"), m.alias("m"))
    draw = F.md5(F.concat(F.lit("7|"), F.col("debate_id").cast("string")))
    mixed = c.where("f > 0 and m > 0 and n between 3 and 40").orderBy(draw).limit(20).withColumn("kind", F.lit("mixed"))
    male = c.where("f = 0 and m > 0").orderBy(draw).limit(30).withColumn("kind", F.lit("male"))
    return mixed.unionByName(male).select("debate_id", "year", "n", "kind")


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS mentions, CAST(count(*) AS BIGINT) AS speakers, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY lang""")
def agg_mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.sum("n").alias("mentions"), F.count("*").alias("speakers"), F.max("n").alias("most"))


@query(SPEECHES + "SELECT DISTINCT debate_id, year FROM s ORDER BY year, debate_id LIMIT 50")
def agg_distinct_debates(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).select("debate_id", "year").distinct().orderBy("year", "debate_id").limit(50)


@query(SPEECHES + "SELECT CAST(count(*) AS BIGINT) AS total FROM s WHERE chamber = 'Commons' AND contains(lower(text), 'the')")
def agg_count_query(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where((F.col("chamber") == "Commons") & F.contains(F.lower("text"), F.lit("the"))).agg(F.count("*").alias("total"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY lang")
def agg_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(d.agg(F.count("*").alias("all"))).select("lang", "n", share(F.col("n"), F.col("all")).alias("pct"))


@query(SPEECHES + """SELECT year, CAST(count(*) FILTER (gender = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (gender = 'M') AS BIGINT) AS M,
CAST(count(gender) AS BIGINT) AS total FROM s GROUP BY year""")
def agg_pivot_unstack(spark: SparkSession, sf: str) -> DataFrame:
    wide = speeches(spark, sf).groupBy("year").pivot("gender", ["F", "M"]).count().na.fill(0)
    return wide.withColumn("total", F.col("F") + F.col("M"))


@query("""SELECT quality, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS toxic_0, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS toxic_1 FROM labels GROUP BY quality""")
def agg_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0)
    return wide.withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


@query(DOCUMENTS + """SELECT year, CAST(sum(word_count) AS BIGINT) AS words, round(avg(word_count), 2) AS mean_words, CAST(count(*) AS BIGINT) AS n,
CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 2) AS mean_chars FROM d GROUP BY year""")
def agg_multi_stat_year(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("year").agg(
        F.sum("word_count").alias("words"), F.round(F.avg("word_count"), 2).alias("mean_words"), F.count("*").alias("n"),
        F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 2).alias("mean_chars"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where the value is known."""
    known = value.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean_discount FROM lineitem GROUP BY l_returnflag")
def agg_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean_discount"))


@query("SELECT lang, round(avg(m), 4) AS macro FROM (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY 1, 2) GROUP BY lang")
def agg_two_level_mean(spark: SparkSession, sf: str) -> DataFrame:
    inner = table(spark, sf, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"))
    return inner.groupBy("lang").agg(F.round(F.avg("m"), 4).alias("macro"))


@query("SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS per_order FROM orders GROUP BY o_orderstatus")
def agg_ratio_of_sums(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("per_order"))


@query(SPEECHES + "SELECT year, speaker, round(sum(word_count) / sum(sum(word_count)) OVER (PARTITION BY year), 6) AS part FROM s GROUP BY year, speaker")
def agg_share_of_total(spark: SparkSession, sf: str) -> DataFrame:

    by = speeches(spark, sf).groupBy("year", "speaker").agg(F.sum("word_count").alias("words"))
    return by.select("year", "speaker", F.round(F.col("words") / F.sum("words").over(Window.partitionBy("year")), 6).alias("part"))


BUCKETS = ["the", "of", "and", "de", "la"]


@query(r"""WITH t AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT lang, w AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM t WHERE w IN ('the', 'of', 'and', 'de', 'la') GROUP BY 1, 2""")
def agg_explode_count(spark: SparkSession, sf: str) -> DataFrame:
    """Lists to rows, unknown buckets left out before the rows are shuffled."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    t = table(spark, sf, "documents").select("doc_id", "lang", F.explode(words).alias("bucket")).where(F.col("bucket").isin(BUCKETS))
    by_doc = t.groupBy("lang", "bucket", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("""WITH k(word) AS (VALUES ('license'), ('token'), ('trash'), ('idiot'))
SELECT word, CAST(count(*) AS BIGINT) AS docs FROM documents, k WHERE contains(lower(text), word) GROUP BY word""")
def agg_keyword_usage(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(*[F.lit(w) for w in ("license", "token", "trash", "idiot")])
    low = table(spark, sf, "documents").select(F.lower("text").alias("low"))
    return low.select(F.explode(F.filter(terms, lambda w: F.contains("low", w))).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


@query("SELECT source, CAST(count(DISTINCT lang) AS BIGINT) AS langs FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def agg_cross_group_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs")).where("langs > 1")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS n_unique, CAST(count(*) - count(DISTINCT sha256(text)) AS BIGINT) AS dup, CAST(count(*) - count(text) AS BIGINT) AS nulls FROM documents")
def agg_dup_hash(spark: SparkSession, sf: str) -> DataFrame:
    unique = F.countDistinct(F.sha2("text", 256))
    return table(spark, sf, "documents").agg(
        F.count("*").alias("n"), unique.alias("n_unique"), (F.count("*") - unique).alias("dup"), F.count_if(F.col("text").isNull()).alias("nulls")
    )


def year_gaps(rows: DataFrame, year: str = "year") -> DataFrame:
    """The stretches of years that rows have none of, between the first and the last; distinct years are few."""
    y = rows.select(F.col(year).alias("year")).where("year is not null").distinct()
    g = y.withColumn("next_year", F.lead("year").over(Window.orderBy("year"))).where("next_year - year > 1")
    return g.selectExpr("year + 1 as gap_start", "next_year - 1 as gap_end", "next_year - year - 1 as gap")


@query("""WITH y AS (SELECT DISTINCT 1000 + doc_id * 37 % 1000 AS year FROM labels), g AS (SELECT year, lead(year) OVER (ORDER BY year) AS next_year FROM y)
SELECT year + 1 AS gap_start, next_year - 1 AS gap_end, next_year - year - 1 AS gap FROM g WHERE next_year - year > 1""")
def agg_year_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return year_gaps(table(spark, sf, "labels").select((F.lit(1000) + F.col("doc_id") * 37 % 1000).alias("year")))


@query(SPEECHES + """, y AS (SELECT year, 100.0 * count(*) FILTER (gender = 'F') / nullif(count(gender), 0) AS pct FROM s GROUP BY year)
SELECT min(year) FILTER (pct > 0) AS any_female, min(year) FILTER (pct >= 50) AS half, min(year) FILTER (pct >= 55) AS most FROM y""")
def agg_first_threshold_year(spark: SparkSession, sf: str) -> DataFrame:
    pct = F.try_divide(F.count_if(F.col("gender") == "F"), F.count("gender")) * 100
    y = speeches(spark, sf).groupBy("year").agg(pct.alias("pct"))
    first = lambda test: F.min(F.when(test, F.col("year")))
    return y.agg(first(F.col("pct") > 0).alias("any_female"), first(F.col("pct") >= 50).alias("half"), first(F.col("pct") >= 55).alias("most"))


@query("""WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS year FROM orders GROUP BY 1) SELECT CAST(year AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS new_ids FROM f GROUP BY year""")
def agg_log_new_assignments(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).cast("long").alias("year"))
    return first.groupBy("year").agg(F.count("*").alias("new_ids"))
