"""Agreement, error rates and tests: counts in Spark, closed forms on the counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import SPEECHES, speeches, table


def raters(spark: SparkSession, sf: str) -> DataFrame:
    """Two raters of the same documents: (id, a, b)."""
    return table(spark, sf, "labels").selectExpr("doc_id as id", "quality as a", "toxic as b")


def kappa(pairs: DataFrame) -> DataFrame:
    """(n, agreement, kappa) of (a, b): marginals by one explode of the confusion counts, so any set of labels will do."""
    c = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side = c.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).alias("x"), F.col("n").alias("y")))).alias("s"))
    chance = side.groupBy("s.label").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("labels"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    both = total.crossJoin(chance)
    return both.select("n", po.alias("agreement"), F.when(F.col("labels") > 1, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) / count(*) AS po, (count(*) FILTER (quality = 0) * count(*) FILTER (toxic = 0)
+ count(*) FILTER (quality = 1) * count(*) FILTER (toxic = 1)) / (count(*) * count(*)) AS pe FROM labels)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM t""")
def stat_cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return kappa(raters(spark, sf)).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def per_class(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of truth a and prediction b; 0 where nothing is divided by nothing."""
    rows = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("truth"), F.lit(0).alias("said"), (F.col("a") == F.col("b")).cast("int").alias("hit")),
                                          F.struct(F.col("b").alias("label"), F.lit(0).alias("truth"), F.lit(1).alias("said"), F.lit(0).alias("hit")))).alias("r")).select("r.*")
    c = rows.groupBy("label").agg(F.sum("truth").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return c.select(
        "label", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support",
    )


@query("""WITH k(label) AS (VALUES (0), (1)), c AS (SELECT label, count(*) FILTER (quality = label) AS support, count(*) FILTER (toxic = label) AS said,
count(*) FILTER (quality = label AND toxic = label) AS hit FROM labels, k GROUP BY label)
SELECT label, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM c""")
def stat_confusion_prf(spark: SparkSession, sf: str) -> DataFrame:
    r = per_class(raters(spark, sf))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""SELECT quality || '->' || toxic AS pattern, CASE WHEN quality = toxic THEN 'none' WHEN quality > toxic THEN 'relevance' ELSE 'direction' END AS severity,
CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY 1, 2""")
def stat_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("a") == F.col("b"), "none").when(F.col("a") > F.col("b"), "relevance").otherwise("direction")
    return raters(spark, sf).groupBy(F.concat("a", F.lit("->"), "b").alias("pattern"), severity.alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT l.doc_id AS id, CASE WHEN quality = toxic THEN quality ELSE d.doc_id % 2 END::BIGINT AS gold FROM labels l LEFT JOIN documents d USING (doc_id)")
def stat_gold_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Where two agree that is gold, else what resolved it."""
    resolved = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("resolved"))
    both = raters(spark, sf).join(resolved, "id", "left")
    return both.select("id", F.coalesce(F.when(F.col("a") == F.col("b"), F.col("a").cast("long")), "resolved").alias("gold"))


@query("""SELECT field, round(avg(CASE WHEN v = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'quality' AS field, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY field""")
def stat_agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "field", "v")
    return long.groupBy("field").agg(F.round(F.avg((F.col("v") == 1).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The ends of Wilson's interval."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


@query("""WITH c AS (SELECT quality, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels GROUP BY 1), p AS (SELECT *, k / n AS p FROM c)
SELECT quality, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p""")
def stat_wilson(spark: SparkSession, sf: str) -> DataFrame:
    low, high = wilson(F.count_if(F.col("toxic") == 1), F.count("*"))
    return table(spark, sf, "labels").groupBy("quality").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT round(1.96 * sqrt(0.25 / count(*)), 6) AS margin FROM labels")
def stat_margin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").agg(F.round(1.96 * F.sqrt(F.lit(0.25) / F.count("*")), 6).alias("margin"))


def upper_gamma(a: Column, x: Column, terms: int = 2000) -> Column:
    """The regularised upper incomplete gamma function of a, a whole number or a half over 0, by the series of the lower one:
    right to about 1e-12, which so is the least value that tells anything; terms bounds x to about terms / 2."""
    half = a % 1 != 0
    steps = F.sequence(F.lit(0), F.floor(a).cast("int"))
    # ln gamma(a + 1) from ln gamma(1/2 or 1), one factor at a time.
    begin = F.when(half, F.log(F.sqrt(F.lit(math.pi)))).otherwise(0.0)
    whole = F.aggregate(steps, begin, lambda s, k: s + F.when(half, F.log(k + 0.5)).otherwise(F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), zero, lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")))
    lower = F.exp(a * F.log(x) - x - whole + F.log(total["sum"]))
    return F.when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def chi2_test(df: DataFrame, row: str, col: str) -> DataFrame:
    """(chi2, dof, p) of the table of two columns' values, cells that don't occur included; with Yates' correction where it
    has one degree of freedom. Only counts are joined; rows with a null in either column are left out."""
    c = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("k")).agg(F.count("*").alias("n"))
    rows, cols = c.groupBy("r").agg(F.sum("n").alias("in_row")), c.groupBy("k").agg(F.sum("n").alias("in_col"))
    sides = c.agg(F.sum("n").alias("total")).join(rows.agg(F.count("*").alias("nr"), F.sum(1 / F.col("in_row")).alias("ir")), how="cross").join(cols.agg(F.count("*").alias("nk"), F.sum(1 / F.col("in_col")).alias("ik")), how="cross")  # a row each
    met = c.join(rows, "r").join(cols, "k").join(F.broadcast(sides), how="cross").withColumn("x", F.col("in_row") * F.col("in_col") / F.col("total"))
    told = met.groupBy("total", "nr", "nk", "ir", "ik").agg(F.sum(F.col("n") * F.col("n") / F.col("x")).alias("s"), F.max(F.abs(F.col("n") - F.col("x"))).alias("off"))
    dof = ((F.col("nr") - 1) * (F.col("nk") - 1)).alias("dof")
    # All four cells of a 2 by 2 table are off by the same; absent cells of others add what is expected of them.
    one = F.pow(F.col("off") - F.least(F.lit(0.5), F.col("off")), 2) * F.col("total") * F.col("ir") * F.col("ik")
    chi2 = F.when(dof == 1, one).when(dof == 0, 0.0).otherwise(F.col("s") - F.col("total"))
    return told.select(chi2.alias("chi2"), dof).withColumn("p", F.when(F.col("dof") > 0, upper_gamma(F.col("dof") / 2, F.col("chi2") / 2)).otherwise(1.0))


_CHI2 = """WITH c AS (SELECT lang, 1803 + doc_id % 3 AS year, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT lang, sum(n) AS a FROM c GROUP BY 1), k AS (SELECT year, sum(n) AS b FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
e AS (SELECT coalesce(n, 0) AS n, a * b / t AS x FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (lang, year)), s AS (SELECT sum((n - x) * (n - x) / x) AS chi2, (SELECT (count(*) - 1) * ((SELECT count(*) FROM k) - 1) FROM r) AS dof FROM e)
SELECT round(chi2, 6) AS chi2, CAST(dof AS BIGINT) AS dof, round(1 - list_sum(list_transform(range(0, 600), lambda i: exp((dof / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2 + i + 1)))), 6) AS p FROM s"""


@query(_CHI2)
def stat_chi2(spark: SparkSession, sf: str) -> DataFrame:
    """Of languages and years."""
    d = table(spark, sf, "documents").select("lang", (F.lit(1803) + F.col("doc_id") % 3).alias("year"))
    return chi2_test(d, "lang", "year").select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p", 6).alias("p"))


def two_shares(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda q: (F.count_if((F.col("quality") == q) & (F.col("toxic") == 1)), F.count_if(F.col("quality") == q))
    (k1, n1), (k2, n2) = side(1), side(0)
    row = table(spark, sf, "labels").agg((k1 / n1).alias("p1"), n1.alias("n1"), (k2 / n2).alias("p2"), n2.alias("n2"))
    h = 2 * F.asin(F.sqrt("p1")) - 2 * F.asin(F.sqrt("p2"))
    return row.withColumn("h", F.when((F.col("n1") >= 5) & (F.col("n2") >= 5), h))


SHARES = """WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (quality = 1) AS p1, count(*) FILTER (quality = 1) AS n1,
count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (quality = 0) AS p2, count(*) FILTER (quality = 0) AS n2 FROM labels), h AS (SELECT *, 2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)) AS h FROM t)
"""


@query(SHARES + "SELECT round(h, 6) AS h, round(sqrt(1 / (2 * n1 * n2 / (n1 + n2))), 6) AS se FROM h")
def stat_cohens_h(spark: SparkSession, sf: str) -> DataFrame:
    harmonic = 2 * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    return two_shares(spark, sf).select(F.round("h", 6).alias("h"), F.round(F.sqrt(1 / harmonic), 6).alias("se"))


@query(SHARES + "SELECT CASE WHEN abs(h) >= 0.05 THEN CAST(ceil(2 * power(2.8 / abs(h), 2)) AS BIGINT) END AS n FROM h")
def stat_power(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a group for 80 % power; null where the effect is too small to ask."""
    size = F.abs("h")
    return two_shares(spark, sf).select(F.when(size >= 0.05, F.ceil(2 * (2.8 / size) ** 2)).cast("long").alias("n"))


@query("""WITH g AS (SELECT avg(n_chars) FILTER (lang = 'en') AS m1, var_samp(n_chars) FILTER (lang = 'en') AS v1, count(*) FILTER (lang = 'en') AS n1, avg(n_chars) FILTER (lang = 'fr') AS m2,
var_samp(n_chars) FILTER (lang = 'fr') AS v2, count(*) FILTER (lang = 'fr') AS n2 FROM documents)
SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS dof FROM g""")
def stat_welch_t(spark: SparkSession, sf: str) -> DataFrame:
    def moments(g: str) -> list[Column]:
        x = F.when(F.col("lang") == g, F.col("n_chars"))
        return [F.avg(x), F.var_samp(x) / F.count(x), F.count(x)]

    (m1, s1, n1), (m2, s2, n2) = moments("en"), moments("fr")
    dof = (s1 + s2) ** 2 / (s1**2 / (n1 - 1) + s2**2 / (n2 - 1))
    return table(spark, sf, "documents").agg(F.round((m1 - m2) / F.sqrt(s1 + s2), 6).alias("t"), F.round(dof, 4).alias("dof"))


@query(SPEECHES + """, w AS (SELECT debate_id, avg(word_count) FILTER (gender = 'F') - avg(word_count) FILTER (gender = 'M') AS d FROM s GROUP BY 1)
SELECT round(avg(d) / sqrt(var_samp(d) / count(d)), 6) AS t, CAST(count(d) - 1 AS BIGINT) AS dof FROM w""")
def stat_paired_t(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda g: F.avg(F.when(F.col("gender") == g, F.col("word_count")))
    w = speeches(spark, sf).groupBy("debate_id").agg((mean("F") - mean("M")).alias("d"))
    return w.agg(F.round(F.avg("d") / F.sqrt(F.var_samp("d") / F.count("d")), 6).alias("t"), (F.count("d") - 1).alias("dof"))


def permuted(spark: SparkSession, pairs: DataFrame, rounds: int, seed: int = 42) -> DataFrame:
    """p of the difference of means of d: signs are the bits of a hash of each pair and block of 64 rounds; sums are taken
    by round, 64 at a time, so a pair is one row for every 64 rounds."""
    rows = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 64))))
    bits = rows.select("block", "d", F.xxhash64("id", "block", F.lit(seed)).alias("bits"))
    sums = [F.sum(F.when(F.getbit("bits", F.lit(i)) == 1, F.col("d")).otherwise(-F.col("d"))) for i in range(64)]
    drawn = bits.groupBy("block").agg(F.array(*sums).alias("x")).select("block", F.posexplode("x").alias("i", "x")).where(F.col("block") * 64 + F.col("i") < rounds)
    seen = pairs.agg(F.abs(F.sum("d")).alias("seen"))
    return drawn.crossJoin(F.broadcast(seen)).agg(((F.count_if(F.abs(F.col("x")) >= F.col("seen")) + 1) / (F.count("*") + 1)).alias("p"))


@query()
def stat_permutation(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda g: F.avg(F.when(F.col("gender") == g, F.col("word_count")))
    w = speeches(spark, sf).groupBy(F.col("debate_id").alias("id")).agg((mean("F") - mean("M")).alias("d")).where("d is not null")
    return permuted(spark, w, 1000)


@query("""SELECT d.lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS yes_rate, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS BIGINT) AS fp,
CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS fn FROM labels JOIN documents d USING (doc_id) GROUP BY d.lang""")
def stat_accuracy_by(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return both.groupBy("lang").agg(
        F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("yes_rate"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("fp"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("fn"),
    )


@query("""SELECT CASE WHEN n_chars > 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS tier, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) FILTER (quality = 0) / count(*), 6) AS irrelevant_pct
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def stat_trigger_totals(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    tier = F.when(F.col("n_chars") > 1000, "HIGH").otherwise("MEDIUM").alias("tier")
    return both.groupBy(tier).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("quality") == 0) / F.count("*") * 100, 6).alias("irrelevant_pct"))


@query("SELECT round(CAST(0.95 AS DOUBLE) * count(*) FILTER (n_chars > 1000) + CAST(0.257 AS DOUBLE) * count(*) FILTER (n_chars <= 1000), 4) AS true_positives FROM documents")
def stat_est_true_pos(spark: SparkSession, sf: str) -> DataFrame:
    high, medium = F.count_if(F.col("n_chars") > 1000), F.count_if(F.col("n_chars") <= 1000)
    return table(spark, sf, "documents").agg(F.round(high * 0.95 + medium * 0.257, 4).alias("true_positives"))
