"""Text mining: tokens, n-grams, TF-IDF, log-odds, ranking, tiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import table

#: English function words, the public list of 127 and the modal verbs that it lacks.
BASIC = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now could might shall must ought would may"""
#: What the levels of filtering add.
PARLIAMENTARY = """hon honourable right gentleman lady member members house speaker sir madam mr mrs ms lord lords gallant learned
friend friends noble bill clause amendment committee order question division reading report stage moved second third
government minister secretary state department debate discuss speech words statement"""
VERBS = """make made making makes take took taken taking give gave given giving put puts putting get got getting gets come came
coming comes go went going goes gone say said saying says think thought thinking thinks know knew known knowing see saw seeing
sees seen want wanted wanting wants look looked looking looks find found finding finds tell told telling tells ask asked
asking asks seem seemed seeming seems feel felt feeling feels try tried trying tries leave left leaving leaves call called
calling calls keep kept keeping keeps believe believed hope hoped wish wished need needed use used using uses work worked
working works"""
VAGUE = """thing things something anything nothing everything way ways case cases matter matters fact facts time times place
places part parts kind kinds point points view views position number numbers example examples word words subject course
present regard deal side end result means moment today yesterday tomorrow now then year years day days week weeks month
months last next first second"""
DISCOURSE = """well yes no indeed perhaps certainly obviously clearly surely really quite sure also however therefore whether still
always never yet already rather even far"""
ARTIFACTS = "deb vol hc hl rt hon c cc col cols w ws parl sess ser hansard official per cent proc"
QUANTIFIERS = "much many more most less least few fewer several hundred thousand million one"
ADJECTIVES = """new old good bad great small large important different same certain possible necessary clear particular general
special full long short high low"""
STOPWORDS = {
    "basic": BASIC.split(),
    "parliamentary": PARLIAMENTARY.split(),
    "moderate": VERBS.split() + VAGUE.split(),
    "aggressive": DISCOURSE.split() + ARTIFACTS.split() + QUANTIFIERS.split() + ADJECTIVES.split(),
}
LEVELS = ["basic", "parliamentary", "moderate", "aggressive"]


def stopwords(level: str = "moderate") -> list[str]:
    """The words of a level, each level holding those before; `minimal` is `basic`, an unknown level `moderate`."""
    level = {"minimal": "basic"}.get(level, level if level in LEVELS else "moderate")
    return list(dict.fromkeys(w for x in LEVELS[: LEVELS.index(level) + 1] for w in STOPWORDS[x]))


#: Words of plain letters alone: a word with an accent or a digit in it has no part that is one.
PLAIN = r"(?<![\p{L}\p{N}_])[a-z]+(?![\p{L}\p{N}_])"


def tokens(text: Column, stop: list[str] | None = None, pattern: str = PLAIN, least: int = 2) -> Column:
    """Lower-case words of at least `least` letters that are no stop words; an empty array of null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)
    keep = lambda w: (F.length(w) >= least) & ~w.isin(stop) if stop else F.length(w) >= least
    return F.filter(found, keep)


def preprocessed(text: Column, stop: list[str]) -> Column:
    """Clean running text: marks of emphasis, quotes, [notes] and punctuation go, and what they stood between closes up;
    lower case, white space squeezed, no words of one letter and no stop words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s]+", " ")
    t = F.regexp_replace(t, r"[_*`'\"]", "")
    t = F.regexp_replace(t, r"\[[^\]]*\]", "")
    t = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N} ]", ""))
    return F.array_join(F.filter(F.split(t, " +"), lambda w: (F.length(w) >= 2) & ~w.isin(stop)), " ")


def ngrams(words: Column, n: int) -> Column:
    """The runs of n words, joined by blanks."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def counted(docs: DataFrame, words: Column, *by: str) -> DataFrame:
    """(by..., term, n): how often each term occurs."""
    return docs.select(*by, F.explode(words).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))


def sql_tokens(text: str, least: int = 2) -> str:
    """The tokens of a text, in SQL."""
    return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{least},}}'))"


def sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


TOKENS = f"""WITH t AS (SELECT doc_id, lang, source, unnest({sql_tokens('text')}) AS w FROM documents)
"""


@query(rf"""SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\s]+', ' ', 'g'), '[_*`''"]', '', 'g'),
'\[[^\]]*\]', '', 'g'), '[^\p{{L}}\p{{N}} ]', '', 'g')), ' +'), lambda w: length(w) >= 2 AND w NOT IN ({sql_list(stopwords("moderate"))})), ' ') AS clean FROM documents""")
def txt_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", preprocessed(F.col("text"), stopwords("moderate")).alias("clean"))


@query(TOKENS + f"SELECT w AS term, CAST(count(*) AS BIGINT) AS n FROM t WHERE w IN ({sql_list(stopwords('basic'))}) GROUP BY w")
def txt_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    return counted(table(spark, sf, "documents"), F.filter(tokens(F.col("text")), lambda w: w.isin(stopwords("basic"))))


@query(TOKENS + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT w) AS BIGINT) AS kinds FROM t GROUP BY doc_id")
def txt_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))
    return d.where("n > 0")


@query(f"""WITH l AS (SELECT {sql_tokens('text')} AS ws FROM documents WHERE lang = 'en'),
g AS (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM l)
SELECT term, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 50""")
def txt_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent bigrams."""
    d = table(spark, sf, "documents").where("lang = 'en'").select(tokens(F.col("text")).alias("ws"))
    return counted(d, ngrams(F.col("ws"), 2)).orderBy(F.col("n").desc(), "term").limit(50)


@query(r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents), g AS (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM l)
SELECT term, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 20""")
def txt_bigrams_raw(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("ws"))
    return counted(d, ngrams(F.col("ws"), 2)).orderBy(F.col("n").desc(), "term").limit(20)


def tfidf(docs: DataFrame, words: Column, terms: int) -> DataFrame:
    """(term, mean): the mean over all documents of term weights: count times ln((1 + n) / (1 + df)) + 1, each document's
    weights scaled to length 1, over the `terms` most frequent terms, ties by term.

    Only totals by term are counted of all words; of the terms chosen, words are kept before anything is shuffled."""
    top = counted(docs, words).orderBy(F.col("n").desc(), "term").limit(terms).select("term").collect()
    names = [r["term"] for r in top]
    kept = docs.select("doc_id", F.explode(F.filter(words, lambda w: w.isin(names)) if names else F.array().cast("array<string>")).alias("term"))
    tf = kept.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    known = F.broadcast(tf.groupBy("term").agg(F.count("*").alias("df")))  # at most `terms` rows
    n = docs.agg(F.count("*").alias("docs"))
    weight = F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)
    w = tf.join(known, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", "docs", weight.alias("w"))
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy("doc_id"))))
    return unit.groupBy("term").agg((F.sum("w") / F.first("docs")).alias("mean"))


@query(TOKENS + """, f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT w, sum(tf) AS total, count(*) AS df FROM f GROUP BY w ORDER BY total DESC, w LIMIT 100),
x AS (SELECT doc_id, f.w, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS z FROM f JOIN v USING (w)),
u AS (SELECT w, z / sqrt(sum(z * z) OVER (PARTITION BY doc_id)) AS z FROM x)
SELECT w AS term, round(sum(z) / (SELECT count(*) FROM documents), 6) AS mean FROM u GROUP BY w""")
def txt_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf(table(spark, sf, "documents"), tokens(F.col("text")), 100).withColumn("mean", F.round("mean", 6))


def log_odds(counts: DataFrame, group: str, one: str, two: str, smooth: float = 0.5, least: int = 1) -> DataFrame:
    """(term, n1, n2, log_odds) of the terms that occur `least` times in both groups together; totals over all tokens.
    The vocabularies are joined by term, so each term is compared with itself."""
    n = lambda g: F.sum(F.when(F.col(group) == g, F.col("n")).otherwise(0))
    wide = counts.where(F.col(group).isin(one, two)).groupBy("term").agg(n(one).alias("n1"), n(two).alias("n2"))
    totals = wide.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    kept = wide.where(F.col("n1") + F.col("n2") >= least)
    both = kept.crossJoin(F.broadcast(totals.crossJoin(kept.agg(F.count("*").alias("v")))))
    rate = lambda n, t: (F.col(n) + smooth) / (F.col(t) + smooth * F.col("v"))
    return both.select("term", "n1", "n2", F.log(rate("n1", "t1") / rate("n2", "t2")).alias("log_odds"))


ODDS = TOKENS.replace("{", "{{").replace("}", "}}") + """, c AS (SELECT w AS term, count(*) FILTER ({a}) AS n1, count(*) FILTER ({b}) AS n2 FROM t WHERE {a} OR {b} GROUP BY w),
k AS (SELECT * FROM c WHERE n1 + n2 >= {least}), z AS (SELECT sum(n1) AS t1, sum(n2) AS t2 FROM c), v AS (SELECT count(*) AS v FROM k)
SELECT term, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(ln(((n1 + {s}) / (t1 + {s} * v)) / ((n2 + {s}) / (t2 + {s} * v))), 6) AS log_odds FROM k, z, v"""


@query(ODDS.format(a="lang = 'en'", b="lang = 'fr'", least=10, s=0.5))
def txt_logodds_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    counts = counted(table(spark, sf, "documents"), tokens(F.col("text")), "lang")
    return log_odds(counts, "lang", "en", "fr", 0.5, 10).withColumn("log_odds", F.round("log_odds", 6))


@query(ODDS.format(a="source = 'src1'", b="source = 'src2'", least=2, s=1.0))
def txt_logodds_shared(spark: SparkSession, sf: str) -> DataFrame:
    counts = counted(table(spark, sf, "documents"), tokens(F.col("text")), "source")
    return log_odds(counts, "source", "src1", "src2", 1.0, 2).withColumn("log_odds", F.round("log_odds", 6))


@query(ODDS.format(a="lang = 'de'", b="lang = 'es'", least=1, s=1.0))
def txt_logodds_two_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Over the union of two vocabularies."""
    counts = counted(table(spark, sf, "documents"), tokens(F.col("text")), "lang")
    return log_odds(counts, "lang", "de", "es", 1.0).withColumn("log_odds", F.round("log_odds", 6))


@query(r"""WITH t AS (SELECT 1803 + doc_id % 3 AS p, unnest(@TOKENS@) AS w FROM documents WHERE lang = 'en'), c AS (SELECT p, w, count(*) AS n FROM t GROUP BY 1, 2),
z AS (SELECT p, sum(n) AS t FROM c GROUP BY p)
SELECT CAST(x.p AS BIGINT) AS p1, CAST(y.p AS BIGINT) AS p2, x.w AS term, round(ln((x.n / zx.t) / (y.n / zy.t)), 6) AS log_odds FROM c x JOIN c y ON x.w = y.w AND x.p < y.p
JOIN z zx ON zx.p = x.p JOIN z zy ON zy.p = y.p WHERE x.n + y.n >= 20""".replace("@TOKENS@", sql_tokens("text")))
def txt_temporal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of periods, joined by term, so no period meets a term that it lacks."""
    d = table(spark, sf, "documents").where("lang = 'en'").withColumn("p", (F.lit(1803) + F.col("doc_id") % 3).cast("long"))
    c = counted(d, tokens(F.col("text")), "p")
    c = c.join(F.broadcast(c.groupBy("p").agg(F.sum("n").alias("t"))), "p")
    x, y = (c.select("term", F.col("p").alias(f"p{i}"), F.col("n").alias(f"n{i}"), (F.col("n") / F.col("t")).alias(f"r{i}")) for i in (1, 2))
    both = x.join(y, "term").where("p1 < p2 and n1 + n2 >= 20")
    return both.select("p1", "p2", "term", F.round(F.log(F.col("r1") / F.col("r2")), 6).alias("log_odds"))


@query(TOKENS + """, c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM c)
SELECT lang, w AS term, CAST(n AS BIGINT) AS n FROM k WHERE k <= 30 AND w IN (SELECT w FROM k WHERE k <= 30 GROUP BY w HAVING count(*) = 1)""")
def txt_top_words_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words of each group that are so in no other."""
    c = counted(table(spark, sf, "documents"), tokens(F.col("text")), "lang")
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "term"))).where("k <= 30").drop("k")
    return top.join(top.groupBy("term").count().where("count = 1"), "term", "left_semi").select("lang", "term", "n")


@query()
def txt_lda(spark: SparkSession, sf: str) -> DataFrame:
    """Topics and their heaviest words by online variational LDA."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    d = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", tokens(F.col("text"), stopwords("aggressive")).alias("words"))
    words = CountVectorizer(inputCol="words", outputCol="features", vocabSize=1000, minDF=2).fit(d)
    topics = LDA(k=8, maxIter=10, seed=42, optimizer="online").fit(words.transform(d)).describeTopics(10)
    names = F.array(*[F.lit(w) for w in words.vocabulary])
    return topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "x")).select(
        "topic", "place", F.element_at(names, F.col("x.termIndices") + 1).alias("term"), F.col("x.termWeights").alias("weight")
    )


HIGH = "licensed under|general public license|all rights reserved"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){HIGH}') THEN 'HIGH' WHEN regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)that|was|with') THEN 'MEDIUM' END AS tier FROM documents
WHERE regexp_matches(text, '(?i){HIGH}') OR (regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)that|was|with'))""")
def txt_regex_tier(spark: SparkSession, sf: str) -> DataFrame:
    """The dear test runs only where the cheap one fails: a `when` stops at the first that holds."""
    t = F.col("text")
    tier = F.when(t.rlike(f"(?i){HIGH}"), "HIGH").when(t.rlike("(?i)the") & t.rlike("(?i)that|was|with"), "MEDIUM")
    return table(spark, sf, "documents").select("doc_id", tier.alias("tier")).where("tier is not null")


@query("""SELECT doc_id, CASE WHEN contains(l, 'idiot') AND contains(l, 'stupid') THEN 'HIGH' WHEN contains(l, 'idiot') THEN 'MEDIUM' WHEN contains(l, 'stupid') THEN 'LOW' ELSE 'OFF' END AS tier
FROM (SELECT doc_id, lower(text) AS l FROM documents)""")
def txt_tier_categorize(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.contains(F.lower("text"), F.lit(w)) for w in ("idiot", "stupid"))
    return table(spark, sf, "documents").select("doc_id", F.when(a & b, "HIGH").when(a, "MEDIUM").when(b, "LOW").otherwise("OFF").alias("tier"))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms that the text holds, in the order given, comma-joined."""
    return F.array_join(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t)), ",")


@query("""SELECT doc_id, array_to_string(list_filter(['token', 'license', 'http'], lambda k: contains(lower(text), k)), ',') AS matched, contains(lower(text), 'the') AS has_the, substr(text, 1, 300) AS snippet
FROM documents WHERE len(list_filter(['token', 'license', 'http'], lambda k: contains(lower(text), k))) > 0""")
def txt_keyword_triage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", matched_terms(F.col("text"), ["token", "license", "http"]).alias("matched"), F.contains(F.lower("text"), F.lit("the")).alias("has_the"), F.substring("text", 1, 300).alias("snippet"))
    return d.where("matched <> ''")


@query("""SELECT doc_id, regexp_extract(text, '(?i)(licensed under|public license|idiot)', 1) AS first_match, array_to_string(list_filter(['stupid', 'moron', 'loser'], lambda k: contains(lower(text), k)), ',') AS terms
FROM documents WHERE regexp_matches(text, '(?i)(licensed under|public license|idiot)')""")
def txt_why_matched(spark: SparkSession, sf: str) -> DataFrame:
    p = "(?i)(licensed under|public license|idiot)"
    d = table(spark, sf, "documents").where(F.col("text").rlike(p))
    return d.select("doc_id", F.regexp_extract("text", p, 1).alias("first_match"), matched_terms(F.col("text"), ["stupid", "moron", "loser"]).alias("terms"))


#: What a debate's title must hold one of.
TITLE_KEYWORDS = [
    "suffrage", "franchise", "enfranchisement", "disenfranchisement",
    "women vote", "women voting", "female vote", "female voting",
    "women's suffrage", "woman suffrage", "female suffrage",
    "women's franchise", "woman franchise", "female franchise",
    "women voters", "female voters", "woman voters",
    "votes for women", "votes for woman",
    "suffragist", "suffragette", "suffragettes", "suffragists",
    "women's rights", "woman's rights", "female rights",
    "women's movement", "woman's movement",
    "electoral reform", "representation of the people",
    "equal franchise", "equal suffrage", "universal suffrage",
    "women's representation", "female representation",
    "women in parliament", "women in politics",
    "women's social and political union", "wspu",
    "national union of women's suffrage societies", "nuwss",
    "women's freedom league", "wfl",
    "women's enfranchisement", "woman's enfranchisement",
    "female enfranchisement", "women's disenfranchisement",
    "woman's disenfranchisement", "female disenfranchisement",
    "women's parliamentary vote", "woman's parliamentary vote",
    "female parliamentary vote", "women's electoral rights",
    "woman's electoral rights", "female electoral rights",
]


def with_keywords(debates: DataFrame, keywords: list[str] = TITLE_KEYWORDS, title: str = "title") -> DataFrame:
    """The debates whose title holds any of the keywords, whatever its case, with matched_keywords in the list's order."""
    low = F.lower(F.coalesce(F.col(title), F.lit("")))
    held = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, F.lower(k)))
    return debates.where(low.rlike("|".join(re.escape(k.lower()) for k in keywords))).withColumn("matched_keywords", held)


#: Titles of debates, made of a topic and one of the keywords, whole or cut, by the document's number.
_TITLE_SQL = "upper(substr(text, 1, 20)) || ' on ' || [{}][doc_id % 60 + 1]".format(", ".join("'" + k.replace("'", "''").title().replace("'S", "'s") + "'" for k in [*TITLE_KEYWORDS, "women", "votes for men", "suffrag", "wsp u", "reform"]))


@query(f"""WITH t AS (SELECT doc_id, {_TITLE_SQL} AS title FROM documents), k AS (SELECT unnest([{", ".join("'" + k.replace("'", "''") + "'" for k in TITLE_KEYWORDS)}]) AS k, unnest(range({len(TITLE_KEYWORDS)})) AS n)
SELECT doc_id, string_agg(k, ',' ORDER BY n) AS matched FROM t JOIN k ON contains(lower(title), k) GROUP BY doc_id""")
def txt_title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    endings = [k.title().replace("'S", "'s") for k in [*TITLE_KEYWORDS, "women", "votes for men", "suffrag", "wsp u", "reform"]]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 60 + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.upper(F.substring("text", 1, 20)), F.lit(" on "), ending).alias("title"))
    return with_keywords(d).select("doc_id", F.array_join("matched_keywords", ",").alias("matched"))
