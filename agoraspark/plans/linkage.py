"""Linking names to a register: candidates by rule, priorities, merge passes that fill gaps, waterfalls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from agoraspark.operators.joins import SHORT, keyed, overlap_years, set_of, sizes, token_overlap
from agoraspark.registry import query
from agoraspark.views import SPEECHES, speeches, table

#: Match types that are taken over, and from which confidence.
ACCEPTED, CONFIDENT = ("exact", "place", "surname"), 0.6


def cascade(mentions: DataFrame, register: DataFrame) -> DataFrame:
    """(mention_id, person_id, match_type, confidence): name, place and years together; name and place; surname within
    two years of age, where one candidate is left; several candidates are ambiguous, the less sure the more there are.

    People are counted by each step's keys, the first and the last of them by id: one person alone is where these two are the
    same. Mentions alike in all keys are looked up once. No pairs of all who share a name and a place are made or shuffled."""
    of = ["name", "surname", "place", "age"]
    m, r = mentions.select("mention_id", *of), register.select("person_id", *of)
    tell = lambda c: [F.min("person_id").alias(f"{c}_low"), F.max("person_id").alias(f"{c}_high")]
    exact, place = r.groupBy("name", "place", "age").agg(*tell("exact")), r.groupBy("name", "place").agg(*tell("place"))
    # A mention looks at the five ages near its own.
    aged = r.groupBy("surname", F.col("age").alias("at")).agg(F.min("person_id").alias("near"), F.count("*").alias("n"))
    kinds = m.select(*of).distinct()
    near = kinds.select("surname", "age").distinct().select("*", F.explode(F.sequence(F.col("age") - 2, F.col("age") + 2)).alias("at")).join(aged, ["surname", "at"])
    near = near.groupBy("surname", "age").agg(F.min("near").alias("near"), F.sum("n").alias("n"))
    found = kinds.join(exact, ["name", "place", "age"], "left").join(place, ["name", "place"], "left").join(near, ["surname", "age"], "left")
    found = found.where("exact_low is not null or place_low is not null or n is not null").select(*[F.col(c).alias(f"k_{c}") for c in of], "exact_low", "exact_high", "place_low", "place_high", "near", "n")
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in of])  # an unknown age does not hide a name and place
    low, high = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    per = m.join(found, alike).groupBy("mention_id").agg(low("exact_low"), high("exact_high"), low("place_low"), high("place_high"), low("near"), F.sum("n").alias("n"))
    says = lambda person, kind, sure: F.struct(F.col(person).alias("person_id"), F.lit(kind).alias("match_type"), sure.alias("confidence"))
    best = F.when(F.col("exact_low") == F.col("exact_high"), says("exact_low", "exact", F.lit(0.95))).when(F.col("place_low") == F.col("place_high"), says("place_low", "place", F.lit(0.9)))
    best = best.when(F.col("n") == 1, says("near", "surname", F.lit(0.85))).when(F.col("n") > 1, says("near", "ambiguous", F.round(F.lit(0.4) / F.col("n"), 6)))
    return per.select("mention_id", best.alias("b")).where("b is not null").select("mention_id", "b.*")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """A register: parts stand for people, with a given name, a surname, a place and an age."""
    given, surname = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), given.alias("given"), surname.alias("surname"),
        F.col("p_brand").alias("place"), F.col("p_size").alias("age"), F.when(F.col("p_partkey") % 3 == 0, "F").otherwise("M").alias("gender"),
    )


def register_and_mentions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = people(spark, sf)
    return p.where("person_id % 4 <> 0"), p.where("person_id % 4 = 0").withColumnRenamed("person_id", "mention_id")


PEOPLE = """WITH p AS (SELECT p_partkey AS person_id, p_name AS name, split_part(p_name, ' ', 1) AS given, split_part(p_name, ' ', 2) AS surname, p_brand AS place, p_size AS age,
CASE WHEN p_partkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender FROM part), r AS (SELECT * FROM p WHERE person_id % 4 <> 0), m AS (SELECT *, person_id AS mention_id FROM p WHERE person_id % 4 = 0)
"""
CASCADE = PEOPLE + """, f AS (SELECT mention_id, r.person_id, r.age = m.age AS same FROM m JOIN r USING (name, place)),
c AS (SELECT mention_id, min(person_id) AS person_id, 1 AS priority, 'exact' AS match_type, 0.95::DOUBLE AS confidence FROM f WHERE same GROUP BY 1 HAVING count(DISTINCT person_id) = 1
UNION ALL SELECT mention_id, min(person_id), 2, 'place', 0.9 FROM f GROUP BY 1 HAVING count(DISTINCT person_id) = 1
UNION ALL SELECT mention_id, min(r.person_id), CASE WHEN count(*) = 1 THEN 3 ELSE 4 END, CASE WHEN count(*) = 1 THEN 'surname' ELSE 'ambiguous' END,
CASE WHEN count(*) = 1 THEN 0.85 ELSE round(0.4::DOUBLE / count(*), 6) END FROM m JOIN r USING (surname) WHERE abs(m.age - r.age) <= 2 GROUP BY 1),
b AS (SELECT mention_id, person_id, match_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY priority, confidence DESC, person_id) AS k FROM c) WHERE k = 1)
"""


@query(PEOPLE + """SELECT mention_id, min(r.gender) AS gender, 0.6::DOUBLE AS confidence FROM m JOIN r USING (name, place) WHERE name NOT IN ('small ring') GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT r.gender) = 1""")
def match_ambiguous_gender(spark: SparkSession, sf: str) -> DataFrame:
    """Several candidates, but of one gender; some names are left out."""
    r, m = register_and_mentions(spark, sf)
    both = m.select("mention_id", "name", "place").join(r.select("name", "place", "gender"), ["name", "place"]).where(~F.col("name").isin("small ring"))
    one = both.groupBy("mention_id").agg(F.count("*").alias("n"), F.countDistinct("gender").alias("g"), F.min("gender").alias("gender"))
    return one.where("n > 1 and g = 1").select("mention_id", "gender", F.lit(0.6).alias("confidence"))


@query(PEOPLE + """SELECT mention_id, arg_min(r.person_id, struct_pack(a := abs(r.age - m.age) > 5, b := r.person_id)) AS person_id FROM m JOIN r USING (name) GROUP BY 1""")
def match_lookup_person(spark: SparkSession, sf: str) -> DataFrame:
    """By name; of several the one who fits the time, else the first. The register is one row for each name and age, and one
    for each name, and a mention looks at the ages that fit it: no pairs of all who bear a name."""
    r, m = register_and_mentions(spark, sf)
    aged = r.groupBy("name", F.col("age").alias("at")).agg(F.min("person_id").alias("fits"))
    named = r.groupBy("name").agg(F.min("person_id").alias("first"))
    near = m.select("mention_id", "name", F.explode(F.sequence(F.col("age") - 5, F.col("age") + 5)).alias("at")).join(aged, ["name", "at"])
    near = near.groupBy("mention_id").agg(F.min("fits").alias("fits"))
    return m.select("mention_id", "name").join(named, "name").join(near, "mention_id", "left").select("mention_id", F.coalesce("fits", "first").alias("person_id"))


@query(CASCADE + """SELECT CASE WHEN match_type IN ('exact', 'place', 'surname') AND confidence >= 0.6 THEN 'accepted' WHEN match_type = 'ambiguous' THEN 'ambiguous' ELSE 'unmatched' END AS state,
CAST(count(*) AS BIGINT) AS n FROM m LEFT JOIN b USING (mention_id) GROUP BY 1""")
def match_accept_filter(spark: SparkSession, sf: str) -> DataFrame:
    r, m = register_and_mentions(spark, sf)
    both = m.select("mention_id").join(cascade(m, r), "mention_id", "left")
    taken = F.col("match_type").isin(*ACCEPTED) & (F.col("confidence") >= CONFIDENT)
    state = F.when(taken, "accepted").when(F.col("match_type") == "ambiguous", "ambiguous").otherwise("unmatched")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(PEOPLE + "SELECT mention_id, r.person_id FROM m LEFT JOIN r ON r.person_id = m.mention_id + 1")
def merge_pass_slug(spark: SparkSession, sf: str) -> DataFrame:
    r, m = register_and_mentions(spark, sf)
    return m.select("mention_id", (F.col("mention_id") + 1).alias("person_id_wanted")).join(r.select("person_id"), F.col("person_id_wanted") == F.col("person_id"), "left").select("mention_id", "person_id")


SCORED = """, z AS (SELECT *, dense_rank() OVER (PARTITION BY mention_id ORDER BY score DESC) AS k FROM y)
SELECT mention_id, min(person_id) AS person_id, round(max(score), 6) AS score, count(*) > 1 AS ambiguous FROM z WHERE k = 1 GROUP BY 1"""


@query(PEOPLE + """, a AS (SELECT person_id, age, unnest([name, surname || ' ' || given, substr(given, 1, 1) || ' ' || surname]) AS alias FROM r),
y AS (SELECT DISTINCT mention_id, a.person_id, CASE WHEN abs(m.age - a.age) <= 5 THEN 1.5::DOUBLE ELSE 1 END AS score FROM m JOIN a ON alias = substr(m.given, 1, 1) || ' ' || m.surname)""" + SCORED)
def merge_pass_alias_key(spark: SparkSession, sf: str) -> DataFrame:
    """By any alias: aliases are rows. People are counted by alias and age, and mentions alike in both are one, so that a common
    alias is no pairs of all who share it."""
    r, m = register_and_mentions(spark, sf)
    initial = F.concat_ws(" ", F.substring("given", 1, 1), "surname")
    aliases = r.select("person_id", F.col("age").alias("at"), F.explode(F.array("name", F.concat_ws(" ", "surname", "given"), initial)).alias("alias")).distinct()
    tell = lambda p, n: [F.min("person_id").alias(p), F.count("*").alias(n)]
    aged, whole = aliases.groupBy("alias", "at").agg(*tell("person", "n")), aliases.groupBy("alias").agg(*tell("some", "all"))
    m = m.select("mention_id", "age", initial.alias("alias"))
    kinds = m.select("alias", "age").distinct()
    near = kinds.withColumn("at", F.explode(F.sequence(F.col("age") - 5, F.col("age") + 5))).join(aged, ["alias", "at"])
    near = near.groupBy("alias", "age").agg(F.min("person").alias("person"), F.sum("n").alias("n"))
    best = kinds.join(whole, "alias").join(near, ["alias", "age"], "left")
    score, n = F.when(F.col("n").isNotNull(), 1.5).otherwise(1.0), F.coalesce("n", "all")
    best = best.select("alias", "age", F.coalesce("person", "some").alias("person_id"), score.alias("score"), (n > 1).alias("ambiguous"))
    return m.join(best, ["alias", "age"]).select("mention_id", "person_id", "score", "ambiguous")


@query(PEOPLE + ", y AS (SELECT mention_id, r.person_id, 1::DOUBLE AS score FROM m JOIN r ON 'lord ' || m.surname || ' of ' || m.place = 'lord ' || r.surname || ' of ' || r.place)" + SCORED)
def merge_pass_lords_alias(spark: SparkSession, sf: str) -> DataFrame:
    """By a peer's title. All who bear it score alike, so people are counted by title, and the first stands."""
    r, m = register_and_mentions(spark, sf)
    title = F.concat(F.lit("lord "), "surname", F.lit(" of "), "place").alias("title")
    held = r.groupBy(title).agg(F.min("person_id").alias("person_id"), F.count("*").alias("n"))
    found = m.select("mention_id", title).join(held, "title").groupBy("mention_id")
    return found.agg(F.min("person_id").alias("person_id"), F.lit(1.0).alias("score"), (F.sum("n") > 1).alias("ambiguous"))


@query(CASCADE + "SELECT mention_id, coalesce(CASE WHEN mention_id % 8 = 0 THEN 'own' END, b.match_type, 'ambiguous') AS label FROM m LEFT JOIN b USING (mention_id)")
def merge_fill_only_missing(spark: SparkSession, sf: str) -> DataFrame:
    """What a row has stays; only nulls are filled, and labelled."""
    r, m = register_and_mentions(spark, sf)
    own = F.when(F.col("mention_id") % 8 == 0, "own")
    return m.select("mention_id").join(cascade(m, r), "mention_id", "left").select("mention_id", F.coalesce(own, "match_type", F.lit("ambiguous")).alias("label"))


@query(PEOPLE + "SELECT mention_id, min(r.person_id) AS person_id FROM m JOIN r USING (place, surname) WHERE abs(m.age - r.age) <= 15 GROUP BY 1 HAVING count(DISTINCT r.person_id) = 1")
def merge_pass_const_unique(spark: SparkSession, sf: str) -> DataFrame:
    """People are counted by place, surname and age, the first and the last of them by id; a mention looks at the ages near its
    own, and has one person alone where these two are the same. No pairs of all who share a place and a surname."""
    r, m = register_and_mentions(spark, sf)
    by = ["place", "surname"]
    held = r.groupBy(*by, F.col("age").alias("at")).agg(F.min("person_id").alias("low"), F.max("person_id").alias("high"))
    kinds = m.select(*by, "age").distinct()
    near = kinds.select("*", F.explode(F.sequence(F.col("age") - 15, F.col("age") + 15)).alias("at")).join(held, [*by, "at"])
    near = near.groupBy(*by, "age").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = m.select("mention_id", *by, "age").join(near, [*by, "age"]).groupBy("mention_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return found.where("low = high").select("mention_id", F.col("low").alias("person_id"))


@query(PEOPLE + """, y AS (SELECT mention_id, r.person_id, greatest(0, least(m.age + 5, r.age + 5) - greatest(m.age, r.age) + 1) AS years FROM m JOIN r USING (place))
SELECT mention_id, min(person_id) AS person_id, CAST(min(years) AS BIGINT) AS years FROM y WHERE years >= 5 GROUP BY 1 HAVING count(DISTINCT person_id) = 1""")
def merge_pass_const_time(spark: SparkSession, sf: str) -> DataFrame:
    """Equal places and terms of six years that share five: ages at most one apart, so place and age are the join's key."""
    r, m = register_and_mentions(spark, sf)
    held = r.groupBy("place", F.col("age").alias("at")).agg(F.min("person_id").alias("person_id"), F.countDistinct("person_id").alias("n"))
    pairs = m.select("mention_id", "place", "age", F.explode(F.sequence(F.col("age") - 1, F.col("age") + 1)).alias("at")).join(held, ["place", "at"])
    years = (6 - F.abs(F.col("age") - F.col("at"))).cast("long")
    found = pairs.groupBy("mention_id").agg(F.min("person_id").alias("person_id"), F.min(years).alias("years"), F.sum("n").alias("n"))
    return found.where("n = 1").drop("n")


#: Ranks that two names may share besides their core.
RANKS = ("small", "large")


def fuzzy_pass(mentions: DataFrame, register: DataFrame, least: float, bonus: float = 0.0, longest: int | None = None) -> DataFrame:
    """(mention_id, person_id, score, years): mentions whose tokens overlap in `least` with one person alone, among those
    whose terms share years. Both sides have tokens, rank, begins and ends; a shared rank adds `bonus` to the score.
    longest: the most tokens of a row, if known.

    People are counted by the tokens that must agree and by year: the first and the last of them by id. A mention that meets
    one person alone everywhere is compared with that person; no pairs are made of all who agree."""
    side = lambda d, key: d.select(key, set_of(F.col("tokens")).alias("tokens"), "rank", "begins", "ends").where("begins <= ends")
    m, r, kind = side(mentions, "mention_id"), side(register, "person_id"), ["tokens", "begins", "ends"]
    wanted, years = sizes(least, m, r), F.explode(F.sequence("begins", "ends")).alias("year")
    one = lambda c, where=F.lit(True): [f(F.when(where, F.col(x))).alias(x + c) for f, x in ((F.min, "low"), (F.max, "high"))]
    people = r.groupBy(*kind).agg(F.min("person_id").alias("low"), F.max("person_id").alias("high"))
    people = keyed(people, wanted).groupBy("held", "key", "own", "begins", "ends").agg(*one(""))
    people = people.select("held", "key", "own", "low", "high", years).groupBy("held", "key", "year").agg(*one(""), *one("_own", F.col("own")))
    asked = keyed(m.select(*kind).distinct(), wanted).select("*", years)
    # Two sets meet by the smaller one's size: any person may answer a mention of that size, else only people of it.
    met = asked.join(people, ["held", "key", "year"])
    met = met.groupBy(*kind).agg(*[f(F.when(F.col("own"), F.col(x)).otherwise(F.col(f"{x}_own"))).alias(x) for f, x in ((F.min, "low"), (F.max, "high"))])
    met = m.join(met, kind).select("mention_id", "low", "high")
    if longest is None or longest > SHORT:
        met = met.unionByName(_long_sets(m, r, least))
    alone = met.groupBy("mention_id").agg(*one("")).where("low = high").select("mention_id", F.col("low").alias("person_id"))
    a, b = (d.select(key, *[F.col(c).alias(f"{c}_{x}") for c in ("tokens", "rank", "begins", "ends")]) for d, key, x in ((m, "mention_id", "a"), (r, "person_id", "b")))
    both = alone.join(a, "mention_id").join(b, "person_id").withColumn("years", overlap_years(*[F.col(c) for c in ("begins_a", "ends_a", "begins_b", "ends_b")]))
    both = both.withColumn("ratio", F.size(F.array_intersect("tokens_a", "tokens_b")) / F.least(F.size("tokens_a"), F.size("tokens_b"))).where((F.col("years") > 0) & (F.col("ratio") >= least))
    score = F.col("ratio") + F.when(F.col("rank_a") == F.col("rank_b"), bonus).otherwise(0.0)
    found = both.groupBy("mention_id").agg(F.min("person_id").alias("person_id"), F.max(score).alias("score"), F.max("years").cast("long").alias("years"), F.count("*").alias("n"))
    return found.where("n = 1").drop("n")


def _long_sets(m: DataFrame, r: DataFrame, least: float) -> DataFrame:
    """(mention_id, low, high) for the pairs of which a side has more tokens than SHORT."""
    side = lambda d, key, c: d.select(F.col(key).alias(c), "tokens")
    long = F.size("tokens") > SHORT
    pairs = token_overlap(side(m.where(long), "mention_id", "a"), side(r, "person_id", "b"), least)
    pairs = pairs.unionByName(token_overlap(side(m.where(~long), "mention_id", "a"), side(r.where(long), "person_id", "b"), least))
    a, b = (d.select(F.col(key).alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("begins", "ends")]) for d, key, c in ((m, "mention_id", "a"), (r, "person_id", "b")))
    both = pairs.join(a, "a").join(b, "b").where("begins_a <= ends_b and begins_b <= ends_a")
    return both.groupBy(F.col("a").alias("mention_id")).agg(F.min("b").alias("low"), F.max("b").alias("high"))


FUZZY = PEOPLE + """, x AS (SELECT p_partkey AS id, p_type AS kind, p_retailprice AS price FROM part),
a AS (SELECT mention_id, age, given AS rank, list_distinct([{words}]) AS t FROM m JOIN x ON id = mention_id),
c AS (SELECT r.person_id, age, given AS rank, list_distinct([{words}]) AS t FROM r JOIN x ON id = r.person_id),
y AS (SELECT mention_id, person_id, len(list_intersect(a.t, c.t)) / least(len(a.t), len(c.t)) AS ratio, a.rank = c.rank AND a.rank IN ('small', 'large') AS ranked, 6 - abs(a.age - c.age) AS years FROM a, c),
k AS (SELECT * FROM y WHERE ratio >= {least} AND years > 0)
SELECT mention_id, min(person_id) AS person_id, round(max(ratio + CASE WHEN ranked THEN {bonus} ELSE 0 END), 6) AS score, CAST(max(years) AS BIGINT) AS years FROM k GROUP BY mention_id HAVING count(*) = 1"""


def _fuzzy(spark: SparkSession, sf: str, words: list[str], least: float, bonus: float) -> DataFrame:
    more = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").cast("string").alias("price"))
    tokens = F.array_distinct(F.array(*[F.col(w) for w in words])).alias("tokens")
    rank = F.when(F.col("given").isin(*RANKS), F.col("given")).alias("rank")
    side = lambda d, key: d.join(more, F.col(key) == F.col("id")).select(key, tokens, rank, F.col("age").alias("begins"), (F.col("age") + 5).alias("ends"))
    r, m = register_and_mentions(spark, sf)
    return fuzzy_pass(side(m, "mention_id"), side(r, "person_id"), least, bonus, len(words)).withColumn("score", F.round("score", 6))


@query(FUZZY.format(words="place, kind, surname, price::VARCHAR", least=0.67, bonus=0))
def merge_pass_const_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Places whose words mostly agree, terms that share years, one person alone."""
    return _fuzzy(spark, sf, ["place", "kind", "surname", "price"], 0.67, 0.0)


@query(FUZZY.format(words="given, surname, place, kind, price::VARCHAR", least=0.6, bonus=0.05))
def merge_pass_name_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Names whose core mostly agrees, and a little more for a shared rank; terms that share years, one person alone."""
    return _fuzzy(spark, sf, ["given", "surname", "place", "kind", "price"], 0.6, 0.05)


@query(CASCADE + "SELECT mention_id, CASE WHEN match_type = 'ambiguous' AND person_id IS NOT NULL THEN 'constituency_fallback' ELSE match_type END AS label FROM b")
def merge_finalise_labels(spark: SparkSession, sf: str) -> DataFrame:
    r, m = register_and_mentions(spark, sf)
    late = (F.col("match_type") == "ambiguous") & F.col("person_id").isNotNull()
    return cascade(m, r).select("mention_id", F.when(late, "constituency_fallback").otherwise(F.col("match_type")).alias("label"))


@query(CASCADE + "SELECT person_id, 'register' AS origin FROM r UNION ALL SELECT mention_id, 'mention' FROM m WHERE mention_id NOT IN (SELECT mention_id FROM b)")
def merge_append_hansard_only(spark: SparkSession, sf: str) -> DataFrame:
    """What the register lacks is appended with where it comes from."""
    r, m = register_and_mentions(spark, sf)
    alone = m.join(cascade(m, r), "mention_id", "left_anti").select(F.col("mention_id").alias("person_id"), F.lit("mention").alias("origin"))
    return r.select("person_id", F.lit("register").alias("origin")).unionByName(alone)


@query(SPEECHES + "SELECT debate_id, sequence_number, lower(speaker) AS speaker, word_count, CAST(length(text) AS BIGINT) AS char_count FROM s WHERE debate_id IN (SELECT debate_id FROM s WHERE gender = 'M')")
def turnwise_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of debates with a match only. They are rows already, so a semi join keeps them; no debate is put in an array."""
    s = speeches(spark, sf)
    turns = s.join(s.where("gender = 'M'").select("debate_id").distinct(), "debate_id", "left_semi")
    return turns.select("debate_id", "sequence_number", F.lower("speaker").alias("speaker"), "word_count", F.length("text").cast("long").alias("char_count"))


@query(SPEECHES + """, c AS (SELECT speech_id, CASE WHEN sequence_number % 5 = 0 THEN 'UPDATE' WHEN sequence_number % 7 = 0 THEN 'EXCLUDE' END AS action FROM s)
SELECT speech_id, CASE WHEN action = 'UPDATE' THEN 'corrected' ELSE speaker END AS speaker FROM s JOIN c USING (speech_id) WHERE action IS DISTINCT FROM 'EXCLUDE'""")
def apply_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Updates by a left join, exclusions by an anti join."""
    s = speeches(spark, sf)
    n = F.col("sequence_number")
    fixes = s.select("speech_id", F.when(n % 5 == 0, "UPDATE").when(n % 7 == 0, "EXCLUDE").alias("action"), F.lit("corrected").alias("value")).where("action is not null")
    kept = s.join(fixes.where("action = 'EXCLUDE'").select("speech_id"), "speech_id", "left_anti")
    return kept.join(fixes.where("action = 'UPDATE'"), "speech_id", "left").select("speech_id", F.coalesce("value", "speaker").alias("speaker"))


def classify(rows: DataFrame, client: object, fields: str, key: str = "speech_id", done: DataFrame | None = None, retries: int = 3, calls: int = 0, wait: float = 0.0) -> DataFrame:
    """(key, fields..., error): each row asked of an outside model. client(text) gives a dict; what fails after its retries
    is a row with the error. Rows that are in `done` are not asked again. calls: partitions that
    call at a time. wait: seconds before the second try, doubled before each further one."""

    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(x.strip().split(" ")[0] for x in fields.split(",")), "error"]
    shape = StructType.fromDDL(f"{key} {kind}, {fields}, error string")
    arrow = to_arrow_schema(shape)

    def ask(batches: Iterator) -> Iterator:
        import time

        import pyarrow as pa

        for batch in batches:
            out = []
            for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
                error = None
                for nth in range(retries):
                    if nth and wait:
                        time.sleep(wait * 2 ** (nth - 1))
                    try:
                        out.append({key: k, **client(text), "error": None})
                        break
                    except Exception as e:  # noqa: BLE001  any failure of the outside model is this row's own
                        error = f"{type(e).__name__}: {e}"
                else:
                    out.append({key: k, "error": error})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], arrow.field(c).type) for c in names], schema=arrow)

    open_rows = rows.select(key, "text") if done is None else rows.select(key, "text").join(done.select(key), key, "left_anti")
    open_rows = open_rows.repartition(calls) if calls else open_rows
    return open_rows.mapInArrow(ask, shape)


def _stub(text: str | None) -> dict:
    if not text:
        raise ValueError("empty")
    return {"stance": "for" if len(text) % 2 else "against", "confidence": 0.5}
