"""Joins on one string inside another, by pieces that both must have.

Pieces have one of a few lengths, SIZES. A string lies in a name only if its rarest piece does, of the greatest length that it
has room for: so a piece is over half of its string, up to the last of SIZES, and few names that have it lack the string. Names are entered under all
their pieces of the lengths that strings ask for, each once, and every distinct string is looked up under one piece. What
meets is compared; no product of the two sides is formed.

Edge cases: letters are compared whatever their case; null and empty strings lie in nothing; wild marks stand for
themselves; repeated strings are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.plans import cascade
from agoraspark.registry import query

SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: What is no part of a surname, and officers who are no members.
TITLES, OFFICES = ("Mr.", "Mrs.", "Miss", "Dr.", "Sir"), ("Deputy", "Speaker")


def pieces(text: Column, size: Column) -> Column:
    """The distinct pieces of so many letters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(strings: DataFrame, names: DataFrame, string: str, name: str) -> DataFrame:
    """(string, name): distinct strings with the distinct names that they lie in."""
    short = strings.where(F.length(string) > 0).select(F.col(string).alias("own")).distinct().withColumn("s", F.lower("own"))
    long = names.where(F.length(name) > 0).select(F.col(name).alias("full")).distinct().withColumn("t", F.lower("full"))
    fitting = lambda x: F.filter(F.array(*map(F.lit, SIZES)), lambda k: k <= F.length(x))
    short = short.withColumn("size", F.element_at(fitting("s"), -1))
    entered = long.select("full", "t", F.explode(fitting("t")).alias("size")).join(F.broadcast(short.select("size").distinct()), "size")
    entered = entered.select("full", "t", F.explode(pieces(F.col("t"), F.col("size"))).alias("piece"))
    often = entered.groupBy("piece").agg(F.count("*").alias("often"))
    s = F.col("s")
    asked = short.select("own", "s", F.explode(pieces(s, F.col("size"))).alias("piece"))
    # A string with a piece that no name has lies in none: the missing piece is its rarest. Sides that grow are not broadcast.
    rare = asked.join(often.hint("merge"), "piece", "left").groupBy("own", "s").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece")).alias("x"))
    rare = rare.where("x.often > 0").select("own", "s", F.col("x.piece").alias("piece"))
    return rare.join(entered.hint("merge"), "piece").where(F.contains("t", s)).select(F.col("own").alias(string), F.col("full").alias(name))


def surname(speaker: Column) -> Column:
    """The last word of a speaker without titles; null of an officer and of nothing."""
    plain = speaker
    for t in TITLES:
        plain = F.replace(plain, F.lit(t), F.lit(""))
    officer = F.contains(speaker, F.lit(OFFICES[0])) | F.contains(speaker, F.lit(OFFICES[1]))
    return F.when(~officer, F.nullif(F.element_at(F.split(F.trim(plain), r"\s+"), -1), F.lit("")))


def active_member(mentions: DataFrame, register: DataFrame) -> DataFrame:
    """(mention_id, stints, person_id, person_name, gender) of every mention with a surname: how many stints of the register
    whose name holds it were active in its year; and whose, if there is one alone.

    mentions: mention_id, speaker, year. register: person_id, person_name, gender, start_year, end_year."""
    asked = mentions.select("mention_id", "year", surname(F.col("speaker")).alias("surname")).where("surname is not null")
    # A surname has no blanks, so it lies in one word of a name, and words are fewer than names.
    r = register.where("start_year <= end_year").groupBy("person_name", "start_year", "end_year")
    r = r.agg(F.count("*").alias("n"), F.min(F.struct("person_id", "person_name", "gender")).alias("one"))
    each = r.withColumn("words", F.array_distinct(F.split(F.lower("person_name"), r"\s+"))).select("*", F.explode("words").alias("word"))
    kinds = asked.where("year is not null").groupBy("surname").agg(F.collect_set("year").alias("years"))
    held = contained(kinds, each, "surname", "word").join(kinds.hint("merge"), "surname")
    held = held.select("*", F.lower("surname").alias("low"), F.array_min("years").alias("from"), F.array_max("years").alias("to"))
    met = held.join(each.hint("merge"), "word").where("`from` <= end_year and `to` >= start_year")
    # A name with the surname in several words is met in the first of them.
    met = met.where(F.get(F.filter("words", lambda w: F.contains(w, F.col("low"))), 0) == F.col("word"))
    active = F.explode(F.filter("years", lambda y: y.between(F.col("start_year"), F.col("end_year"))))
    found = met.select("surname", active.alias("year"), "n", "one").groupBy("surname", "year").agg(F.sum("n").alias("stints"), F.min("one").alias("one"))
    one = lambda c: F.when(F.col("stints") == 1, F.col(f"one.{c}")).alias(c)
    out = asked.join(found.hint("merge"), ["surname", "year"], "left").withColumn("stints", F.coalesce("stints", F.lit(0)))
    return out.select("mention_id", "stints", one("person_id"), one("person_name"), one("gender"))


@query(cascade.TABLES + r"""
, a AS (SELECT mention_id, date_part('year', date) AS year, nullif(string_split_regex(trim(replace(replace(replace(replace(replace(speaker, 'Mr.', ''), 'Mrs.', ''), 'Miss', ''), 'Dr.', ''), 'Sir', '')), '\s+')[-1], '') AS surname
  FROM m WHERE NOT contains(speaker, 'Deputy') AND NOT contains(speaker, 'Speaker')),
b AS (SELECT mention_id, count(nth) AS stints, min(person_id) AS person_id, min(person_name) AS person_name, min(gender) AS gender
  FROM a LEFT JOIN r ON contains(lower(person_name), lower(surname)) AND year BETWEEN start_year AND end_year WHERE surname IS NOT NULL GROUP BY mention_id)
SELECT mention_id, stints, CASE WHEN stints = 1 THEN person_id END AS person_id, CASE WHEN stints = 1 THEN person_name END AS person_name, CASE WHEN stints = 1 THEN gender END AS gender FROM b""")
def join_active_member_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A surname inside the names of those active in its year."""
    mentions, register = cascade.written(spark, sf)
    return active_member(mentions.withColumn("year", F.year("date")), register)
