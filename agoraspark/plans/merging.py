"""Merging members with a list of people by name keys, scored by names, lifetimes, seats and their years.

Rows that agree in all that a score looks at are one kind, with their number; kinds are paired by the whole name key, never
by a surname or an initial. So a name that very many bear is as many pairs as its kinds have, not its rows.

Edge cases: null years and seats add nothing; a name without a given part matches nothing; of equals the smallest slug
stands, and says that it is ambiguous; member ids are unique; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.functions.names import name_tokens
from agoraspark.plans import cascade
from agoraspark.registry import query


def time_bonus(begins: Column, ends: Column, born: Column, died: Column) -> Column:
    """How well years of membership fit a life."""
    at = lambda test, value, other=0.0: F.when(test, value).otherwise(other)  # noqa: E731  a null test is no test passed
    age = begins - born
    return (
        F.when(age.between(18, 100), 1.0).when(age < 16, -1.0).otherwise(0.0)
        + at(died < begins, -1.0) + at(born > ends, -1.0) + at(died < ends, -0.5)
        + at((born <= begins) & (begins <= died) & (born <= ends) & (ends <= died), 0.5)
    )


def seat_score(seat: Column, seats: Column) -> Column:
    """2 for a seat among the seats; 1.5 or 1 for one that shares most or some of its words with one of them; else 0."""
    own = F.split(seat, " ")

    def shared(other: Column) -> Column:
        words = F.split(other, " ")
        j = F.size(F.array_intersect(own, words)) / F.size(F.array_union(own, words))
        return F.when(j >= 0.6, 1.5).when(j >= 0.3, 1.0).otherwise(0.0)

    return F.when(seat.isNull() | F.coalesce(F.size(seats) < 1, F.lit(True)), 0.0).when(F.array_contains(seats, seat), 2.0).otherwise(F.coalesce(F.array_max(F.transform(seats, shared)), F.lit(0.0)))


def window_score(begins: Column, ends: Column, windows: Column) -> Column:
    """1 if the first window that tells overlaps the years, 0.5 if it is two years off at most; windows: (s, e) of the seat."""
    low, high = F.coalesce(begins, ends), F.coalesce(ends, begins)

    def each(w: Column) -> Column:
        s, e = F.coalesce(w["s"], low), F.coalesce(w["e"], w["s"], low)
        return F.when(w["s"].isNull() & w["e"].isNull(), 0.0).when((high >= s) & (low <= e), 1.0).when((F.abs(low - e) <= 2) | (F.abs(s - high) <= 2), 0.5).otherwise(0.0)

    told = F.filter(F.transform(windows, each), lambda x: x > 0)
    return F.when(low.isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(told, F.lit(1)), F.lit(0.0)))


def seat_key(place: Column) -> Column:
    """A seat's words, lower case, without of, and, the."""
    words = F.split(F.regexp_replace(F.replace(F.lower(place), F.lit("&"), F.lit(" and ")), r"[^\w\s]", " "), r"\s+")
    return F.nullif(F.array_join(F.filter(words, lambda w: ~w.isin("", "of", "and", "the")), " "), F.lit(""))


def name_key_pass(members: DataFrame, people: DataFrame) -> DataFrame:
    """(member_id, slug, score, ambiguous, resolved) of members that have candidates: the best by score; resolved: of several
    equals, the one by seat, its years and given names.

    members: member_id, name, begins, ends, seat. people: slug, name, born, died, seats (place, s, e)."""
    tokens = lambda c: F.array_sort(F.array_distinct(name_tokens(F.col(c))))
    m = members.select("member_id", tokens("name").alias("key"), "begins", "ends", seat_key(F.col("seat")).alias("seat"))
    held = F.transform("seats", lambda x: F.struct(seat_key(x["place"]).alias("place"), x["s"].alias("s"), x["e"].alias("e")))
    p = people.select("slug", tokens("name").alias("key"), "born", "died", F.coalesce(held, F.array().cast("array<struct<place: string, s: int, e: int>>")).alias("seats"))
    like_m, like_p = ["key", "begins", "ends", "seat"], ["key", "born", "died", "seats"]
    kinds = m.select(*like_m).where("size(key) > 1").distinct()
    others = p.where("size(key) > 1").groupBy(*like_p).agg(F.min("slug").alias("slug"), F.count("*").alias("n"))
    given = F.size("key") - 1  # the surname is the longest word of the key; both sides have the same
    seat, places = F.col("seat"), F.transform("seats", lambda x: x["place"])
    own = F.filter("seats", lambda x: x["place"] == seat)
    both = kinds.join(others, "key").withColumn("by_seat", seat_score(seat, F.filter(places, lambda x: x.isNotNull()))).withColumn("by_years", window_score(F.col("begins"), F.col("ends"), own))
    names = F.least(F.lit(2), given) + 0.5 + 0.1 * F.floor(F.length(F.array_join("key", " ")) / 5)
    both = both.withColumn("score", F.round(names + time_bonus(F.col("begins"), F.col("ends"), F.col("born"), F.col("died")) + F.col("by_seat") + F.col("by_years"), 6))
    # By score first, with partial sums; then a kind's scores are few.
    scored = both.groupBy(*like_m, "score").agg(
        F.sum("n").alias("n"), F.min("slug").alias("slug"), F.min(F.struct((-F.col("by_seat")).alias("a"), (-F.col("by_years")).alias("b"), "slug")).alias("x")
    )
    best = scored.groupBy(*like_m).agg(F.max_by(F.struct("score", "n", "slug", "x"), "score").alias("t")).select(*like_m, "t.*")
    best = best.select(*like_m, "score", "slug", (F.col("n") > 1).alias("ambiguous"), F.when(F.col("n") > 1, F.col("x.slug")).otherwise(F.col("slug")).alias("resolved"))
    out = m.alias("m").join(best.alias("f"), [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in like_m])
    return out.select("m.member_id", "f.slug", "f.score", "f.ambiguous", "f.resolved")


_MERGE = cascade.TABLES + r""", w AS (SELECT nth AS member_id, list_sort(list_distinct(list_filter(string_split(lower(person_name), ' '), lambda x: length(x) > 1))) AS key, start_year AS b, end_year AS e,
  CASE WHEN nth % 3 > 0 THEN lower(seat) END AS seat FROM r WHERE nth % 2 = 1),
h AS (SELECT 's' || nth AS slug, list_sort(list_distinct(list_filter(string_split(lower(person_name), ' '), lambda x: length(x) > 1))) AS key, CASE WHEN nth % 7 > 0 THEN start_year - 12 - nth % 70 END AS born,
  CASE WHEN nth % 5 > 0 THEN start_year + nth % 30 END AS died, lower(seat) AS place, start_year - 1 AS s, start_year + 1 AS t FROM r WHERE nth % 2 = 0 OR nth % 10 = 1),
j AS (SELECT *, len(list_intersect(string_split(seat, ' '), string_split(place, ' '))) / len(list_distinct(list_concat(string_split(seat, ' '), string_split(place, ' ')))) AS j FROM w JOIN h USING (key) WHERE len(key) > 1),
y AS (SELECT *, CASE WHEN seat = place THEN 2 WHEN j >= 0.6 THEN 1.5 WHEN j >= 0.3 THEN 1 ELSE 0 END AS by_seat,
  CASE WHEN seat = place THEN CASE WHEN coalesce(e, b) >= s AND b <= t THEN 1 WHEN abs(b - t) <= 2 OR abs(s - coalesce(e, b)) <= 2 THEN 0.5 ELSE 0 END ELSE 0 END AS by_years,
  CASE WHEN b - born BETWEEN 18 AND 100 THEN 1.0 WHEN b - born < 16 THEN -1.0 ELSE 0 END - CASE WHEN died < b THEN 1.0 ELSE 0 END - CASE WHEN born > e THEN 1.0 ELSE 0 END - CASE WHEN died < e THEN 0.5 ELSE 0 END
  + CASE WHEN born <= b AND b <= died AND born <= e AND e <= died THEN 0.5 ELSE 0 END AS by_life FROM j),
z AS (SELECT *, round((least(2, len(key) - 1) + 0.5 + 0.1 * (length(array_to_string(key, ' ')) // 5) + by_life + by_seat + by_years)::DOUBLE, 6) AS score FROM y),
k AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY member_id ORDER BY score DESC) AS k FROM z) WHERE k = 1)
"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    _, r = cascade.written(spark, sf)
    n, seat, start = F.col("nth"), F.col("constituencies")[0], F.col("start_year")
    members = r.where("nth % 2 = 1").select(n.alias("member_id"), F.col("person_name").alias("name"), start.alias("begins"), F.col("end_year").alias("ends"), F.when(n % 3 > 0, seat).alias("seat"))
    people = r.where("nth % 2 = 0 or nth % 10 = 1").select(
        F.concat(F.lit("s"), n.cast("string")).alias("slug"), F.col("person_name").alias("name"), F.when(n % 7 > 0, start - 12 - n % 70).alias("born"), F.when(n % 5 > 0, start + n % 30).alias("died"),
        F.array(F.struct(seat.alias("place"), (start - 1).alias("s"), (start + 1).alias("e"))).alias("seats"),
    )
    return members, people


@query(_MERGE + "SELECT member_id AS mention_id, min(slug) AS person_id, max(score) AS score, count(*) > 1 AS ambiguous FROM k GROUP BY 1")
def merge_pass_name_key(spark: SparkSession, sf: str) -> DataFrame:
    """Equal name keys, scored by names, lifetimes, seats and their years."""
    return name_key_pass(*_sides(spark, sf)).select(F.col("member_id").alias("mention_id"), F.col("slug").alias("person_id"), "score", "ambiguous")


@query(_MERGE + "SELECT member_id AS mention_id, arg_min(slug, struct_pack(a := -by_seat, b := -by_years, c := slug)) AS person_id FROM k GROUP BY 1 HAVING count(*) > 1")
def merge_resolve_constituency(spark: SparkSession, sf: str) -> DataFrame:
    """Those with several equal candidates, by seat and by its years."""
    return name_key_pass(*_sides(spark, sf)).where("ambiguous").select(F.col("member_id").alias("mention_id"), F.col("resolved").alias("person_id"))
