"""Scores of the name-key merge and its ties, on cases written by hand."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from agoraspark.plans import linkage, merging
from agoraspark.queries import ORACLES


def test_scores(spark):
    life = [((1900, 1910, 1860, 1920), 1.5), ((1900, 1910, 1890, 1920), -0.5), ((1900, 1910, 1860, 1899), 1.0 - 1.0 - 0.5), ((1900, 1910, 1860, 1905), 0.5), ((None, 1910, 1920, None), -1.0), ((1900, None, None, None), 0.0), ((1900, 1910, 1884, 1990), 0.5), ((None,) * 4, 0.0)]
    rows = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(life)], "i int, a int, b int, c int, d int")
    assert dict(rows.select("i", merging.time_bonus(*[F.col(x) for x in "abcd"])).collect()) == {i: s for i, (_, s) in enumerate(life)}
    seats = [(("leeds north", ["york", "leeds north"]), 2.0), (("leeds north", ["leeds"]), 1.0), (("leeds north east", ["leeds north"]), 1.5), (("a b c d", ["a x y z"]), 0.0), (("x", []), 0.0), (("x", None), 0.0), ((None, ["x"]), 0.0)]
    rows = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(seats)], "i int, a string, b array<string>")
    assert dict(rows.select("i", merging.seat_score(F.col("a"), F.col("b"))).collect()) == {i: s for i, (_, s) in enumerate(seats)}
    windows = [((1900, 1910, [(1905, 1906)]), 1.0), ((1900, 1910, [(1912, None)]), 0.5), ((1900, 1910, [(None, None), (1800, 1801), (1890, 1899)]), 0.5), ((1900, None, [(1913, 1915)]), 0.0), ((None, None, [(1, 2)]), 0.0), ((1900, 1910, []), 0.0), ((1900, 1910, None), 0.0), ((None, 1910, [(None, 1910)]), 1.0)]
    rows = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(windows)], "i int, a int, b int, w array<struct<s: int, e: int>>")
    assert dict(rows.select("i", merging.window_score(F.col("a"), F.col("b"), F.col("w"))).collect()) == {i: s for i, (_, s) in enumerate(windows)}
    keys = {"The County of Leeds & York": "county leeds york", "of the": None, "": None, None: None, "St. Ives": "st ives"}
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    assert [r[1] for r in sorted(rows.select("i", merging.seat_key(F.col("k"))).collect())] == list(keys.values())


def test_name_keys(spark):
    members = [
        (1, "Smith, John", 1900, 1910, "York"), (2, "Mr. John Smith", 1900, 1910, None), (3, "John Smith", 1800, 1810, "Hull"), (4, "Smith", 1900, 1910, "York"), (5, "Jane Brown", None, None, None), (6, None, 1900, 1910, "York"), (7, "No Body", 1900, 1910, "York"),
        (8, "Jane Brown", None, None, "Leeds of the North"),
    ]
    people = [
        ("js1", "John Smith", 1860, 1930, [("York", 1899, 1912)]), ("js2", "JOHN SMITH", 1860, 1930, [("Bath", 1899, 1912)]), ("js3", "Smith John", 1770, 1820, []), ("s", "Smith", 1860, 1930, [("York", 1899, 1912)]),
        ("jb1", "Jane Brown", None, None, None), ("jb2", "Brown Jane", None, None, [("Leeds North", 1950, 1960)]),
    ]
    m = spark.createDataFrame([(*r, "x", 1) for r in members], "member_id int, name string, begins int, ends int, seat string, slug string, n int")
    p = spark.createDataFrame([(*r, "x") for r in people], "slug string, name string, born int, died int, seats array<struct<place: string, s: int, e: int>>, seat string")
    got = {r[0]: tuple(r)[1:] for r in merging.name_key_pass(m, p).collect()}
    names = 1 + 0.5 + 0.1 * (len("john smith") // 5)
    assert got == {
        1: ("js1", pytest.approx(names + 1.5 + 2 + 1), False, "js1"), 2: ("js1", pytest.approx(names + 1.5), True, "js1"), 3: ("js3", pytest.approx(names + 1.5), False, "js3"),
        5: ("jb1", pytest.approx(names), True, "jb1"), 8: ("jb2", pytest.approx(names + 2), False, "jb2"),
    }


def test_a_common_name_is_paired_by_kinds(spark):
    """Thousands of one name: what meets is kinds, not rows."""
    m = spark.range(3000).select(F.col("id").alias("member_id"), F.lit("John Smith").alias("name"), (F.lit(1900) + F.col("id") % 3).cast("int").alias("begins"), F.lit(1910).alias("ends"), F.lit(None).cast("string").alias("seat"))
    p = spark.range(4000).select(F.concat(F.lit("p"), F.lpad("id", 4, "0")).alias("slug"), F.lit("John Smith").alias("name"), (F.lit(1850) + F.col("id") % 2).cast("int").alias("born"), F.lit(1930).alias("died"), F.lit(None).cast("array<struct<place: string, s: int, e: int>>").alias("seats"))
    got = merging.name_key_pass(m, p)
    assert got.count() == 3000 and {(r["slug"], r["ambiguous"]) for r in got.select("slug", "ambiguous").distinct().collect()} == {("p0000", True)}


def hot_parts(spark, folder):
    """Many of one name and place, some alone in theirs, nulls."""
    rnd = random.Random(9)
    names = ["small ring"] * 60 + [f"n{i} s{i % 9}" for i in range(40)] + ["", None]
    rows = [(i, rnd.choice(names), rnd.choice(["Brand#1"] * 5 + [f"Brand#{i % 7}", None]), "KIND", rnd.choice([*range(1, 51), None]), 1.0) for i in range(900)]
    rows += [(2000 + i, "small ring", "Brand#9", "KIND", 20 * (i % 8), 1.0) for i in range(12)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return duck


def most_rows(df):
    """The rows that the largest operator of a query has made."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        rows = node.metrics().get("numOutputRows")
        found += [rows.get().value()] if rows.isDefined() else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def agrees(spark, name, folder):
    """The query gives what its SQL gives on hot_parts, and how many rows that are."""
    duck = hot_parts(spark, folder)
    df = getattr(linkage, name)(spark, str(folder))
    columns = sorted(df.columns)
    want = sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
    return df, len(want)


def test_one_person_of_a_place_and_surname(spark, tmp_path):
    """Pairs of all who share a place and a surname would be over ten thousand rows."""
    df, n = agrees(spark, "merge_pass_const_unique", tmp_path)
    assert n > 2 and most_rows(df) <= 8000


def test_titles_are_counted(spark, tmp_path):
    df, n = agrees(spark, "merge_pass_lords_alias", tmp_path)
    assert n > 50 and most_rows(df) <= 1000


@pytest.mark.parametrize("name", ["merge_finalise_labels", "merge_append_hansard_only", "merge_fill_only_missing", "match_accept_filter"])
def test_a_common_name_and_place_make_no_pairs(spark, tmp_path, name):
    """A name and place that over half of all share: the cascade's joins make no more rows than its tables have keys and ages."""
    df, n = agrees(spark, name, tmp_path)
    assert n >= 2 and most_rows(df) <= 3000


def test_the_cascade_knows_one_person_from_two(spark):
    """Exact before place before surname, an unknown age, and people who stand twice."""
    shape = "{} long, name string, surname string, place string, age int"
    r = [(1, "a s", "s", "x", 10), (1, "a s", "s", "x", 30), (2, "a t", "t", "x", 10), (3, "a t", "t", "x", 20), (4, "b u", "u", "y", 5), (5, "c u", "u", "y", 6), (6, "d v", "v", "z", 9), (7, "d v", "v", "z", None)]
    m = [(10, "a s", "s", "x", None), (11, "a t", "t", "x", 20), (12, "a t", "t", "x", 40), (13, "q u", "u", "q", 4), (14, "q u", "u", "q", 3), (15, "d v", "v", "z", None), (16, None, "v", None, 8), (17, None, None, None, None)]
    got = linkage.cascade(spark.createDataFrame(m, shape.format("mention_id")), spark.createDataFrame(r, shape.format("person_id"))).collect()
    assert {x[0]: tuple(x)[1:] for x in got} == {10: (1, "place", 0.9), 11: (3, "exact", 0.95), 13: (4, "ambiguous", 0.2), 14: (4, "surname", 0.85), 16: (6, "surname", 0.85)} and len(got) == 5
