"""Exact quantiles, sketches, substring joins, yearly states and short speakers, against plain Python."""

from __future__ import annotations

import collections
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_merging import most_rows

from agoraspark.operators import containment, selection, windows
from agoraspark.plans import incremental


def values(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.5, -2.0, rnd.gauss(0, 9), float(rnd.randrange(20))])) for _ in range(700)]
    rows += [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0)] + [("same", 7.0)] * 300
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("nearest", [False, True])
def test_exact_quantiles(spark, nearest):
    rows, df = values(spark)
    at = {"p0": 0.0, "p10": 0.1, "q25": 0.25, "mid": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in selection.exact_quantiles(df, "g", "v", at, nearest).collect()}
    by = collections.defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        for name, p in at.items():
            want = sorted(vs)[math.floor((len(vs) - 1) * p + 0.5)] if nearest else pd.Series(vs).quantile(p)
            assert got[g][name] == pytest.approx(want, abs=1e-9), (g, name)
    assert selection.exact_quantiles(df.limit(0), "g", "v", at).count() == 0


def test_no_task_holds_a_group(spark):
    """Equal values are one row, and a group of many values lies in many ranges, each numbered by itself."""
    df = spark.range(200_000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 200_003).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = selection.exact_quantiles(df, "g", "v", {"mid": 0.5})
        got = found.first()["mid"]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == float(pd.Series([i * 7919 % 200_003 for i in range(200_000)]).quantile(0.5))
    assert "percentile" not in plan and "Cartesian" not in plan


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("year"), F.lit("x").alias("g"), F.pow(F.col("id") * 7919 % 60_013, F.lit(1.3)).alias("v"))
    parts = [selection.sketches(df.where(F.col("year") == y), "g", "v") for y in range(3)]
    one = selection.merged(*parts, group="g").select("n", *[selection.sketched(F.col("sketch"), p).alias(f"p{i}") for i, p in enumerate((0.01, 0.5, 0.9))]).first()
    vs = sorted((i * 7919 % 60_013) ** 1.3 for i in range(60_000))
    assert one["n"] == 60_000
    for i, p in enumerate((0.01, 0.5, 0.9)):
        rank = sum(v <= one[f"p{i}"] for v in vs) / len(vs)
        assert abs(rank - p) < 0.015


def test_contained_strings(spark):
    rnd = random.Random(6)
    word = lambda most: "".join(rnd.choice("aAbBc .%_*") for _ in range(rnd.randrange(most)))
    names = [word(12) for _ in range(150)] + [None, "", "Éa"]
    strings = [word(6) for _ in range(150)] + [None, "", "é", "zzz"]
    a = spark.createDataFrame([(s,) for s in strings], "s string")
    b = spark.createDataFrame([(n,) for n in names], "n string")
    joined = containment.contained(a, b, "s", "n")
    want = {(s, n) for s in strings for n in names if s and n and s.lower() in n.lower()}
    assert sorted(map(tuple, joined.collect())) == sorted(want) and len(want) > 500
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_active_members(spark):
    register = [("a", "Jane Smith", "F", 1900, 1910), ("b", "John Smithson", "M", 1905, 1920), ("c", "Max Brown", "M", 1900, None), ("d", "Ann Brown", "F", 1890, 1900), ("e", None, "F", 1890, 1999)]
    cases = [
        ("Mr. Smith", 1902, (1, "a", "Jane Smith", "F")), ("Mr. Smith", 1907, (2, None, None, None)), ("Dr. SMITHSON", 1907, (1, "b", "John Smithson", "M")), ("Sir Max Brown", 1900, (1, "d", "Ann Brown", "F")),
        ("Mr. Speaker", 1902, None), ("Deputy Smith", 1902, None), (None, 1902, None), ("Mr.", 1902, None), ("Smith", None, (0, None, None, None)), ("Miss Smi", 1915, (1, "b", "John Smithson", "M")), ("A. S.th", 1902, (0, None, None, None)),
    ]
    m = spark.createDataFrame([(i, s, y) for i, (s, y, _) in enumerate(cases)], "mention_id int, speaker string, year int")
    r = spark.createDataFrame(register, "person_id string, person_name string, gender string, start_year int, end_year int")
    got = {x[0]: tuple(x)[1:] for x in containment.active_member(m, r).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases) if w}


def test_names_are_not_sent_to_the_driver(spark):
    """Only the few lengths of pieces are broadcast: files of names are small on disk and large in memory."""
    plan = containment.join_active_member_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [size#") <= 2 and "NestedLoop" not in plan


def test_a_surname_in_two_words_of_a_name_is_one_stint(spark):
    register = [("a", "Smith  Smithson Esmithe", "F", 1900, 1910), ("b", "ΟΔΟΣ Jones", "M", 1900, 1910), ("b", "ΟΔΟΣ Jones", "M", 1908, 1912), ("c", "", "M", 1900, 1910)]
    asked = [("Mr. SMITH", 1905), ("Smith", 1911), ("οδος", 1905), ("Οδοσ", 1905), ("jonesx", 1905), ("J", 1909), ("n J", 1901)]
    m = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "mention_id int, speaker string, year int")
    r = spark.createDataFrame(register, "person_id string, person_name string, gender string, start_year int, end_year int")
    got = {x["mention_id"]: (x["stints"], x["person_id"]) for x in containment.active_member(m, r).collect()}
    assert got == {0: (1, "a"), 1: (0, None), 2: (1, "b"), 3: (0, None), 4: (0, None), 5: (2, None), 6: (1, "b")}


def test_long_strings_meet_few_names(spark):
    """A letter pattern that all names share brings no string to a name that lacks it."""
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    names = {word(16) for _ in range(400)}
    strings = {x[2:14] for x in names}
    joined = containment.contained(spark.createDataFrame([(x,) for x in strings], "s string"), spark.createDataFrame([(x,) for x in names], "n string"), "s", "n")
    assert sorted(map(tuple, joined.collect())) == sorted((s, n) for s in strings for n in names if s in n)
    assert most_rows(joined) < 10_000


def test_a_year_joins_the_totals(spark, tmp_path):
    """Adding a year reads that year's folder alone; totals equal a recount whatever the order; a year added again replaces itself."""
    rnd, rows = random.Random(8), []
    for year in (1901, 1902, 1905, 1903):
        rows += [(year, rnd.choice([None, 0, rnd.randrange(1, 50), rnd.randrange(1, 200_000), -5]), rnd.choice([None, 1, 10])) for _ in range(300)]
    source, folder = f"{tmp_path}/rows", f"{tmp_path}/states"
    spark.createDataFrame(rows, "year int, id long, amount long").write.partitionBy("year").parquet(source)
    seen: list[tuple] = []
    for year in (1905, 1901, 1903, 1902, 1903):
        read = incremental.add_year(source, folder, year, spark, "id", "amount")
        assert {f.split("/year=")[1].split("/")[0] for f in read.inputFiles()} == {str(year)}
        seen = [*[r for r in seen if r[0] != year], *[r for r in rows if r[0] == year]]
        before, want = set(), []
        for y in sorted({r[0] for r in seen}):
            own = [r for r in seen if r[0] == y]
            ids = {r[1] for r in own if r[1] is not None}
            want.append((y, len(own), sum(r[2] or 0 for r in own), len(ids), len(before | ids), len(ids - before)))
            before |= ids
        assert sorted(map(tuple, incremental.by_year(spark, folder).collect())) == want
    span = {r[1] for r in rows if 1902 <= r[0] <= 1903 and r[1] is not None}
    assert incremental.distinct_ids(spark, folder, (1902, 1903)) == len(span) and incremental.distinct_ids(spark, folder, (1950, 1960)) == 0


def test_short_speakers_become_whole(spark):
    said = [
        (1, 1, "Mr. Smith", "Mr. Smith"), (1, 2, "Mr.  Smith (Leeds)", "Mr. Smith (Leeds)"), (1, 3, " Mr. Smith ", "Mr. Smith (Leeds)"), (1, 4, "Mr. Smith (York)", "Mr. Smith (York)"),
        (1, 5, "Mr. Jones", "Mr. Jones"), (1, 6, "Mr. Smith", "Mr. Smith (York)"), (1, 7, "mr. smith", "mr. smith"), (2, 1, "Mr. Smith", "Mr. Smith"), (1, 8, "(Leeds) x", "(Leeds) x"),
        (1, 9, "Mr. Smith (open", "Mr. Smith (open"), (2, 2, "A (b) (c)", "A (b) (c)"), (2, 3, "A", "A (b) (c)"), (2, 4, None, None), (1, 10, "Mr. Smith", "Mr. Smith (York)"),
    ]
    rnd = random.Random(3)
    rows = [(d, n, s, "x") for d, n, s, _ in said]
    rnd.shuffle(rows)
    out = windows.expanded(spark.createDataFrame(rows, "debate_id int, sequence_number int, speaker string, text string").repartition(3))
    assert out.columns == ["debate_id", "sequence_number", "speaker", "text"]
    assert {tuple(r)[:2]: r["speaker"] for r in out.collect()} == {(d, n): w for d, n, _, w in said}
