"""Cases that the tables at hand don't have: word boundaries, eleven speakers, hot tokens, odd pages, statistics by force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from agoraspark.functions import names, text
from agoraspark.operators import aggregates, joins, ordering
from agoraspark.plans import linkage, statistics
from agoraspark.queries import ORACLES, QUERIES
from agoraspark.sources import html, tables

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens_end_at_word_boundaries(spark):
    got = one(spark, text.tokens(F.lit("A naïve abc123 x2y well-known über-cool snake_case don't Élan ÉTÉ (note) end.")))
    assert got == ["well", "known", "cool", "don", "note", "end"]
    rnd = random.Random(1)
    for _ in range(20):
        line = "".join(rnd.choice("abcéñß1_- '.") for _ in range(60))
        want = [w for w in re.findall(r"\b[a-z]+\b", line.lower()) if len(w) >= 2]
        assert one(spark, text.tokens(F.lit(line))) == want, line


def test_preprocessing_keeps_letters_and_closes_up(spark):
    p = lambda s: one(spark, text.preprocessed(F.lit(s), ["the"]))
    assert p("The well-known naïve *café* [see note] d'été, ‘quoted’ über_all x 12") == "wellknown naïve café dété quoted überall 12"
    assert p("a\r\nb [c\nd] ee\tff") == "ee ff"


def test_smallest_stop_word_level_has_over_a_hundred_words():
    sizes = [len(text.stopwords(level)) for level in text.LEVELS]
    assert sizes[0] > 100 and sizes == sorted(set(sizes)) and all(len(text.stopwords(x)) == len(set(text.stopwords(x))) for x in text.LEVELS)


def test_misread_names(spark):
    for wrong, right in names.MISREAD[:-1]:
        assert one(spark, names.clean_match(F.lit(wrong))) == right


def test_ten_speakers_of_eleven(spark, tmp_path):
    rows = [(1, i, f"s{(i * 7) % 11:02}", "a b") for i in range(22)] + [(2, 0, "only", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["debate_id"]: r for r in aggregates.agg_debate_from_speeches(spark, str(tmp_path)).collect()}
    assert got[1]["speakers"].split(",") == [f"s{(i * 7) % 11:02}" for i in range(10)] and got[1]["n"] == 22
    assert got[2]["speakers"] == "only" and got[2]["n"] == 1


@pytest.mark.parametrize("least", [0.34, 0.6, 0.67, 1.0])
def test_token_overlap_against_force(spark, least):
    rnd = random.Random(3)
    words = ["hot"] * 30 + ["warm"] * 8 + [f"w{i}" for i in range(25)]
    sets = [sorted({rnd.choice(words) for _ in range(rnd.randrange(1, 7))}) for _ in range(90)]
    a, b = list(enumerate(sets[:40])), list(enumerate(sets[40:]))
    found = joins.token_overlap(spark.createDataFrame(a, "a long, tokens array<string>"), spark.createDataFrame([*b, (99, [])], "b long, tokens array<string>"), least).collect()
    want = {}
    for (i, x), (j, y) in product(a, b):
        ratio = len(set(x) & set(y)) / min(len(x), len(y))
        if ratio >= least:
            want[i, j] = ratio
    assert len(found) == len(want) and {(r["a"], r["b"]): r["ratio"] for r in found} == want


@pytest.mark.parametrize("least", [0.34, 0.6, 0.67, 1.0])
def test_short_overlap_against_force(spark, least):
    """Sets of 0 to 12 tokens, with copies; each pair once, and each set with itself."""
    rnd = random.Random(5)
    words = ["hot"] * 20 + ["warm"] * 8 + [f"w{i}" for i in range(12)]
    sets = [sorted({rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 5, 6, 9, 30]))}) for _ in range(90)]
    found = joins.short_overlap(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"), least).collect()
    agree = lambda x, y: len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0
    want = {(i, j): agree(sets[i], sets[j]) for i in range(90) for j in range(i, 90) if agree(sets[i], sets[j]) >= least}
    assert len(found) == len(want) and {(r["a"], r["b"]): r["ratio"] for r in found} == want


def test_common_tokens_make_no_pairs(spark, tmp_path, monkeypatch):
    """Names that share two tokens of five never meet, and copies meet once, as a kind: the joins of kinds make no rows but results."""
    rows = [(i, "small ring", "Brand#1", i, i / 8) for i in range(600)] + [(1000 + i, "old plate", "Brand#2", 7, 1.5) for i in range(40)] + [(2000, None, "Brand#2", 7, 1.5), (None, "old plate", "Brand#2", 7, 1.5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(joins, "TOGETHER", 7)
    want = {(i, j): 0.65 for i in range(600) for j in range(i + 1, 600)} | {(1000 + i, 1000 + j): 1.05 for i in range(40) for j in range(i + 1, 40)}
    got = QUERIES["join_name_core_overlap"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["score"] for r in got} == want
    unlike = spark.createDataFrame([(i, ["small", "ring", *(f"{c}{i}" for c in "abc")]) for i in range(500)], "id long, tokens array<string>")
    of = joins.keyed(unlike, joins.sizes(0.6, unlike))
    assert of.count() == 5000 and of.groupBy("held", "key").count().where("count > 1").count() == 0


def test_near_names_of_a_year(spark):
    a = spark.createDataFrame([("smith", 1900), ("jones", 1900), ("ox", 1901)], "a string, year long")
    b = spark.createDataFrame([("smyth", 1900), ("smith", 1901), ("bones", 1900), ("ox", 1901), ("o", 1901)], "b string, year long")
    assert {(r["a"], r["b"], r["distance"]) for r in joins.near_names(a, b, "year").collect()} == {("smith", "smyth", 1), ("ox", "ox", 0), ("ox", "o", 1)}


def test_fuzzy_pass_wants_years_and_one_person(spark):
    shape = "{} long, tokens array<string>, rank string, begins int, ends int"
    m = spark.createDataFrame([(1, ["ann", "lee", "york"], "large", 10, 15), (2, ["bob", "ray", "hull"], None, 10, 15), (3, ["cy", "dow", "bath"], None, 10, 15), (4, ["x"], None, 1, 2)], shape.format("mention_id"))
    r = spark.createDataFrame([(10, ["ann", "lee", "leeds"], "large", 14, 19), (11, ["ann", "lee", "york"], "large", 30, 35), (20, ["bob", "ray"], None, 10, 15), (21, ["ray", "hull"], None, 9, 14), (30, ["cy", "dow", "bath"], "small", 15, 20)], shape.format("person_id"))
    got = {x["mention_id"]: (x["person_id"], round(x["score"], 6), x["years"]) for x in linkage.fuzzy_pass(m, r, 0.6, 0.05).collect()}
    assert got == {1: (10, round(2 / 3 + 0.05, 6), 2), 3: (30, 1.0, 1)}


@pytest.mark.parametrize("least", [0.5, 0.67])
def test_fuzzy_pass_against_force(spark, least):
    """Short and long sets, nulls, spans of other lengths, and ids of short sets that stand twice."""
    rnd = random.Random(6)
    words = ["hot"] * 6 + ["warm"] * 3 + [f"w{i}" for i in range(30)]

    def side(n):
        out = [(i % (n - 2), rnd.sample(words, rnd.choice([0, 1, 2, 4, 4, 5, *([11] if i % (n - 2) > 1 else [])])), rnd.choice([None, "x", "y"]), b := rnd.choice([None, *range(20)]), None if b is None else b + rnd.choice([-1, 0, 3, 5])) for i in range(n)]
        return [(i, [*t, None] if i % 5 == 0 else t, k, b, e) for i, t, k, b, e in out]

    left, right = side(90), side(50)
    shape = "{} long, tokens array<string>, rank string, begins int, ends int"
    got = linkage.fuzzy_pass(spark.createDataFrame(left, shape.format("mention_id")), spark.createDataFrame(right, shape.format("person_id")), least, 0.05).collect()
    met = {}
    for (i, t, k, b, e), (j, u, q, c, d) in product(left, right):
        t, u = {x for x in t if x}, {x for x in u if x}
        if t and u and None not in (b, e, c, d) and (years := min(e, d) - max(b, c) + 1) > 0 and b <= e and c <= d and (ratio := len(t & u) / min(len(t), len(u))) >= least:
            met.setdefault(i, []).append((j, ratio + (0.05 if k and k == q else 0.0), years))
    want = {i: x[0] for i, x in met.items() if len(x) == 1}
    assert len(want) > 5 and len(got) == len(want) and {r["mention_id"]: (r["person_id"], r["score"], r["years"]) for r in got} == want


def test_people_who_agree_make_no_pairs(spark, monkeypatch):
    """Thousands who agree in all but one token are counted, not paired."""
    of = lambda key, n, mark: spark.range(n).select(F.col("id").alias(key), F.array(F.lit("york"), F.lit("kind"), F.lit("smith"), F.concat(F.lit(mark), "id")).alias("tokens"), F.lit("x").alias("rank"), F.lit(1).alias("begins"), F.lit(6).alias("ends"))
    monkeypatch.setattr(linkage, "token_overlap", None)
    alone = spark.createDataFrame([(9999, ["q", "kind", "smith", "b7"], "x", 3, 8)], "person_id long, tokens array<string>, rank string, begins int, ends int")
    register = of("person_id", 3000, "p").unionByName(alone)
    ours = spark.createDataFrame([(-1, ["leeds", "kind", "smith", "b7"], "x", 1, 6)], "mention_id long, tokens array<string>, rank string, begins int, ends int")
    got = linkage.fuzzy_pass(of("mention_id", 2000, "m").unionByName(ours), register, 0.67, 0.05, 4).collect()
    assert [tuple(r) for r in got] == [(-1, 9999, 0.8, 4)]


@pytest.mark.parametrize("name", ["merge_pass_name_fuzzy", "merge_pass_const_fuzzy"])
def test_fuzzy_passes_agree_with_sql_on_odd_parts(spark, tmp_path, name):
    """A crowd that shares all but a token, ranks, nulls in every column, and mentions with one person alone."""
    rnd = random.Random(8)
    pick = lambda *x: rnd.choice([*x * 4, None])
    crowd = [(i, f"{pick('small', 'old')} ring", "Brand#1", "KIND", pick(1, 2, 9), i + 0.5) for i in range(0, 400)]
    rest = [(1000 + i, pick(f"small w{i // 2}", f"large w{i // 2}", f"x{i} w{i // 2}"), pick(f"Brand#{i // 2}"), pick("A", "B"), pick(5, 6), pick(i // 2 + 0.25)) for i in range(300)]
    parts = spark.createDataFrame([*crowd, *rest], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT mention_id, person_id, score, years FROM ({ORACLES[name]})").fetchall()}
    got = {r["mention_id"]: (r["person_id"], r["score"], r["years"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(want) > 10 and got == want


def test_buckets_lose_no_pair(spark):
    rnd = random.Random(4)
    values = [rnd.uniform(-100, 100) for _ in range(80)] + [0.0, 20.0, -20.0, 40.0]
    v = spark.createDataFrame([(x,) for x in values], "x double")
    a = v.select("x", F.explode(joins.near_buckets(F.col("x"), 20)).alias("k"))
    got = a.join(v.select(F.col("x").alias("y"), F.floor(F.col("x") / 20).alias("k")), "k").where("abs(x - y) <= 20").count()
    assert got == sum(abs(x - y) <= 20 for x in values for y in values)


def test_shuffle_is_a_permutation(spark):
    out = ordering.shuffled(spark.range(5000), "id").collect()
    assert sorted(r["place"] for r in out) == list(range(1, 5001))
    digest = {r["id"]: r["place"] for r in out}
    assert sorted(range(5000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()) == sorted(digest, key=digest.get)


def test_permutation_test_against_force(spark):
    differs = [0.5, 1.2, -0.3, 2.0, 0.9, 1.1, -0.2, 0.7]
    pairs = spark.createDataFrame(list(enumerate(differs)), "id long, d double")
    p = statistics.permuted(spark, pairs, 4000).first()["p"]
    exact = sum(abs(sum(s * d for s, d in zip(signs, differs, strict=True))) >= abs(sum(differs)) - 1e-12 for signs in product((1, -1), repeat=8)) / 256
    assert abs(p - exact) < 4 * math.sqrt(exact * (1 - exact) / 4000) + 1 / 4000
    assert statistics.permuted(spark, pairs, 100).first()["p"] == statistics.permuted(spark, pairs.repartition(3), 100).first()["p"]


def test_topics_have_their_shape_and_repeat(spark):
    out = QUERIES["txt_lda"](spark, DATA).collect()
    assert sorted((r["topic"], r["place"]) for r in out) == [(t, k) for t in range(8) for k in range(10)]
    for t in range(8):
        weights = [r["weight"] for r in sorted(out, key=lambda r: r["place"]) if r["topic"] == t]
        assert weights == sorted(weights, reverse=True) and min(weights) > 0
    stop = set(text.stopwords("aggressive"))
    assert all(r["term"] not in stop and len(r["term"]) >= 2 for r in out)
    again = QUERIES["txt_lda"](spark, DATA).collect()
    assert [(r["topic"], r["place"], r["term"]) for r in out] == [(r["topic"], r["place"], r["term"]) for r in again]


def test_approximate_distinct_is_within_its_bound(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["ext_approx_distinct"](spark, folder).first()["customers"]
    exact = spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey").distinct().count()
    assert abs(got - exact) <= 3 * 0.02 * exact


LONG = "a word of some length that is said in the house " * 2
PAGE = f"""<html><body><div class="house-of-lords-sitting"><cite class="section">HL Deb 5 March 1850 vol 45 c123</cite>
<div class="hentry member_contribution" id="p1"><cite class="member">Mr. Nabarro</cite><div class="inner"><div>
<blockquote class="contribution_text"><p><span class="question_no">61.</span> {LONG}&amp; more</p><p class="procedural">skipped</p></blockquote></div></div></div>
<div class="hentry member_contribution" id="p2"><blockquote class="contribution_text"><p>{LONG}</p></blockquote></div>
<div class="hentry member_contribution" id="p3"><cite class="member">Silent</cite></div>
<div class="hentry member_contribution" id="p4"><cite class="member">Short</cite><blockquote><p>Too short.</p></blockquote></div>
<div class="hentry" id="p5"><cite class="member">No member</cite><blockquote><p>{LONG}</p></blockquote></div>
<div class="hentry member_contribution" id="p6"><cite class="member">Broken <b>tag</cite><blockquote><p>{LONG}<i>unclosed <p>second part</blockquote></div>
</div></body></html>"""


def test_speeches_of_hand_written_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<div class='hentry member_contribution'><cite class='member'>A</cite>")], "id long, html string")
    out = {r["id"]: r["speeches"] for r in html.with_speeches(pages).collect()}
    assert [s["contribution_id"] for s in out[1]] == ["p1", "p6"] and not out[2] and not out[3] and not out[4]
    first, last = out[1]
    assert first["speaker"] == "Mr. Nabarro" and first["is_question"] and first["question_number"] == "61" and "skipped" not in first["text"] and "& more" in first["text"]
    assert last["speaker"].startswith("Broken") and "second part" in last["text"] and not last["is_question"]


def test_plain_text_of_hand_written_pages():
    assert " ".join(html.plain_text("<html><head><title>t</title><script>var x;</script><style>p{}</style></head><body><p>One &amp; two</p><div>three</div></body></html>").split()).endswith("One & two three")
    assert not (html.plain_text(None) or "").strip() and not (html.plain_text("") or "").strip()
    assert "var x" not in html.plain_text("<script>var x;</script>a<p>b")


def test_tables_follow_their_input(spark, tmp_path):
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "c")]
    for n in (1, 2):
        spark.createDataFrame(rows[:n], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        assert spark.read.parquet(tables._by_year(spark, str(tmp_path))).count() == n
