"""Stored full-text search against a search engine that stands by (SQLite's FTS5, where Python has it) and brute force."""

from __future__ import annotations

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from agoraspark.functions import search

COLUMNS = ("text", "speaker", "title")
WORDS = ["alpha", "beta", "gamma", "delta", "épée", "Zeta", "al", "alp", "x1", "2nd"]


def rows(seed=1, n=120):
    rnd = random.Random(seed)
    say = lambda most: "".join(rnd.choice(WORDS) + rnd.choice([" ", ", ", "-", ".\n", "_"]) for _ in range(rnd.randrange(most)))
    return [(i, say(40), say(5), rnd.choice([None, "", say(6)])) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows()], "doc_id long, text string, speaker string, title string, doc int, term string")


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    return search.build(docs, f"{tmp_path_factory.mktemp('search')}/index", columns=COLUMNS, files=8)


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(text, speaker, title)")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    db.executemany("INSERT INTO f(rowid, text, speaker, title) VALUES (?, ?, ?, ?)", rows())
    return db


def random_query(rnd, depth=2):
    word = lambda: rnd.choice([*WORDS, "EPEE", '"x1"'])
    phrase = lambda: rnd.choice([word(), f"{word()}", f'"{rnd.choice(WORDS)} {rnd.choice(WORDS)}"', f"{rnd.choice(WORDS)} + {rnd.choice(WORDS)}", rnd.choice(["al*", "a *", '"beta al" *', "^alpha", "^ al*"])])
    if depth == 0 or rnd.random() < 0.3:
        kind = rnd.randrange(6)
        if kind == 0:
            return f"NEAR({phrase().lstrip('^ ')} {phrase().lstrip('^ ')}{rnd.choice(['', ', 2', ', 0', ', 5'])})"
        if kind == 1:
            return f"{rnd.choice(['text', 'title', '{text title}', '- speaker'])} : {phrase()}"
        return " ".join(phrase() for _ in range(rnd.choice([1, 1, 2, 3])))
    left, right = random_query(rnd, depth - 1), random_query(rnd, depth - 1)
    made = f"{left} {rnd.choice(['AND', 'OR', 'NOT'])} {right}"
    return rnd.choice([made, f"({made})", f"{rnd.choice(['title', 'text'])} : ({made})"])


def test_random_queries_find_what_fts_finds(spark, folder, fts):
    rnd, same = random.Random(7), 0
    while same < 40:
        q = random_query(rnd)
        want = {r[0]: -r[1] for r in fts.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (q,))}
        got = {r["doc"]: r["score"] for r in search.match(spark, folder, q, COLUMNS).collect()}
        assert set(got) == set(want), q
        # FTS5 counts of NEAR only what is near, and a column's phrase in all columns: ranks are compared elsewhere.
        if "NEAR" not in q and ":" not in q and "^" not in q:
            assert got == pytest.approx(want, rel=1e-6), q
        same += 1


def test_queries_are_read_as_fts_reads_them(fts):
    for q in ["(alpha) beta", "AND", "alpha AND", "NEAR(alpha", '"alpha', "nocolumn : alpha", "alpha )", "* alpha", "alpha OR OR beta", "{text : a"]:
        with pytest.raises(sqlite3.OperationalError):
            fts.execute("SELECT count(*) FROM f WHERE f MATCH ?", (q,)).fetchall()
        with pytest.raises(ValueError):
            search.parse(q, COLUMNS)
    a, b, c = (search.Phrase((w,)) for w in "abc")
    assert search.parse("a b NOT c") == search.Both("NOT", search.Both("AND", a, b), c)
    assert search.parse("a OR b AND c") == search.Both("OR", a, search.Both("AND", b, c))
    assert search.parse("a NOT b OR c") == search.Both("OR", search.Both("NOT", a, b), c)
    assert search.parse('"..." a') == a and search.parse("") is None and search.parse('"!"') is None
    assert search.parse("don_t") == search.Phrase(("don", "t"))
    assert search.required(search.parse('(a OR a b) AND "c d" NOT e')) == {"a", "c", "d"}


def test_only_files_that_may_hold_the_terms_are_opened(spark, folder):
    every = spark.read.parquet(f"{folder}/files").collect()
    assert len(every) == 8
    for slots in ([("zeta", False)], [("x1", False), ("al", True)], [("gam", True)]):
        holds = lambda t: any(t == w or (p and t.startswith(w)) for w, p in slots)
        read = search.postings_of(spark, folder, slots)
        opened = {f.rsplit("/", 1)[-1] for f in read.inputFiles()}
        there = {r["file"].rsplit("/", 1)[-1] for r in every if any(r["first"] <= t <= r["last"] and holds(t) for t in [r["first"], r["last"], *[w for w, _ in slots], *map(str.lower, WORDS)])}
        assert opened and opened <= there and len(opened) < 8
        assert all(holds(r["term"]) for r in read.select("term").distinct().collect())
        assert "PushedFilters: [" in (plan := read._jdf.queryExecution().executedPlan().toString()) and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert search.postings_of(spark, folder, [("zzzz", False)]).count() == 0


def test_rare_words_cut_the_others(spark, folder, docs):
    """The same results with and without the cut; with it the plan joins before it groups."""
    q = "alpha beta NOT gamma"
    got = sorted(map(tuple, search.match(spark, folder, q, COLUMNS).collect()))
    old, search.RARE = search.RARE, -1
    try:
        assert sorted(map(tuple, search.match(spark, folder, q, COLUMNS).collect())) == got
    finally:
        search.RARE = old


def snippet_by_force(text, terms, size):
    parts = list(re.finditer(r"[^\W_]+", text))
    fold = lambda w: w.lower().replace("é", "e")
    hits = {i for i, m in enumerate(parts) if fold(m[0]) in terms}
    best = max(range(max(1, len(parts) - size + 1)), key=lambda b: (len({fold(parts[i][0]) for i in hits if b <= i < b + size}), -b))
    out, at = "..." if best else "", parts[best].start() if best else 0
    for i in range(best, min(best + size, len(parts))):
        m = parts[i]
        out += text[at : m.start()] + (f"<mark>{m[0]}</mark>" if i in hits else m[0])
        at = m.end()
    return out + ("..." if best + size < len(parts) else text[at:])


def test_snippets_are_the_best_windows(spark, folder, docs):
    for size, terms in ((3, ["alpha", "beta"]), (5, ["epee", "gamma", "zeta"]), (30, ["al", "x1"])):
        found = search.match(spark, folder, " OR ".join(terms), COLUMNS).join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
        here = F.filter("places", lambda x: x["start"] < search.COLUMN)
        got = found.select("doc", "text", search.snippet(F.col("text"), here, size).alias("s")).collect()
        assert len(got) > 40
        for r in got:
            if re.search(r"[^\W_]", r["text"]):
                assert r["s"] == snippet_by_force(r["text"], terms, size), r["text"]


def test_snippets_mark_phrases_once(spark, tmp_path):
    texts = [(1, "one two one two three"), (2, "Before! " + "w " * 40 + "one, two (three) after"), (3, "two one"), (4, ""), (5, None), (6, "one one two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    folder = search.build(docs, f"{tmp_path}/index")
    got = {r["doc"]: r["snippet"] for r in search.search(docs, folder, '"one two" OR three').collect()}
    assert got == {
        1: "<mark>one two</mark> <mark>one two</mark> <mark>three</mark>",
        2: "..." + "w " * 27 + "<mark>one, two</mark> (<mark>three</mark>...",
        6: "one <mark>one two</mark>",
    }
    assert {r["doc"]: r["snippet"] for r in search.search(docs, folder, '"one two" OR "two three" OR "one two three"', top=1).collect()}[1] == "<mark>one two</mark> <mark>one two three</mark>"


def test_one_pass_finds_what_the_index_finds(spark, folder, docs):
    """scan and search agree on random queries; scan neither shuffles nor writes."""
    rnd = random.Random(11)
    for q in [*(random_query(rnd) for _ in range(25)), "", "Épée", "title : x1 OR épée", "nothing"]:
        got = search.scan(docs, q, columns=COLUMNS)
        want = search.search(docs, folder, q, columns=COLUMNS)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("doc", "snippet").collect())), q
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "an IDIÒT!"), (4, "idiots"), (5, "ΟΔΟΣ'Α \u212aing"), (None, "idiot")], "doc_id long, text string")
    assert [tuple(r) for r in search.scan(odd, "idiot OR οδος OR king").orderBy("doc").collect()] == [(3, "an <mark>IDIÒT</mark>!"), (5, "<mark>ΟΔΟΣ</mark>'Α <mark>\u212aing</mark>")]


def test_snippets_of_many_texts_build_no_index(spark):
    """The query fn_snippet_mark is one pass over the documents."""
    plan = search.fn_snippet_mark(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1


def test_nothing_to_find(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = search.build(docs, f"{tmp_path}/index")
    assert search.match(spark, folder, "one OR two").count() == 0 and search.match(spark, folder, "").count() == 0
