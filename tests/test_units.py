"""Small cases with results known by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from agoraspark.functions import names, text
from agoraspark.operators import aggregates, joins, ordering
from agoraspark.plans import linkage, quality, statistics
from agoraspark.session import new_folder
from agoraspark.sources import html, tables
from agoraspark.streaming import events

PAGE = """<div class="house-of-commons-sitting"><cite class="section">HC Deb 11 May 1950 vol 475 c574</cite>
<div class="hentry member_contribution" id="S5CV0475P0_1"><cite class="member">Mr. Nabarro</cite><blockquote class="contribution_text">
<p><span class="question_no">61.</span> asked the Minister of Transport what he proposes to do about the roads of the county.</p>
<p class="procedural">skipped</p></blockquote></div>
<div class="hentry member_contribution" id="S5CV0475P0_2"><cite class="member">Mr. Barnes</cite><blockquote class="contribution_text"><p>Short.</p></blockquote></div>
<div class="hentry member_contribution" id="S5CV0475P0_3"><blockquote class="contribution_text"><p>A long answer that nobody is named for, of more than fifty characters.</p></blockquote></div></div>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_speeches_of_a_page():
    found = html.speeches_in(PAGE)
    assert [(s["speaker"], s["question_number"], s["is_question"]) for s in found] == [("Mr. Nabarro", "61", True)]
    assert "skipped" not in found[0]["text"] and html.speeches_in(None) == []
    assert html.plain_text("<nav>x</nav><p>a</p><script>b</script>\n<p> c &amp; d</p>") == "a\nc & d"


@pytest.mark.parametrize(("line", "want"), [
    ("HC Deb 12 January 1920 vol 123 cc456-78", ("HC", "12 January 1920", 123, "456-78")),
    ("HL Deb 5 March 1850 vol 45 c123", ("HL", "5 March 1850", 45, "123")),
    ("none", (None, None, None, None)),
])
def test_references(spark, line, want):
    r = one(spark, names.reference(F.lit(line)))
    assert (r["house"], r["date"], r["volume"], r["columns"]) == want


def test_speaker_names(spark):
    n = lambda s: one(spark, names.normalize_speaker(F.lit(s)))
    assert [n("MR. SMITH"), n("Mrs.  Jones"), n("DR.BROWN"), n("  Lord  Wilson  ".strip()), n(None)] == ["smith", "jones", "brown", "wilson", ""]
    assert one(spark, names.clean_match(F.lit("Mr. Bavies"))) == "mr. davies"
    assert one(spark, names.clean_match(F.lit("§ * Mrs. 0'Brien"))) == "mrs. o'brien"
    assert one(spark, names.clean_display(F.lit("*o'BRIEN smith-JONES (Leeds"))) == "O'Brien Smith-Jones"
    assert one(spark, names.title_gender(F.lit("The Lady Astor"))) == "F" and one(spark, names.title_gender(F.lit("Smith"))) is None
    assert one(spark, names.topic(F.lit("ROADS (Hansard, 1 May 1950)"))) == "ROADS" and one(spark, names.topic(F.lit(None).cast("string"))) == ""


def test_stop_word_levels_nest():
    sizes = [set(text.stopwords(x)) for x in ("minimal", *text.LEVELS[1:])]
    assert all(a < b for a, b in zip(sizes, sizes[1:], strict=False)) and text.stopwords("unknown") == text.stopwords("moderate")


def test_preprocessing_and_ngrams(spark):
    p = lambda s: one(spark, text.preprocessed(F.lit(s).cast("string"), ["the"]))
    assert [p("The HOUSE discussed the BILL."), p("John's opinion"), p("The *bold* text and [reference]"), p(""), p(None)] == ["house discussed bill", "johns opinion", "bold text and", "", ""]
    docs = spark.createDataFrame([("transport infrastructure transport",), ("infrastructure policy transport",)], "t string")
    counts = {r["term"]: r["n"] for r in text.counted(docs, text.tokens(F.col("t"))).collect()}
    assert counts == {"transport": 3, "infrastructure": 2, "policy": 1}
    assert one(spark, text.ngrams(F.split(F.lit("a b c"), " "), 2)) == ["a b", "b c"] and one(spark, text.ngrams(F.split(F.lit("a"), " "), 2)) == []


def test_agreement(spark):
    pairs = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    k = statistics.kappa(pairs).first()
    assert round(k["kappa"], 4) == 0.4 and k["agreement"] == 0.7
    assert statistics.kappa(pairs.where("a = 1 and b = 1")).first()["kappa"] is None
    f = {r["label"]: r for r in statistics.per_class(pairs).collect()}
    assert round(f[1]["precision"], 4) == 0.6667 and f[1]["recall"] == 0.8 and f[1]["support"] == 25


def test_samples(spark):
    assert ordering.sample_size(6531) == 363 and ordering.sample_size(0) == 0
    assert ordering.neyman([("a", 100, 4.0), ("b", 5, 1.0), ("c", 50, 0.0)], 60) == {"a": 59, "b": 5, "c": 10}
    d = spark.range(100)
    assert ordering.sample(d, 7, "id").collect() == ordering.sample(d.repartition(9), 7, "id").collect()


def test_near_names_are_all_found(spark):
    from itertools import product

    words = ["smith", "smyth", "smit", "smiths", "mith", "jones", "jonas", "smtih", ""]
    a, b = spark.createDataFrame([(w,) for w in words], "a string"), spark.createDataFrame([(w,) for w in words], "b string")
    found = {(r["a"], r["b"]) for r in joins.near_names(a, b).collect()}

    def near(x, y):
        if x == y:
            return True
        if abs(len(x) - len(y)) > 1 or x[:1] != y[:1]:
            return False
        short, long = sorted((x, y), key=len)
        if len(short) == len(long):
            return sum(p != q for p, q in zip(x, y, strict=True)) == 1
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    assert found == {(x, y) for x, y in product(words, words) if near(x, y)}


def test_audit_states(spark):
    e = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "k int, expected int")
    g = spark.createDataFrame([(1, 5), (2, 3), (3, 0), (9, 1)], "k int, got int")
    assert {r["k"]: r["state"] for r in joins.audited(e, g, "k").collect()} == {1: "complete", 2: "incomplete", 3: "zero", 4: "missing", 9: "extra"}


def test_errors_and_formats(spark):
    with pytest.raises(ValueError):
        tables.load(spark, "/nowhere", "unknown")
    with pytest.raises(ValueError):
        tables.export(spark.range(1), "/nowhere", "xml")
    with pytest.raises(ValueError):
        aggregates.timeline(spark.range(1), "week")
    rows = spark.createDataFrame([(1, 'a "quoted", line\nbreak'), (2, None)], "k int, t string")
    for kind in ("csv", "json", "parquet"):
        assert sorted(map(tuple, tables.export(rows, new_folder(spark, "t"), kind).collect())) == sorted(map(tuple, rows.collect()))


def test_schema_and_versions(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k int, v double, stamp string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "z"), (2, 2.1, "y")], "k int, v double, stamp string")
    assert [tuple(r) for r in quality.differing(a, b, "k", ("stamp",)).collect()] == [(2, "v")]
    assert quality.schema_findings(a, {"k": "bigint", "w": "string", "v": "double"}) == [("w", "missing"), ("stamp", "unexpected"), ("k", "int instead of bigint")]


def test_outside_model_errors_and_resume(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "yy")], "speech_id string, text string")
    done = spark.createDataFrame([("c",)], "speech_id string")
    got = {r["speech_id"]: (r["stance"], r["error"]) for r in linkage.classify(rows, linkage._stub, "stance string, confidence double", done=done).collect()}
    assert got == {"a": ("for", None), "b": (None, "ValueError: empty")}


def test_stream_gives_closed_windows(spark):
    folder, schema = new_folder(spark, "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(folder)
    out = events.stream(spark, folder, schema, new_folder(spark, "state"), new_folder(spark, "out"))
    batch = {(r["begins"], r["event_type"]): r["n"] for r in events.tumbling(src, "1 day").collect()}
    got = {(r["begins"], r["event_type"]): r["n"] for r in out.collect()}
    assert got and got.items() <= batch.items()


def test_registered_sql_functions(spark):
    names.register(spark)
    assert spark.sql("SELECT word_count(' a  b '), near_name('smith', 'smyth')").first() == (2, True)
