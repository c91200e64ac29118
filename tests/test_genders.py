"""Waterfalls, honorifics, first names, aliases and the chi-squared test on cases written by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from agoraspark.plans import cascade, genders, statistics

NAMES = [("John", "M"), ("Mary", "F"), ("Robin", None), ("Gregory", "M"), ("Otto", "M")]


def told(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return dict(zip(values, [r[1] for r in sorted(rows.select("i", column(F.col("t"))).collect())], strict=True))


def test_first_names(spark):
    want = {
        "MR. JOHN DOUGLAS": "john", "SIR J. BRYDGES": None, "MR. W. PEEL": None, "MR. LOCKHART": None, "Mr. GREGORY BARKER": "gregory", "SIR M. W. RIDLEY": None, "The Prime Minister": None,
        "Captain J. Mary Smith": "mary", "": None, None: None, "J. B": None, "Dr. O'Neil Brown": "neil",
    }
    assert told(spark, list(want), genders.first_name) == want


def test_honorifics_are_words_or_phrases(spark):
    held = lambda t: genders.holds_any(genders.letters(t), ["major", "wing commander"])
    want = {"Major Smith": True, "MAJOR-GENERAL X": True, "Majority": False, "The Wing  Commander": True, "Swing commander": True, "wing": False, "": False, None: False}
    assert told(spark, list(want), held) == want


def test_officers(spark):
    want = {"the speaker": True, "mr. speaker": True, "mr speaker": False, "several members": True, "hon. members": True, "mr. member": False, "the clerk": True, "": False}
    assert told(spark, list(want), cascade.is_officer) == want


def test_turns(spark):
    details = [(1, 1, " Mr. Smith ", "F"), (1, 2, "MR. SMITH", "M"), (1, 3, "Mrs. Odd", "x"), (1, 4, "None", None), (1, 5, "", "M"), (2, 1, "Mr. Brown", "F")]
    cases = [
        (1, "mr. smith", "Commons", 1990, "M", "speaker_details"), (2, "Mr. Smith", "Commons", 1917, "M", "chamber_cutoff"), (1, "Mrs. Odd", "Commons", 1990, "F", "speaker_details"), (2, "Lady X", "House of Lords", 1957, "M", "chamber_cutoff"),
        (2, "Lady X", "House of Lords", 1958, "F", "honorific_female"), (1, "Mr. Brown", "Commons", 1918, "M", "honorific_male"), (2, "Wing Commander A", "Commons", 1948, "M", "military_doctor"), (2, "Wing Commander A", "Commons", 1949, "M", "military_doctor"),
        (2, "Major A", "Commons", 1949, "UNK", "UNK"), (2, "Admiral A", "Commons", 1992, "M", "military_doctor"), (2, "Dr. Ann A", "Commons", 1964, "M", "military_doctor"), (2, "Dr. Mary A", "Commons", 1965, "F", "guesser_female"), (2, "Gregory Peck", None, 1990, "M", "guesser_male"),
        (2, "Robin Hood", "Commons", 1990, "UNK", "UNK"), (2, "Baroness Lord", "Lords", 1990, "M", "honorific_male"), (2, None, None, None, "UNK", "UNK"), (1, "None", None, None, "UNK", "UNK"),
    ]
    turns = spark.createDataFrame([(i, *c[:4], "kept") for i, c in enumerate(cases)], "n int, debate_id int, speaker string, chamber string, year int, first string")
    out = genders.of_turns(turns, spark.createDataFrame(details, "debate_id int, nth int, original_name string, gender string"), spark.createDataFrame(NAMES, "first_name string, gender string"))
    assert out.columns == [*turns.columns, "gender", "gender_source"]
    got = {r["n"]: (r["gender"], r["gender_source"], r["first"]) for r in out.collect()}
    for i, c in enumerate(cases):
        assert got[i] == (c[4], c[5], "kept"), c


def test_members(spark):
    c, l = "house-of-commons", "house-of-lords"
    cases = [
        # name, gender, prefix, main prefix, item, house, year, aliases: gender, source
        ("A B", "male", "Mrs", None, None, c, 1950, None, "M", "everypolitician"), ("A B", "F", None, None, None, c, 1900, None, "F", "everypolitician"), ("A B", "unknown", "The Rt Hon Sir", None, None, c, 1990, None, "M", "HH honorific"),
        ("A B", None, "Sir", "Lady", None, c, 1990, None, "M", "HH honorific"), ("A B", None, None, "Dame", None, c, 1900, None, "F", "PP honorific"), ("A B", None, "Dr", "Mr", None, c, 1990, None, "M", "PP honorific"),
        ("A B", None, None, None, "Q1", c, 1900, None, "F", "wikidata_P21"), ("A B", None, None, None, "Q2", c, 1917, None, "M", "rule_pre1918_commons"), ("A B", None, None, None, None, l, 1957, None, "M", "rule_pre1958_lords"),
        ("Nancy  ASTOR!", None, None, None, None, c, 1919, None, "F", "wikidata_curated_name_mp"), ("Nancy Astor", None, None, None, None, c, 1919, ["x", "nancy astor"], "F", "wikidata_curated_alias_mp"), ("X", None, None, None, None, c, 1919, ["Nancy Astor"], "F", "wikidata_curated_alias_mp"),
        ("Lady Reading", None, None, None, None, l, 1960, None, "F", "wikidata_curated_name_lord"), ("Q", None, None, None, None, l, 1960, ["Lady Reading", None], "F", "wikidata_curated_alias_lord"), ("Lady Reading", None, None, None, None, c, 1960, None, None, None),
        ("John Reading", None, None, None, "Q2", c, 1960, [], "M", "fname_inference"), ("Robin Reading", None, None, None, None, c, 1960, [], None, None), (None, None, None, None, None, None, None, None, None, None),
    ]
    kinds = "row_id int, person_name string, gender string, honorific_prefix string, main_prefix string, id_wikidata string, organization_id string, start_year int, aliases array<string>"
    members = spark.createDataFrame([(i, *x[:8]) for i, x in enumerate(cases)], kinds)
    items = spark.createDataFrame([("Q1", "F"), ("Q2", None)], "id_wikidata string, gender string")
    lists = [spark.createDataFrame([(n,) for n in names], "name string") for names in (["Nancy Astor", "nancy astor", None, "12"], ["Lady Reading"])]
    out = genders.of_members(members, items, *lists, spark.createDataFrame(NAMES, "first_name string, gender string"))
    got = {r["row_id"]: (r["gender_inferred"], r["gender_source"]) for r in out.collect()}
    assert len(got) == len(cases)
    for i, x in enumerate(cases):
        assert got[i] == x[8:], x


def test_aliases(spark):
    cases = [
        (("John Henry", "Smith", "Jack", "", "Lord", "Rook", "Ely"), ["John Henry Smith", "JH Smith", "J H Smith", "J Smith", "Jack", "Lord Rook", "Lord Rook of Ely", "Rook of Ely", "Lord of Ely", "Lord Ely"]),
        ((None, "Smith", None, "Smyth", "Sir", None, None), ["Smith", "Smyth"]), (("Ann", None, None, None, None, "Rook", None), ["Ann"]), ((None,) * 7, []), (("", " ", "", "", "", "", ""), []),
    ]
    names = ["a", "b", "c", "d", "e", "f", "g"]
    rows = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in names))
    got = {r[0]: r[1] for r in rows.select("i", genders.aliases(*[F.col(n) for n in names])).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_gamma(spark):
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0), (60.0, 2, math.exp(-30)), (700.0, 1, 0.0), (0.5, 7, math.erfc(0.5) + math.exp(-0.25) * sum(0.25 ** (k - 0.5) / math.gamma(k + 0.5) for k in (1, 2, 3)))]
    rows = spark.createDataFrame([(i, x, d) for i, (x, d, _) in enumerate(known)], "i int, x double, d int")
    got = {r[0]: r[1] for r in rows.select("i", statistics.upper_gamma(F.col("d") / 2, F.col("x") / 2)).collect()}
    for i, (x, d, p) in enumerate(known):
        assert got[i] == pytest.approx(p, abs=1e-11), (x, d)


def test_chi2_tables(spark):
    def force(t):
        rows, cols = [sum(r) for r in t], [sum(c) for c in zip(*t, strict=True)]
        dof, n = (len(rows) - 1) * (len(cols) - 1), sum(rows)
        off = lambda o, e: abs(o - e) - min(0.5, abs(o - e)) * (dof == 1)
        return sum(off(t[i][j], rows[i] * cols[j] / n) ** 2 / (rows[i] * cols[j] / n) for i in range(len(rows)) for j in range(len(cols))), dof

    for t in ([[10, 20], [30, 40]], [[5, 0], [0, 7]], [[1, 2, 3], [4, 0, 6]], [[3, 3]], [[8, 1, 0], [0, 9, 1], [1, 0, 7], [2, 2, 2]], [[5, 5], [5, 5]]):
        cells = [(f"r{i}", f"c{j}") for i, r in enumerate(t) for j, n in enumerate(r) for _ in range(n)] + [(None, "c0"), ("r0", None)]
        got = statistics.chi2_test(spark.createDataFrame(cells, "a string, b string"), "a", "b").first()
        chi2, dof = force(t)
        assert (got["chi2"], got["dof"]) == (pytest.approx(chi2, abs=1e-9), dof)
        assert dof != 2 or got["p"] == pytest.approx(math.exp(-chi2 / 2), abs=1e-11)
        assert dof or got["p"] == 1.0
