"""The linkage cascade on names written by hand, one for each path and their mixtures."""

from __future__ import annotations

import datetime

import pytest

from agoraspark.plans import cascade

REGISTER = [
    # nth, id, name, gender, house, first and last year, seats
    (1, "a", "John Smith", "M", "Commons", 1950, 1960, ["Leeds North"]),
    (2, "b", "Jane Smith", "F", "Commons", 1955, 1965, ["Leeds South"]),
    (3, "c", "Robert Brown", "M", "Commons", 1950, 1952, ["York"]),
    (4, "c", "Robert Brown", "M", "Commons", 1952, 1958, ["York", "Hull"]),
    (5, "d", "Henry Jones", "M", "Commons", 1950, 1960, []),
    (6, "e", "Hugh Jones", "M", "Commons", 1950, 1960, []),
    (7, "f", "Hilary Jones", "M", "Commons", 1950, 1960, None),
    (8, "g", "Maud Lindsay", "F", "Commons", 1950, 1960, []),
    (9, "h", "Mary Lindsay", "F", "Commons", 1950, 1960, []),
    (10, "i", "Anna Gray", "F", "Lords", 1950, 1960, []),
    (11, "j", "Winston Churchill", "M", "Commons", 1945, 1960, ["Woodford"]),
    (12, "k", "Winston Churchill", "M", "Commons", 1970, 1990, ["Stretford"]),
    (13, "l", "Pieter Dyk", None, "Commons", 1950, 1960, []),
    (14, "m", "Ada O'Brien", "F", "Commons", 1950, None, []),
    (15, "n", "Lena O'Brien", "F", "Commons", 1950, 2030, ["Ely"]),
    (16, "o", "Max Davies", "M", "Commons", 1950, 1960, ["leeds north"]),
    (17, "p", None, "M", "Commons", 1950, 1960, []),
]
CASES = [
    # speaker, day, house: type, name, person, gender, confidence, candidates
    ("Mr. John Smith", "1951-05-05", "Commons", "temporal_unique", "John Smith", "a", "M", 0.85, 0),
    ("Mr. Smith", "1951-05-05", None, "temporal_unique", "John Smith", "a", "M", 0.85, 0),
    ("Mr. Smith", "1957-05-05", "Commons", "ambiguous", None, None, None, 0.0, 2),
    ("Mrs. J. SMITH", "1957-05-05", "Commons", "ambiguous", None, None, None, 0.0, 2),  # both begin with J
    ("*MRS.SMITH:", "1963-01-01", "Commons", "temporal_unique", "Jane Smith", "b", "F", 0.85, 0),
    ("24. Mr. R. Brown,", "1952-06-06", "Commons", "temporal_unique", "Robert Brown", "c", "M", 0.9, 0),
    ("Mr. Jones", "1955-01-02", "Commons", "ambiguous_consistent_gender", None, None, "M", 0.6, 3),
    ("Miss Lindsay", "1955-01-02", "Commons", "ambiguous", None, None, None, 0.0, 2),  # a name of both
    ("Miss Q. Lindsay", "1955-01-02", "Commons", "ambiguous", None, None, None, 0.0, 2),  # no such initial: all of them
    ("Miss Mary Gray", "1955-01-02", "Lords", "temporal_unique", "Anna Gray", "i", "F", 0.85, 0),
    ("Miss Gray", "1955-01-02", "Commons", "title_gender_inference", None, None, "F", 0.3, 0),
    ("The Prime Minister", "1953-03-03", "Commons", "title", "Winston Churchill", "j", "M", 0.95, 0),
    ("The PRIME MINISTER", "1951-10-26", "Commons", "ambiguous_consistent_gender", None, None, "M", 0.6, 2),
    ("The Prime Minister", "1985-03-03", None, "title", "Margaret Thatcher", None, "F", 0.95, 0),
    ("The Prime Minister", "1930-03-03", None, "no_match", None, None, None, 0.0, 0),
    ("The Member for York", "1951-03-03", None, "constituency", "Robert Brown", "c", "M", 0.95, 0),
    ("the hon. Member for York", "1952-03-03", None, "no_match", None, None, None, 0.0, 0),  # two stints
    ("Member for LEEDS NORTH.", "1955-03-03", None, "no_match", None, None, None, 0.0, 0),  # two people
    ("The Member for Leeds South", "1955-03-03", None, "constituency", "Jane Smith", "b", "F", 0.95, 0),
    ("MP for Ely", "2005-03-03", None, "constituency", "Lena O'Brien", "n", "F", 0.95, 0),
    ("MP for Ely", "2006-03-03", None, "no_match", None, None, None, 0.0, 0),  # beyond the last year
    ("The Minister of Food (Mr. John Smith)", "1951-05-05", "Commons", "titled_extraction", "John Smith", "a", "M", 0.8075, 0),
    ("The Minister of Food (Mr. Nobody)", "1951-05-05", "Commons", "title_gender_inference", None, None, "M", 0.3, 0),
    ("The Prime Minister (Mr. Nobody)", "1953-03-03", "Commons", "title", "Winston Churchill", "j", "M", 0.95, 0),
    ("Mr. BROWN (by Private Notice).", "1951-05-05", "Commons", "parenthetical_stripped", "Robert Brown", "c", "M", 0.8075, 0),
    ("Mr. BROWN (resuming) (Lord of the Treasury)", "1951-05-05", "Commons", "parenthetical_stripped", "Robert Brown", "c", "M", 0.767125, 0),
    ("The Minister (Mr. Brown) (resuming)", "1951-05-05", "Commons", "parenthetical_stripped", "Robert Brown", "c", "M", 0.767125, 0),
    ("Mr. Smith (resuming)", "1957-05-05", "Commons", "title_gender_inference", None, None, "M", 0.3, 0),  # its last word is no name
    ("Mr. Speaker", "1951-05-05", "Commons", "procedural", None, None, None, 0.0, 0),
    ("Several hon. Members (Mr. Brown)", "1951-05-05", "Commons", "procedural", None, None, None, 0.0, 0),
    ("Sir van Dyk", "1951-05-05", "Commons", "fuzzy", "Pieter Dyk", "l", None, 0.7, 0),
    ("Sir A. van Dyk (resuming)", "1951-05-05", "Commons", "parenthetical_stripped", "Pieter Dyk", "l", None, 0.665, 0),
    ("Mrs. O’ Brien", "1951-05-05", "Commons", "temporal_unique", "Lena O'Brien", "n", "F", 0.85, 0),
    ("mr.0'brien", "1951-05-05", "Commons", "temporal_unique", "Lena O'Brien", "n", "F", 0.85, 0),
    ("Mr. Bavies", "1951-05-05", "Commons", "temporal_unique", "Max Davies", "o", "M", 0.85, 0),
    ("Winston Churchill", "1971-01-01", "Commons", "temporal_unique", "Winston Churchill", "k", "M", 0.85, 0),
    ("Winston Churchill", "1960-01-01", "Commons", "temporal_unique", "Winston Churchill", "j", "M", 0.85, 0),
    ("Winston Churchill", "1990-07-07", "Commons", "temporal_unique", "Winston Churchill", "j", "M", 0.85, 0),  # no stint at that day: the first
    ("John Smth", "1951-05-05", "Commons", "no_match", None, None, None, 0.0, 0),
    ("Mr. Smith", None, "Commons", "title_gender_inference", None, None, "M", 0.3, 0),
    ("The Earl of X", "1951-05-05", "Lords", "no_match", None, None, None, 0.0, 0),
    ("Earl X", "1951-05-05", "Lords", "title_gender_inference", None, None, "M", 0.3, 0),
    ("()", "1951-05-05", None, "no_match", None, None, None, 0.0, 0), ("", "1951-05-05", None, "no_match", None, None, None, 0.0, 0), (None, None, None, "no_match", None, None, None, 0.0, 0),
]


@pytest.fixture(scope="module")
def tables(spark):
    day = lambda d: d and datetime.date.fromisoformat(d)
    kinds = "nth long, person_id string, person_name string, gender string, chamber string, start_year int, end_year int, constituencies array<string>"
    register = spark.createDataFrame(REGISTER, kinds).repartition(3)
    mentions = [(i, c[0], day(c[1]), c[2], "extra") for i, c in enumerate(CASES)]
    return spark.createDataFrame(mentions, "mention_id long, speaker string, date date, chamber string, text string"), register


def test_every_path(tables):
    got = {r["mention_id"]: tuple(r)[1:] for r in cascade.cascade(*tables).collect()}
    assert len(got) == len(CASES)
    for i, c in enumerate(CASES):
        assert got[i] == c[3:], c[0]


def test_near_surnames(tables):
    got = {CASES[r["mention_id"]][:2]: r["near"] for r in cascade.near_surnames(*tables).collect()}
    assert got == {("John Smth", "1951-05-05"): "John Smith"}


def test_no_pairs_of_people(tables):
    """Joins are equal keys on both sides; none is a product or bounded by a condition alone."""
    plan = cascade.cascade(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_mentions(spark, tables):
    mentions, register = tables
    assert cascade.cascade(mentions.limit(0), register).count() == 0
    found = cascade.cascade(mentions, register.limit(0)).where("final_match is not null")
    assert {r["match_type"] for r in found.collect()} == {"title"}
