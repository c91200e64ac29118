"""Every query that SQL can express agrees with its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from agoraspark.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).limit(1).count() == 1
