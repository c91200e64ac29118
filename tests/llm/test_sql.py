"""The operators that SQL can express agree with it, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from agoraspark.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
