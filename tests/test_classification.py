"""Rows that arrive are asked about once each, whatever happens to the run."""

from __future__ import annotations

import collections
import datetime
import time

import pytest
from pyspark.sql.types import StructType

from agoraspark.streaming import classification

SCHEMA = StructType().add("speech_id", "string").add("text", "string").add("at", "timestamp")
FIELDS = "stance string, confidence double"


def arrive(spark, source, ids, day=1):
    at = datetime.datetime(2020, 1, day)
    spark.createDataFrame([(i, f"text {i}", at) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(source)


def asking(log, dies_at=None, fails=()):
    """A client that writes down what it is asked, and brings the run down at a call, or fails at some texts."""

    def client(text):
        with open(log, "a") as f:
            f.write(f"{text}\n")
        with open(log) as f:
            n = len(f.readlines())
        if dies_at and n >= dies_at:
            raise SystemExit("killed")
        if text in fails:
            raise TimeoutError("late")
        return {"stance": text.upper(), "confidence": 0.5}

    return client


def calls(log):
    return collections.Counter(log.read_text().split("\n")[:-1])


def test_a_killed_run_is_taken_up_where_it_was(spark, tmp_path):
    source, folder, log = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "log"
    arrive(spark, source, [f"s{i}" for i in range(40)])
    run = lambda client: classification.answered(spark, source, SCHEMA, folder, client, FIELDS, batch=5, calls=2, wait=0)
    with pytest.raises(Exception, match="killed|aborted|failure|Exit"):
        run(asking(log, dies_at=25))
    first = calls(log)
    kept = classification.answers(spark, folder, StructType.fromDDL(f"speech_id string, {FIELDS}, error string")).collect()
    assert 0 < len(kept) < 40
    got = run(asking(log)).collect()
    again = calls(log) - first
    assert sorted(r["speech_id"] for r in got) == sorted(f"s{i}" for i in range(40)) and all(r["stance"] == f"TEXT {r['speech_id'].upper()}" and not r["error"] for r in got)
    assert set(again) == {f"text s{i}" for i in range(40)} - {f"text {r['speech_id']}" for r in kept} and set(again.values()) == {1}
    before = calls(log)
    arrive(spark, source, ["s1", "s40", "s40", "s41"])
    assert len(run(asking(log)).collect()) == 42
    assert calls(log) - before == {"text s40": 1, "text s41": 1}


def test_failures_are_rows_and_are_asked_again_if_wanted(spark, tmp_path):
    source, folder, log = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "log"
    arrive(spark, source, ["a", "b", None])
    began = time.perf_counter()
    got = {r["speech_id"]: r for r in classification.answered(spark, source, SCHEMA, folder, asking(log, fails=["text b"]), FIELDS, wait=0.4).collect()}
    assert set(got) == {"a", "b"} and got["b"]["error"] == "TimeoutError: late" and got["b"]["stance"] is None and got["a"]["error"] is None
    assert calls(log)["text b"] == 3 and time.perf_counter() - began > 1.2  # 0.4 and then 0.8 seconds
    arrive(spark, source, ["b"])
    assert {r["speech_id"]: r["error"] for r in classification.answered(spark, source, SCHEMA, folder, asking(log), FIELDS).collect()}["b"] == "TimeoutError: late"
    arrive(spark, source, ["b"])
    got = classification.answered(spark, source, SCHEMA, folder, asking(log), FIELDS, again=True).collect()
    assert {r["speech_id"]: r["error"] for r in got} == {"a": None, "b": None}


def test_rows_that_come_again_are_dropped_within_the_watermark(spark, tmp_path):
    source, folder, log = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "log"
    for day in (1, 1, 2):
        arrive(spark, source, ["x", "y"], day)
    got = classification.answered(spark, source, SCHEMA, folder, asking(log), FIELDS, time="at", watermark="10 days", files=1).collect()
    assert sorted(r["speech_id"] for r in got) == ["x", "y"] and set(calls(log).values()) == {1}


def test_nothing_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert classification.answered(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", asking(tmp_path / "log"), FIELDS).count() == 0
