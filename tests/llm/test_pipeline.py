"""The pipeline's stages and the entry of the operators' queries."""

from __future__ import annotations

import collections
import os
import random

import corpus_pipeline
from agoraspark.llm import queries
from agoraspark.session import folders, release, shared_dir

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)


def test_stages_take_effect(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    counts, kept = [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == first.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, first.schema)
        counts.append(len(rows))
        kept.append(collections.Counter(r["doc_id"] for r in rows))
    assert counts[1] < counts[0] <= first.count() and counts[2] < counts[1]
    assert all(set(b) <= set(a) for a, b in zip(kept, kept[1:], strict=False)) and max(kept[3].values()) > 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) == counts[3] and len({(r["shard"], r["slot"]) for r in last}) == counts[3]


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, taken long"


def odd_tables(spark, folder, documents=None):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names; labels twice and without a text."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    plain = [" ".join(word() for _ in range(80)) for _ in range(40)]
    near = plain[0].split()
    near[40] = "other"
    item = " ".join(word() for _ in range(30))
    texts = [(i, t, f"s{i % 3}") for i, t in enumerate(plain)] + [(100, plain[0], "s0"), (101, " ".join(near), "s1"), (102, plain[3] + " " + item, "s1"), (103, None, "s2"), (104, "", None), (105, " \n", "s0")]
    texts += [(106, "same row", "s2")] * 3 + [(None, "no id but some words here", "s1"), (107, " ".join(word() for _ in range(30_000)), "s0")]
    rows = [(i, t, None, s, None, 5, "clash", 9) for i, t, s in texts] if documents is None else documents
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, int(i % 4 == 0)) for i in range(40)] + [(1, 1, 0), (1, 1, 1), (999, 0, 1), (None, 0, 1), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_odd_tables(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    empty = first.where("false")
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, first, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        rows = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
        if name == "sharding":
            assert kept.columns == none.columns == ["doc_id", "text", "lang", "source", "n_chars", "own_shard", "row", "taken", "shard", "slot"] and sum(rows.values()) == first.count()
        else:
            assert kept.columns == none.columns == first.columns, name
        if name == "near_duplicates":
            assert [k for k, _ in rows if k in (0, 100, 101)] == [0] and rows[106, "same row"] == 1 and rows[103, None] == rows[104, ""] == 1
        if name == "decontamination":
            assert not any(k == 102 for k, _ in rows) and sum(rows.values()) == first.count() - 1 and rows[106, "same row"] == 3
        if name == "mixing":
            assert not any(k in (103, 104, 105) for k, _ in rows) and max(rows.values()) > 1


def test_run_is_the_stages_in_turn_and_leaves_one_folder(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    begun = folders(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = collections.Counter((r["doc_id"], r["text"], r["shard"]) for r in out.collect())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert rows == collections.Counter((r["doc_id"], r["text"], r["shard"]) for r in docs.collect())
    slots = collections.defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    release(spark, begun)
    assert folders(spark) == begun


def test_run_takes_an_empty_table(spark, tmp_path):
    odd_tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_release_deletes(spark):
    from agoraspark.llm.common import saved

    begun, kept = folders(spark), len(os.listdir(shared_dir(spark)))
    saved(spark.range(3))
    assert len(os.listdir(shared_dir(spark))) == kept + 1
    release(spark, begun)
    assert len(os.listdir(shared_dir(spark))) == kept
