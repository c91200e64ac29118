import time

import numpy as np
import pytest

from agoraspark.llm import topk


def by_force(rows, queries, k, own):
    score = queries.astype(np.int64) @ rows.astype(np.int64).T
    mine = np.flatnonzero(own >= 0)
    score[mine, own[mine]] = -(2**62)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(score, order, axis=1)


def tables():
    rng = np.random.default_rng(8)
    plain = np.floor(32 * rng.normal(size=(3000, 24))).astype(np.int16)
    scaled = np.floor(np.geomspace(4000, 1, 24) * rng.normal(size=(3000, 24))).astype(np.int32)
    sparse = np.where(rng.random((3000, 24)) < 0.1, plain, 0).astype(np.int16)
    copies = plain.copy()
    copies[100:2500] = plain[7]
    large = rng.integers(-(2**26), 2**26, (3000, 24))
    close = (large // 2**12 * 2**12 + rng.integers(0, 3, (3000, 24))).astype(np.int64)  # scores differ beyond single precision
    close[:, :23] = close[0, :23]
    return {"plain": plain, "scaled": scaled, "sparse": sparse, "copies": copies, "large": large, "close": close, "one value": np.full((3000, 24), 5, np.int16), "zeros": np.zeros((3000, 24), np.int16)}


@pytest.mark.parametrize("few", [0.0, topk.FEW, 1.0])
@pytest.mark.parametrize("name", list(tables()))
def test_op8_batches_are_exact(name, few, monkeypatch):
    """Whatever the values and however many queries a batch holds, the best are those of brute force, the first of equals first."""
    monkeypatch.setattr(topk, "HELD", 40 * 3000)
    rows = tables()[name]
    own = np.where(np.arange(100) % 3 > 0, np.arange(0, 3000, 30), -1)
    queries = np.concatenate([rows[np.arange(0, 3000, 30)][:90], 7 * rows[:9], np.zeros((1, 24), rows.dtype)]).astype(np.int64)
    own[90:] = -1
    q, row, score = topk.ImpactIndex(rows).best(queries, 5, own, few)
    want_row, want_score = by_force(rows, queries, 5, own)
    assert (q == np.repeat(np.arange(100), 5)).all()
    assert (row.reshape(-1, 5) == want_row).all() and (score.reshape(-1, 5) == want_score).all()


def test_op8_a_block_costs_few_seconds():
    """300 queries past a full block, in CPU seconds: segment by segment and query by query they took about 6."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(topk.BLOCK, 64))
    rows = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    own = np.arange(300)
    index = topk.ImpactIndex(rows)
    before = time.thread_time()
    found = index.best(rows[:300], 5, own)
    assert time.thread_time() - before < 1.5
    left = index.pairs(rows[:300], 5, own)[0]
    assert len(left) < 300 * len(rows) / 20  # most are proved out before their last segments
    assert (found[1].reshape(-1, 5) == by_force(rows, rows[:300], 5, own)[0]).all()


def test_op8_equal_vectors_are_held_k_plus_one_times():
    rows = np.array([[1, 2], [3, 4], [1, 2], [1, 2], [3, 4], [1, 2]], np.int16)
    assert topk._first(rows, 3).tolist() == [0, 1, 2, 3, 4] and topk._first(rows[:0], 3).tolist() == []


@pytest.mark.parametrize("block", [200, 16_384])
def test_op8_copies_and_ties(spark, block):
    """Hundreds of copies over several blocks, queries among them and not: the smallest ids of equals, never a query's own row."""
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(600, 8)), 2)
    v[50:500] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * v).astype(np.int64)
    asked = np.arange(0, 600, 50)
    order, score = by_force(whole, whole[asked], 5, asked)
    want = sorted((int(q), n + 1, int(order[i, n]), int(score[i, n])) for i, q in enumerate(asked) for n in range(5))
    assert sorted(map(tuple, topk.search(rows, "vec_id % 50 = 0", block=block).collect())) == want


def test_op8_blocks_grow_with_the_table():
    """Each query is copied once for a block: beyond a million rows blocks become larger, wide vectors make them shorter."""
    assert [topk._blocks(n, 64, topk.BLOCK) for n in (0, 1, 16_384, 51_282, 2**20, 2**21, 2**23, 2**24)] == [1, 1, 1, 4, 64, 64, 64, 128]
    assert topk._blocks(16_384, 6400, topk.BLOCK) == 64 and topk._blocks(400, 12, 100) == 4
