"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, odd columns, large groups, many blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from agoraspark.llm import filter_audit, merkle, vectors


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def links_by_force(rows, cosine=0.9):
    """{position: (links, group as a set of positions)} of rows (id, vector or None)."""
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    width = max([len(v) for v in good.values()], default=0)
    unit = {i: np.pad(v / np.abs(v).max(), (0, width - len(v))) for i, v in good.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= cosine} for i in unit}
    out = {}
    for i in range(len(rows)):
        seen, front = {i}, [i]
        while front:
            front = [j for x in front for j in near.get(x, ()) if j not in seen and not seen.add(j)]
        out[i] = (len(near.get(i, ())), seen)
    return out


def test_op11_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []),
        (9, [1e300, 1e299]), (10, [-1.0, 0.0]), (10, [-1.0, 0.0]), (11, [0.0, 1e-310]), (None, [-3.0, 0.1]), (None, [0.0, -1.0]), (12, [-0.0, 5.0]),
    ]
    docs = spark.createDataFrame([(i, v, "x", 1, 2, None) for i, v in rows], "vec_id long, embedding array<double>, body string, n int, node int, vec string")
    got = sorted(map(tuple, vectors.near_vectors(docs).collect()), key=repr)
    want = []
    for i, (n, group) in links_by_force(rows).items():
        least = min([rows[j][0] for j in group if rows[j][0] is not None], default=None)
        want.append((rows[i][0], n, least, rows[i][0] == least))
    assert got == sorted(want, key=repr) and vectors.near_vectors(docs.limit(0)).count() == 0


def test_op11_finds_links_of_every_kind(spark):
    """Vectors turned to just above and below the limit, groups of near copies, and many exact copies."""
    rng = np.random.default_rng(3)

    def turned(v, cosine):
        away = rng.normal(size=(len(v), v.shape[1]))
        away -= (away * v).sum(1, keepdims=True) * v
        return cosine * v + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)

    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    every = [base, turned(base[:400], 0.905), turned(base[400:600], 0.895), turned(np.repeat(base[:2], 150, axis=0), 0.97), np.repeat(base[2:3], 700, axis=0)]
    x = (np.concatenate(every) * rng.uniform(0.1, 9, (sum(map(len, every)), 1))).astype(np.float32)
    x[-700:] = x[2]
    order = rng.permutation(len(x))
    rows = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<float>")
    got = {r[0]: tuple(r)[1:] for r in vectors.near_vectors(rows).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert all(got[i][0] <= n for i, n in enumerate(near.sum(axis=1)))  # none below the limit
    assert sum(n for n, _, _ in got.values()) >= 0.99 * near.sum()
    assert all(got[i][0] == near[i].sum() and got[i][1] == 2 for i in range(len(x) - 700, len(x)))
    assert all(c <= i and k == (c == i) for i, (_, c, k) in got.items())


def test_op11_counts_agree_from_both_sides(spark, monkeypatch):
    """Small tasks and a single probe: what is found is found from both sides, and tasks together find what one does."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 16)), 20, axis=0) + 0.25 * rng.normal(size=(800, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, vectors.near_vectors(rows).collect()))
    monkeypatch.setattr(vectors, "MEMBERS", 7)
    monkeypatch.setattr(vectors, "PROBERS", 11)
    assert sorted(map(tuple, vectors.near_vectors(rows).collect())) == whole
    assert sum(r[1] for r in whole) % 2 == 0
    fitted = vectors.fitted
    monkeypatch.setattr(vectors, "fitted", lambda *a: fitted(*a) | {"probes": 1})
    assert sum(r[1] for r in vectors.near_vectors(rows).collect()) % 2 == 0


def test_op11_bound_loses_nothing():
    """Within a list, whatever the codes stand for, every pair at the limit gets through."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x = np.concatenate([x, x + 0.3 * rng.normal(size=x.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.fitted(x[:64], 64, 0.9)
    probes, codes, error = vectors.encoded(x, index)
    for at in range(len(index["centroids"])):
        ours = np.flatnonzero(probes[:, 0] == at)
        got = {(int(q), int(ours[m])) for a, b in vectors.linked(x, x[ours], codes[ours], error[ours], index["centroids"][at], index, 0.9) for q, m in zip(a, b, strict=True)}
        assert got == {(int(q), int(m)) for q in range(len(x)) for m in ours if x[q] @ x[m] >= 0.9}


def trees_by_force(docs):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            first = i // 16 * 16
            yield nodes[first:i], nodes[i + 1 : first + 16]
            i //= 16

    by = {}
    for d in docs:
        by.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, sha("".join(map(enc, d))), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in by[s]]) for s in sources if not by[s].sort(key=lambda x: x[:3])}
    top, out = climb([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, d) in enumerate(by[s]):
            way, now = [*path(trees[s], i), *path(top, k)], leaf
            if d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
                now = sha("".join(map(enc, [*d[:4], re.sub("[A-Z]", lambda m: m[0].lower(), d[4])])))
            for a, b in way:
                now = sha("".join(a) + now + "".join(b))
            root = top[-1][0]
            out.append((d[0], leaf, trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in way)), now, now == root))
    return sorted(out, key=repr)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_op12_against_whole_trees(spark, monkeypatch, levels):
    """Sources of 1 to 600 rows, in blocks of 16 to 4,096 leaves; more than 16 sources; nulls, repeated ids and rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rnd, rows = random.Random(levels), []
    for source, n in [(None, 3), ("", 17), ("é", 1), ("z", 600), ("￿", 2), ("\U0001f600", 2), *[(f"s{i}", rnd.randrange(1, 40)) for i in range(15)], ("t", 257)]:
        for _ in range(n):
            text = rnd.choice([None, "", "ÀÉ only", "Some TEXT", "plain words", f"Text {rnd.random()}"])
            rows.append((rnd.choice([None, *range(1, 9), *[rnd.randrange(10**6) for _ in range(90)]]), source, rnd.choice([None, "en"]), rnd.choice([None, 7]), text))
    rows += [rows[5], rows[30], rows[30]]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], FIELDS + ", leaf string, tree int, at int")
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == trees_by_force(rows)


def test_op12_few_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], FIELDS)
    assert list(map(tuple, merkle.manifest(docs).collect())) == trees_by_force([(1, None, None, None, None)])
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_op12_traversal_keeps_two_runs_a_level(monkeypatch):
    """Every path is right, for all sizes, and what is held stays as small as the number of levels allows."""
    held, take = [0], merkle.Grown.take

    def watched(self, leaf, last):
        take(self, leaf, last)
        held[0] = max(held[0], sum(map(len, self.open)))

    monkeypatch.setattr(merkle.Grown, "take", watched)
    for fan, most in ((2, 70), (3, 100), (16, 700)):
        for n in [*range(1, 20), most - 1, most]:
            leaves = [sha(str(i)) for i in range(n)]
            levels, held[0] = next(k for k in range(20) if fan**k >= n), 0
            nodes = [leaves]
            for _ in range(levels):
                nodes.append([merkle.joined(nodes[-1][i : i + fan]) for i in range(0, len(nodes[-1]), fan)])
            for i, path in enumerate(merkle.traversed(leaves, levels, fan)):
                assert path == [(nodes[k][i // fan ** (k + 1) * fan : (i // fan ** (k + 1) + 1) * fan], i // fan**k % fan) for k in range(levels)]
            assert held[0] <= fan * (levels + 1)


def test_op13_against_all_orders(spark):
    rnd = random.Random(13)
    bodies = [None, "", " \n", "word " * 60, " ".join(f"w{i}" for i in range(60)), "LOUD " * 9, "a # b", "x y", "É" * 60]
    bodies += [" ".join(rnd.choice(["One", "two", "three#", *[f"w{i}" for i in range(90)]]) for _ in range(rnd.randrange(30, 80))) for _ in range(60)]
    docs = [(rnd.choice([None, *range(120)]), rnd.choice(bodies), rnd.choice([None, "", "a", "b"])) for _ in range(400)]
    docs += [(500 + i, "the same text", "hot") for i in range(50)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(520) for _ in range(rnd.choice([0, 1, 2]))] + [(None, 1, 1)]
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None}
    flagged = []
    for i, text, source in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        flagged.append((source or "", fails, i in good, i in toxic))
    want, gone = {}, {}
    for part in {f[0] for f in flagged}:
        rows = [f[1:] for f in flagged if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                gone[part, f] = gone.get((part, f), 0) + len(here)
                sole = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                want[part, order, step] = [len(left), len(here), sum(r[0][f] for r in rows) - len(here), sole, sum(r[1] for r in here), sum(r[2] for r in here)]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, n int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit(filter_audit.flagged(table), known).collect()}
    assert got == {k: [*v, gone[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    assert filter_audit.audit(filter_audit.flagged(table.limit(0)), known).count() == 0
