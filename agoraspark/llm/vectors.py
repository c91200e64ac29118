"""Operator 11, embedding near-dedup by product quantisation: coarse inverted lists, residual codes, exact cosines.

1. Equal vectors become one node with a count. On a sample of about SAMPLE nodes, chosen where they are by a hash, k-means
   finds the lists' centroids (as many as the square root of the nodes, at most MOST_LISTS) and, for each of SUBSPACES
   parts of the residuals, CODES codewords.
2. Every node enters the list of its nearest centroid with its residual's codes and the exact distance between it and what
   the codes stand for. It probes the lists nearest to it; how many is measured on the sample: vectors turned away to just
   the cosine asked for must be found, from either side, in FOUND of all cases.
3. The nodes that probe a list meet its members in tasks of at most MEMBERS by PROBERS nodes. The distance of a node to a
   member's code is a sum of SUBSPACES table look-ups; with the stored error it bounds the true distance from below, so no
   pair within the limit is lost here. What the bound lets through has its cosine taken in double precision.
4. A pair is counted for the prober; for the member as well, unless the member probes the prober's list and so counts it
   there. So counts agree from both sides, and no pair is a row: a task gives a count for each node, and a forest of what
   it has linked, whose connected components are the groups.

Tests hold the recall of links against brute force. A list's length grows with the nodes once there are MOST_LISTS lists;
tasks stay as large as they are.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing and are kept; shorter
vectors count as padded with zeros; finite components of any size (a vector is scaled by a power of two first); rows with
the same id are rows of their own; a null id is linked, but never a group's smallest unless alone; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from agoraspark.llm.common import components, saved, ship, small, table

SAMPLE, MOST_LISTS = 32_768, 4096
SUBSPACES, CODES = 8, 256
#: The share of pairs just at the limit that the probes must find on the sample.
FOUND = 0.995
MEMBERS, PROBERS, CHUNK = 4096, 8192, 256
#: More than float32 tables can be wrong by, for vectors of length 1.
SLACK = 1e-3


def _vectors(column: pa.Array, kind: type) -> tuple[list[bytes | None]]:
    """Each vector's components, if all are finite and not all zero, scaled by a power of two, else None."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        x = np.array(v if v and None not in v else [np.nan], np.float64)
        if not np.isfinite(x).all() or not (most := np.abs(x).max()):
            out.append(None)
        else:
            out.append((np.ldexp(x, -int(np.frexp(most)[1])) + 0.0).astype(kind).tobytes())
    return out


def _read(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_vectors(b.column("vector"), kind), pa.binary())], ["id", "vec"])

    return run


def matrix(vecs: list[bytes], kind: type, width: int) -> np.ndarray:
    """Rows of length 1 in double precision, padded to width."""
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, kind)
        out[i, : len(x)] = x
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, many: int = 1) -> np.ndarray:
    """The indexes of the nearest centroids of each row, nearest first."""
    half = 0.5 * (centroids * centroids).sum(axis=1)
    out = np.empty((len(x), many), np.int64)
    for at in range(0, len(x), 4096):
        score = half - x[at : at + 4096] @ centroids.T
        if many == 1:
            out[at : at + 4096, 0] = score.argmin(axis=1)
        else:
            best = np.argpartition(score, many - 1, axis=1)[:, :many]
            order = np.take_along_axis(score, best, axis=1).argsort(axis=1, kind="stable")
            out[at : at + 4096] = np.take_along_axis(best, order, axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)[:, 0]
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        centroids[used] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
        idle = np.setdiff1d(np.arange(k), used)
        centroids[idle] = x[rng.integers(0, len(x), len(idle))]
    return centroids


def fitted(x: np.ndarray, nodes: int, cosine: float) -> dict:
    """Centroids, codewords (a table a subspace) and the number of probes, from sampled vectors of length 1."""
    rng = np.random.default_rng(11)
    x = x.astype(np.float32)
    lists = max(1, min(MOST_LISTS, len(x) // 8, 2 ** round(np.log2(max(1, nodes)) / 2)))
    centroids = kmeans(x, lists, rng)
    rest = x - centroids[nearest(x, centroids)[:, 0]]
    part = x.shape[1] // SUBSPACES
    words = [kmeans(rest[:, m * part : (m + 1) * part], min(CODES, len(x)), rng) for m in range(SUBSPACES)]
    some = x[rng.permutation(len(x))[:4096]]
    away = rng.normal(size=some.shape).astype(np.float32)
    away -= (away * some).sum(axis=1, keepdims=True) * some
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-30)
    away = cosine * some + np.sqrt(1 - cosine * cosine, dtype=np.float32) * away
    half = 0.5 * (centroids * centroids).sum(axis=1)
    one, two = half - some @ centroids.T, half - away @ centroids.T
    at = np.arange(len(some))
    rank = np.minimum((one < one[at, two.argmin(axis=1)][:, None]).sum(axis=1), (two < two[at, one.argmin(axis=1)][:, None]).sum(axis=1))
    probes = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(FOUND * len(rank))))]) + 1
    return {"centroids": centroids, "words": words, "probes": min(lists, probes), "width": x.shape[1]}


def encoded(x: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probed lists, its own first; codes; distance to what the codes stand for) of each vector."""
    probes = nearest(x.astype(np.float32), index["centroids"], index["probes"])
    rest = x - index["centroids"][probes[:, 0]]
    part, codes, error = x.shape[1] // SUBSPACES, np.empty((len(x), SUBSPACES), np.uint8), np.zeros(len(x))
    for m, words in enumerate(index["words"]):
        own = rest[:, m * part : (m + 1) * part]
        codes[:, m] = nearest(own.astype(np.float32), words)[:, 0]
        error += ((own - words[codes[:, m]]) ** 2).sum(axis=1)
    return probes, codes, np.sqrt(error)


def _encode(index: dict, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            probes, codes, error = encoded(matrix(b.column("vec").to_pylist(), kind, index["width"]), index)
            cols = [
                b.column("node"), b.column("n"), b.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                pa.FixedSizeListArray.from_arrays(pa.array(probes.ravel().astype(np.int32)), probes.shape[1]).cast(pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["node", "n", "vec", "code", "error", "probes"])

    return run


class Forest:
    """What pairs connect, for pairs that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            a, b = np.maximum(a, b), np.minimum(a, b)
            a, b = a[a != b], b[a != b]
            np.minimum.at(self.root, a, b)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def linked(queries: np.ndarray, members: np.ndarray, codes: np.ndarray, error: np.ndarray, centroid: np.ndarray, index: dict, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs with a cosine of at least `cosine`, in arrays. Members are those of one list, vectors of length
    1. The distance from a query to a member's code comes from tables; it is off by the member's error at most."""
    far = np.sqrt(2 - 2 * cosine) + error + SLACK
    far, part = (far * far).astype(np.float32), members.shape[1] // SUBSPACES
    for at in range(0, len(queries), CHUNK):
        own = queries[at : at + CHUNK]
        rest, distance = (own - centroid).astype(np.float32), np.zeros((len(own), len(members)), np.float32)
        for m, words in enumerate(index["words"]):
            x = rest[:, m * part : (m + 1) * part]
            asymmetric = (x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1)
            distance += asymmetric[:, codes[:, m]]
        q, x = np.nonzero(distance <= far)
        if len(q) > 0.02 * distance.size:
            q, x = np.nonzero((distance <= far) & (own @ members.T >= cosine))
        elif len(q):
            good = np.concatenate([np.einsum("ij,ij->i", own[q[i : i + 65536]], members[x[i : i + 65536]]) for i in range(0, len(q), 65536)]) >= cosine
            q, x = q[good], x[good]
        yield q + at, x


def _compare(index: dict, kind: type, cosine: float):
    """(a, b, n): n links more for node a; or a and b are connected."""

    def run(task: pa.Table) -> pa.Table:
        role = task.column("member").to_numpy(zero_copy_only=False)
        at, ours, theirs = task.column("list")[0].as_py(), np.flatnonzero(role), np.flatnonzero(~role)
        node, weight = task.column("node").to_numpy(), task.column("n").to_numpy()
        vecs = matrix(task.column("vec").to_pylist(), kind, index["width"])
        probes = np.array(task.column("probes").to_pylist()).reshape(len(node), -1)
        codes = np.frombuffer(b"".join(task.column("code").take(ours).to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        error = task.column("error").to_numpy()[ours]
        names, place = np.unique(node, return_inverse=True)
        count, forest = np.zeros(len(names), np.int64), Forest(len(names))
        for q, x in linked(vecs[theirs], vecs[ours], codes, error, index["centroids"][at], index, cosine):
            q, x = theirs[q], ours[x]
            q, x = q[node[q] != node[x]], x[node[q] != node[x]]
            np.add.at(count, place[q], weight[x])
            here = ~(probes[x] == probes[q, :1]).any(axis=1)  # the member does not probe the prober's list
            np.add.at(count, place[x[here]], weight[q[here]])
            forest.join(place[q], place[x])
        more, under = np.flatnonzero(count), np.flatnonzero(forest.root != np.arange(len(names)))
        a, b = np.concatenate([names[more], names[under]]), np.concatenate([np.zeros(len(more), np.int64), names[forest.root[under]]])
        n = np.concatenate([count[more], np.zeros(len(under), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=np.arange(len(a)) < len(more)), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(rows: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other vectors it is linked with, and its group's smallest id."""
    spark = rows.sparkSession
    ship(spark)
    own, kind = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector")), np.float32
    names = own.schema["id"].dataType.simpleString()
    if isinstance(own.schema["vector"].dataType.elementType, DoubleType):
        kind = np.float64
    read = own.mapInArrow(_read(kind), f"id {names}, vec binary").withColumn("body", F.unhex(F.md5("vec")))
    read = saved(read)
    nodes = read.where("vec is not null").groupBy("body").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))
    many, width = nodes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    group = nodes.select(F.col("node"), F.lit(0).cast("long").alias("more"), F.col("node").alias("component")).limit(0)
    if many > 1:
        width = -(-width // kind().itemsize // SUBSPACES) * SUBSPACES
        share = min(1 << 30, int(SAMPLE / many * (1 << 30)))
        sample = nodes.where(F.pmod(F.xxhash64("body"), F.lit(1 << 30)) < share).orderBy("body").select("vec").collect()
        index = fitted(matrix([r["vec"] for r in sample], kind, width), many, cosine)
        group = _grouped(nodes, index, kind, cosine)
    known = nodes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    # Nodes are distinct; a component of very many is split by adaptive execution, a vector of very many rows is broadcast.
    known = saved(known.join(lowest, "component").select("body", "n", "component_id", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    hot = small(known.where(F.col("n") > 2000).drop("n"))
    rest = read.join(hot.select("body"), "body", "left_anti").join(known.where(F.col("n") <= 2000).drop("n"), "body", "left")
    out = rest.unionByName(read.join(hot, "body"))
    linked_id = F.when(F.col("body").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), linked_id.alias("component_id"), F.col("id").eqNullSafe(linked_id).alias("kept"))


def _grouped(nodes: DataFrame, index: dict, kind: type, cosine: float) -> DataFrame:
    """(node, more, component) of the nodes that are linked: the rows of other nodes they are linked with."""
    coded = saved(nodes.select("node", "n", "vec").mapInArrow(_encode(index, kind), "node long, n long, vec binary, code binary, error double, probes array<int>"))
    met = coded.select(F.explode("probes").alias("list"), (F.element_at("probes", 1) == F.col("list")).cast("int").alias("own"))
    sizes = met.groupBy("list").agg(F.ceil(F.sum("own") / MEMBERS).cast("int").alias("across"), F.ceil(F.count("*") / PROBERS).cast("int").alias("down"))
    sizes = F.broadcast(saved(sizes.where("across > 0")))  # at most MOST_LISTS rows
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    names = ["node", "n", "vec", "probes"]
    ours = coded.withColumn("list", F.element_at("probes", 1)).join(sizes, "list")
    ours = ours.select("list", slot("across").alias("i"), cells("down").alias("j"), F.lit(True).alias("member"), *names, "code", "error")
    theirs = coded.select(F.explode("probes").alias("list"), *names).join(sizes, "list")
    theirs = theirs.select("list", cells("across").alias("i"), slot("down").alias("j"), F.lit(False).alias("member"), *names, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    found = saved(ours.unionByName(theirs).groupBy("list", "i", "j").applyInArrow(_compare(index, kind, cosine), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    return counts.join(components(found.where("b is not null").select("a", "b")), "node", "full")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
