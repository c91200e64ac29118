"""Operator 9, MinHash near-dedup by a multi-index Hamming join.

1. Every document becomes its set of 5-word shingles and a signature of 32 MinHash values cut to 16 bits. Documents with
   the same words are one node from here on (counted with partial sums).
2. Two signatures within 15 differing values have, by pigeonhole, one of 8 chunks of 4 values with at most one error.
   Each chunk is entered under its 4 keys with one value left out, so all pairs within that distance share a key.
3. The nodes of a key are joined to its least node, the hub. All pairs of a key meet again in the hub's group, but a
   pair that shares twenty keys is one row. Groups of up to BLOCK nodes are compared in one task, all pairs, by
   sparse-to-dense products of the full shingle sets in numpy; only a spanning forest of the links is given back.
4. In a larger group all nodes are first compared with a few LEADERS, block by block. What is linked to the leader with
   most links, or to leaders linked to it, is connected: links within it change nothing more. Only nodes left over are
   compared with all of the group, in pairs of blocks that hold at least one of them. No pair is a row.
5. Connected components of the forests are the groups; the smallest doc_id stays.

At a similarity of 0.85 a pair shares no key with probability 0.11**8 = 2e-8 (0.8: 1e-6).

Edge cases: null, empty and blank texts have empty sets, are linked with nothing and kept; texts of fewer than five
words are one shingle; repeated rows are copies; a null doc_id is linked, but never a group's smallest unless alone;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm import bytesets as bs
from agoraspark.llm.common import components, fingerprint, joined_apart, packed, saved, ship, small, table

WORDS, HASHES, CHUNK = 5, 32, 4
#: Nodes of a group that meet in one task; those that all nodes of a larger group are compared with first.
BLOCK, LEADERS = 256, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(9)
_MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, tuple[int, int]]]:
    """(row, sorted 64-bit hashes of its distinct shingles, 128-bit digest of its words) of each row with words."""
    for begin, data, ends in bs.text_groups(column):
        if not len(data):
            continue
        low = _LOWER[data]
        inside = ~_GAP[low]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        row_starts = ends[:-1][ends[:-1] < len(data)]
        opens[row_starts] = inside[row_starts]
        first = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        row_stops = ends[1:][ends[1:] > 0] - 1
        closes[row_stops] = inside[row_stops]
        after = np.flatnonzero(closes) + 1
        sums = bs.prefix_sums(low)
        word = bs.mixed((sums[after] - sums[first]) * bs.inverse_powers(len(data))[first] + (after - first).astype(np.uint64))
        many = max(0, len(word) - WORDS + 1)
        shingle = np.full(many, WORDS, np.uint64) * _PLACE[WORDS]
        for j in range(WORDS):
            shingle += word[j : j + many] * _PLACE[j]
        shingle = bs.mixed(shingle)
        chain = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * bs.powers(len(word)), out=chain[1:])
        other = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(bs.mixed(word) * bs.powers(len(word)), out=other[1:])
        upto = np.searchsorted(first, ends)
        begins, stops = upto[:-1], upto[1:]
        back = bs.inverse_powers(len(word) + 1)[begins]
        one = bs.mixed((chain[stops] - chain[begins]) * back + (stops - begins).astype(np.uint64)).view(np.int64)
        two = bs.mixed((other[stops] - other[begins]) * back).view(np.int64)
        for row in range(len(ends) - 1):
            a, b = int(upto[row]), int(upto[row + 1])
            if a == b:
                continue
            if b - a < WORDS:
                own = (word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
                found = bs.mixed(own + _PLACE[WORDS:] * np.uint64(b - a))
            else:
                found = np.unique(shingle[a : b - WORDS + 1])
            yield begin + row, found, (int(one[row]), int(two[row]))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[None, at : at + 4096]
        least = np.minimum(least, ((part ^ _SALT[:, None]) * _MULT[:, None]).min(axis=1))
    return (bs.mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        count, d1, d2, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        for row, found, digest in shingle_sets(b.column("text")):
            count[row], (d1[row], d2[row]), sig[row] = len(found), digest, signature(found).tobytes()
        cols = [b.column("doc_id"), b.column("doc"), pa.array(count), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "doc", "n_shingles", "d1", "d2", "sig"])


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """The keys of each signature (a row): for every chunk, each with one of its values left out."""
    values = sigs.astype(np.uint64).reshape(len(sigs), HASHES // CHUNK, CHUNK)
    out = np.empty((len(sigs), HASHES // CHUNK, CHUNK), np.uint64)
    for left in range(CHUNK):
        key = np.zeros(values.shape[:2], np.uint64)
        for at in range(CHUNK):
            key = key << np.uint64(16) | (np.uint64(0) if at == left else values[:, :, at])
        chunk = np.arange(HASHES // CHUNK, dtype=np.uint64)[None, :]
        out[:, :, left] = bs.mixed(bs.mixed(key) + (chunk * np.uint64(CHUNK) + np.uint64(left + 1)) * np.uint64(bs.BASE))
    return out.reshape(len(sigs), -1).view(np.int64)


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            keys = chunk_keys(sigs)
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b.column("node").to_pylist()
        rows = [(node[row], found.tobytes()) for row, found, _ in shingle_sets(b.column("text"))]
        cols = list(zip(*rows, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["node", "shingles"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    total = np.zeros((n, n), np.float64)
    wide = 8192
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + wide) if len(column) else 0, wide))
    for a, b in zip(cuts, np.append(cuts[1:], len(column)), strict=True):
        if b > a:
            dense = np.zeros((n, wide), np.float32)
            dense[owner[a:b], column[a:b] % wide] = 1
            total += dense @ dense.T
    return np.rint(total).astype(np.int64)


def forest(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect just what links between nodes of different blocks (of one block, if there is one) connect."""
    shared, sizes = shared_counts(sets), np.array([len(x) for x in sets])
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if len(set(blocks.tolist())) > 1:
        linked &= blocks[:, None] != blocks[None, :]
    out, open_nodes = [], np.ones(len(nodes), bool)
    for root in range(len(nodes)):
        if open_nodes[root]:
            open_nodes[root] = False
            front = np.array([root])
            while len(front):
                new = linked[front].any(axis=0) & open_nodes
                open_nodes &= ~new
                front = np.flatnonzero(new)
                out += [(int(nodes[root]), int(nodes[x])) for x in front]
    return out


def _confirm(percent: int):
    """The links of a task's nodes, as a forest: all, or, if there are two blocks, those between the blocks."""

    def run(task: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in task.column("shingles").to_pylist()]
        found = forest(task.column("node").to_numpy(), task.column("block").to_numpy(), sets, percent)
        cols = list(zip(*found, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def _first_look(percent: int):
    """(hub, led, a, b): of a group that meets whole, its links as a forest; of a block of a larger one, where some rows
    are leaders, the links between each leader and each node."""

    def run(task: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in task.column("shingles").to_pylist()]
        nodes, leads = task.column("node").to_numpy(), task.column("leads").to_numpy(zero_copy_only=False)
        led = bool(leads.any())
        if led:
            shared, sizes = shared_counts(sets), np.array([len(x) for x in sets])
            linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
            i, j = np.nonzero(linked[leads][:, ~leads])
            found = np.column_stack([nodes[leads][i], nodes[~leads][j]])
        else:
            found = np.array(forest(nodes, np.zeros(len(nodes)), sets, percent), np.int64).reshape(-1, 2)
        hub = np.full(len(found), task.column("hub")[0].as_py(), np.int64)
        return pa.table({"hub": pa.array(hub), "led": pa.array(np.full(len(found), led)), "a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def linked_nodes(stars: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect just the nodes that links within the groups (hub, node) connect. sets: (node, shingles)."""
    # Groups of more than `block` nodes are at most one for so many rows.
    sizes = stars.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sizes = small(saved(sizes.select("hub", F.ceil(F.col("n") / block).cast("int").alias("blocks"))))
    stars = stars.join(sizes, "hub", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.lit(0)))
    stars = saved(stars)
    large = stars.where("blocks is not null")
    drawn = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(LEADERS)]
    leads = large.groupBy("hub", "blocks").agg(F.array_distinct(F.array(*drawn)).alias("leads")).select("hub", "blocks", F.explode("leads").alias("node"))
    led = leads.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(True).alias("leads"))
    tasks = stars.select("hub", "block", "node", F.lit(False).alias("leads")).union(led).join(sets, "node")
    found = saved(tasks.groupBy("hub", "block").applyInArrow(_first_look(percent), "hub long, led boolean, a long, b long"))
    edges, links = found.where("a <> b").select("a", "b"), found.where("led").select("hub", F.col("a").alias("leader"), F.col("b").alias("node"))
    if links.isEmpty():
        return edges
    most = links.groupBy("hub", "leader").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("leader", F.struct("n", "leader")).alias("root"))
    # A leader counts if it is linked to the root; the root is linked to itself.
    good = links.join(small(saved(most)), "hub").where("leader = root").select("hub", F.col("node").alias("leader"))
    good = small(saved(good.join(small(saved(leads.select("hub", F.col("node").alias("leader")))), ["hub", "leader"], "left_semi").distinct()))
    done = links.join(good, ["hub", "leader"], "left_semi").select("hub", "node").distinct()
    rest = saved(large.join(done, ["hub", "node"], "left_anti").select("hub", "node", "blocks"))
    if rest.isEmpty():
        return edges
    # The nodes left over, in blocks of their own, against each other and against every block of their group.
    parts = small(saved(rest.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))))
    rest = rest.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node", F.lit("rest")), "parts").cast("int"))
    every = large.join(parts, "hub").join(rest.select("hub", "node", "part"), ["hub", "node"], "left_anti")
    against = every.select("hub", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("block"), "node")
    own = rest.select("hub", F.lit(0).alias("kind"), F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("block"), "node")
    pairs = rest.select("hub", "part", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = pairs.select("hub", F.lit(1).alias("kind"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part").alias("block"), "node")
    tasks = against.union(own).union(pairs).join(sets, "node")
    return edges.union(tasks.groupBy("hub", "kind", "i", "j").applyInArrow(_confirm(percent), "a long, b long"))


def groups(docs: DataFrame, percent: int = 85, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, doc (128 bits of key and text), n_shingles, component_id and kept of every row of docs."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), fingerprint(key, "text").alias("doc"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = saved(rows.mapInArrow(_sign, f"doc_id {kind}, doc binary, n_shingles long, d1 long, d2 long, sig binary"))
    full = signed.where("n_shingles > 0")
    nodes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.first("doc").alias("doc"), F.first("sig").alias("sig"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))
    entered = nodes.select("node", "sig").mapInArrow(_enter, "key long, node long")
    hubs = entered.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    # Hubs grow with the corpus: by a shuffle at every size, which adaptive execution splits where a key is hot.
    stars = saved(entered.join(hubs.select("key", "hub").hint("merge"), "key").select("hub", "node").distinct())
    wanted = nodes.join(stars.select("node").distinct(), "node").select("doc", "node")
    texts = rows.select("doc", "text").join(small(saved(wanted)), "doc").dropDuplicates(["node"])
    sets = saved(texts.select("node", "text").mapInArrow(_sets, "node long, shingles binary"))
    group = components(linked_nodes(stars, sets, percent, block))
    joined = nodes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = joined_apart(joined, lowest, "component").select("d1", "d2", "component_id", F.col("component").alias("group"), F.lit(1).alias("words"))
    out = signed.withColumn("words", F.when(F.col("n_shingles") > 0, 1)).join(known, ["d1", "d2", "words"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "doc", "n_shingles", "component_id", kept, "group")


def deduplicated(docs: DataFrame, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, but of each group only the one with the smallest (key, fingerprint); all rows without
    words. Rows that agree in key and text are one."""
    found = saved(groups(docs, percent, key).where("group is not null").select("doc_id", "doc", "group"))
    best = found.groupBy("group").agg(F.min(F.struct("doc_id", "doc")).alias("best")).select(F.col("best.doc").alias("_doc"), F.lit(True).alias("stays"))
    marked = found.groupBy(F.col("doc").alias("_doc")).agg(F.count("*").alias("n")).join(best, "_doc", "left")
    marked = saved(marked.withColumn("stays", F.coalesce("stays", F.lit(False))))
    rows = packed(docs, key)
    once = rows.join(small(marked.where("not stays or n > 1").select("_doc")), "_doc", "left_anti")
    more = rows.join(small(marked.where("stays and n > 1").select("_doc")), "_doc", "left_semi").dropDuplicates(["_doc"])
    return once.unionByName(more).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
