"""Operator 12, Merkle dataset manifest: trees of sha256 by source, and a proof for every row by fractal traversal.

1. A row's leaf is hashed where it is read. Leaves are dealt by ranges of (source, id), and the ranges' counts give each
   leaf its place in its source: no source needs one task.
2. BLOCK = 16**3 consecutive leaves of a source are an aligned block. Blocks' roots climb, level by level, by one
   aggregation of at most 16 digests each, to the source's subroot; the subroots climb the same way to the root. Then each
   level hands its runs down, so that every block has its upper proof.
3. A block's leaves are walked in order by fractal traversal (Jakobsson, Leighton, Micali, Szydlo). The stack holds, for
   every level, the run that covers the leaf (existing) and the next one (desired), which grows by a leaf a step, so that
   it is whole when the walk gets there: 2 runs a level and what is being hashed, whatever the block holds. Every step
   gives the leaf's siblings; the block's upper proof is appended, and the path is folded to the root again.

Edge cases: a null in any column is `-`; a null id comes first and is not tampered with; rows of one id come by their
leaves, and rows that agree in all are leaves of their own; a run of one is hashed, and has no siblings; a source of one
row is its own subroot; one source's subroot is the root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.llm.common import saved, ship, small, table

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(parts: list[str]) -> str:
    """The digest of a node: of its children's digests, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, fan: int = FAN) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


class Grown:
    """Nodes of one level, made from leaves that come one by one: what is open at each level below, fewer than fan digests."""

    def __init__(self, level: int, fan: int):
        self.level, self.fan, self.open = level, fan, [[] for _ in range(level + 1)]

    def take(self, leaf: str, last: bool) -> None:
        """The next leaf; last: no more come, so that runs that are not full close."""
        self.open[0].append(leaf)
        for k in range(self.level):
            if self.open[k] and (len(self.open[k]) == self.fan or last):
                self.open[k + 1].append(joined(self.open[k]))
                self.open[k] = []

    def run(self) -> list[str]:
        return self.open[self.level]


def traversed(leaves: list[str], levels: int, fan: int = FAN) -> Iterator[list[tuple[list[str], int]]]:
    """For every leaf in order, (run, place in it) at each of the levels under the leaves' root."""
    n = len(leaves)
    # To begin with, the first run of each level is made from its leaves.
    existing: list[list[str]] = []
    for level in range(levels):
        first = Grown(level, fan)
        for i in range(min(n, fan ** (level + 1))):
            first.take(leaves[i], i == n - 1)
        existing.append(first.run())
    desired = [Grown(level, fan) for level in range(levels)]
    for i in range(n):
        for level in range(levels):
            wide = fan ** (level + 1)
            if i and i % wide == 0:
                existing[level], desired[level] = desired[level].run(), Grown(level, fan)
            at = (i // wide + 1) * wide + i % wide
            if at < n:
                desired[level].take(leaves[at], at == n - 1)
        yield [(existing[level], i // fan**level % fan) for level in range(levels)]


def parted(run: list[str], at: int) -> tuple[str, str]:
    """The siblings before and after a place in a run."""
    return "".join(run[:at]), "".join(run[at + 1 :])


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf leads to with its siblings."""
    for before, after in path:
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, tree, leaf, changed): the first field is the id, the second the source, the last the text; changed: the leaf of
    a row that has been tampered with. tree sorts as the source does, null first."""
    cols = [F.col(f"`{c}`") for c in fields]
    capitals, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    tampered = F.coalesce(F.crc32(cols[0].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(tampered, leaf_of([*cols[:-1], F.translate(cols[-1], capitals, lower)]))
    tree = F.coalesce(F.concat(F.lit("="), cols[1].cast("string")), F.lit(""))
    return docs.select(cols[0].alias("id"), tree.alias("tree"), leaf_of(cols).alias("leaf"), changed.alias("changed"))


def ranged(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, dealt by ranges of (group, order) and numbered within each (group, _range) in _rank; and (group, _range, n,
    start): a range's rows of a group, and those in ranges before it. Rows that agree in all are told apart by where they
    were read, so that ranges can part them."""
    rows = saved(rows.withColumn("_read", F.monotonically_increasing_id()))
    by = [F.col(c).asc_nulls_first() for c in [*order, "_read"]]
    dealt = saved(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], *by).withColumn("_range", F.spark_partition_id()))
    counts = saved(dealt.groupBy(*group, "_range").agg(F.count("*").alias("n")))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*by)) - 1
    return dealt.withColumn("_rank", rank).drop("_read"), starts


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, place, digest), places from 0 in each tree: (tree, digest) of the roots, and (tree, place, upper) of all
    nodes, with the runs that cover a node, up to its root, and its places in them. A level is one aggregation."""
    kind = "array<struct<run: array<string>, at: int>>"
    levels, roots, now = [], [], nodes
    while True:
        alone = now.groupBy("tree").agg(F.count("*").alias("n"), F.first("digest").alias("digest"))
        roots.append(saved(alone.where("n = 1").drop("n")))
        more = now.join(roots[-1].select("tree"), "tree", "left_anti")
        run = F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"]
        runs = saved(more.groupBy("tree", F.floor(F.col("place") / FAN).alias("above")).agg(run.alias("run")))
        if runs.isEmpty():
            break
        levels.append(runs)
        now = runs.select("tree", F.col("above").alias("place"), F.sha2(F.concat_ws("", "run"), 256).alias("digest"))
    ends = [r.select("tree", F.lit(0).cast("long").alias("place"), F.array().cast(kind).alias("upper")) for r in roots]
    known = ends[-1]
    for runs, end in zip(reversed(levels), reversed(ends[:-1]), strict=True):
        below = runs.join(known.withColumnRenamed("place", "above"), ["tree", "above"])
        below = below.select("tree", "above", "run", "upper", F.posexplode("run").alias("at", "_digest"))
        upper = F.concat(F.array(F.struct("run", F.col("at").alias("at"))).cast(kind), "upper")
        known = saved(below.select("tree", (F.col("above") * FAN + F.col("at")).alias("place"), upper.alias("upper")).union(end))
    root = roots[0]
    for r in roots[1:]:
        root = root.union(r)
    return root, known


def _block_root(block: pa.Table) -> pa.Table:
    block = block.sort_by("at")
    levels, digests = block.column("levels")[0].as_py(), block.column("leaf").to_pylist()
    grown = Grown(levels, FAN)
    for i, leaf in enumerate(digests):
        grown.take(leaf, i == len(digests) - 1)
    return pa.table({"tree": block.column("tree")[:1], "place": block.column("block")[:1], "digest": pa.array(grown.run(), pa.string())})


def _prove(block: pa.Table, known: pa.Table) -> pa.Table:
    """Every row of a block with its proof, and the root its leaf, or what tampering has made of it, leads to."""
    block, known = block.sort_by("at"), known.to_pylist()[0]
    digests, changed = block.column("leaf").to_pylist(), block.column("changed").to_pylist()
    upper = [parted(x["run"], x["at"]) for x in known["upper"]]
    upper_text = "".join(a + b for a, b in upper)
    proofs, ends = [], []
    for leaf, other, path in zip(digests, changed, traversed(digests, block.column("levels")[0].as_py()), strict=True):
        own = [parted(run, at) for run, at in path]
        proofs.append(sha256(("".join(a + b for a, b in own) + upper_text).encode()).hexdigest())
        ends.append(folded(other or leaf, own + upper))
    subroots = pa.array([known["subroot"]] * len(digests), pa.string())
    cols = [block.column("id"), block.column("leaf"), subroots, pa.array(proofs, pa.string()), pa.array(ends, pa.string())]
    return pa.table(cols, names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs."""
    ship(docs.sparkSession)
    dealt, starts = ranged(leaves(docs, fields), ["tree"], ["id", "leaf"])
    sources, firsts = ranged(starts.groupBy("tree").agg(F.sum("n").alias("total")), [], ["tree"])
    numbers = sources.join(small(saved(firsts.select("_range", "start"))), "_range")
    levels = F.when(F.col("total") > BLOCK, LEVELS)
    for k in range(LEVELS, -1, -1):
        levels = levels.when(F.col("total") > FAN**k // FAN, k)
    numbers = saved(numbers.select("tree", (F.col("start") + F.col("_rank")).alias("number"), levels.alias("levels")))
    starts = small(saved(starts.select("tree", "_range", "start").join(numbers, "tree")))
    place = F.col("start") + F.col("_rank")
    rows = dealt.join(starts, ["tree", "_range"])
    rows = saved(rows.select("id", "leaf", "changed", F.col("number").alias("tree"), "levels", F.floor(place / BLOCK).alias("block"), (place % BLOCK).alias("at")))
    blocks = saved(rows.groupBy("tree", "block").applyInArrow(_block_root, "tree long, place long, digest string"))
    subroots, uppers = climbed(blocks)
    subroots = saved(subroots)
    root, top = climbed(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), "digest"))
    root = root.first()
    top = top.select(F.col("place").alias("tree"), F.col("upper").alias("top"))
    known = uppers.join(small(saved(top.join(subroots.withColumnRenamed("digest", "subroot"), "tree"))), "tree")
    known = saved(known.select("tree", F.col("place").alias("block"), "subroot", F.concat("upper", "top").alias("upper")))
    kind = rows.schema["id"].dataType.simpleString()
    proved = rows.groupBy("tree", "block").cogroup(known.groupBy("tree", "block"))
    out = proved.applyInArrow(_prove, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(root["digest"] if root else None).cast("string")
    return out.select("id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
