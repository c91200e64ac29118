"""Operator 8, exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are dealt to blocks, a block to a task; all queries stream past it in batches. The block's index, built once,
puts each posting (a row's value in a component) in a segment by its quantised impact: the value times what the component
weighs in the block. Segments are processed by descending impact, in rounds; a round adds its segments to the scores of a
whole batch of queries by one product of matrices. A row's upper bound is what it has so far plus the most that its open
postings can add, by the norm of their impacts. The exact scores of rows that lead so far give a threshold that the k-th
best cannot fall below. When the bounds leave a query few possible members, the rest of its postings are skipped, and
those rows are rescored exactly, in whole numbers. Of equal vectors a block's index holds the first k + 1: the others can't
be among the k best. The blocks' bests are merged by a ranked window of k rows a block.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; components whose scores might not
fit 64 bits raise ValueError (at 64 components, those over about a million); a row without an id is a
candidate, the last of equals, and never a query; shorter vectors count as padded with zeros; rows with the same id are
rows of their own, and a query's own row is left out alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.llm.common import saved, ship, table

#: Rows of a block, as long as there are at most MANY blocks, and the most; wider vectors than WIDE make blocks shorter.
BLOCK, MANY, GROWN, WIDE = 16_384, 64, 8, 64
#: Segments are this part of the root mean square impact, up to the last one; the part of the squared impacts that is open
#: after each round; the part of a block that is few enough for exact scores.
LEVEL, LEVELS, OPEN, FEW = 1 / 32, 256, (1 / 128, 1 / 2048, 0.0), 1 / 32
#: Scores that a batch of queries holds at once, and values of rows that are rescored at once.
HELD, RESCORED = 1 << 22, 1 << 20


class ImpactIndex:
    """Postings of a block of integer vectors (rows by components), in segments of equal quantised impact, by rounds."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, (rows, dims) = vectors, vectors.shape
        weight = np.array([np.sqrt(np.mean(np.square(vectors[:, d], dtype=np.float64))) if rows else 0.0 for d in range(dims)])
        #: A component without values adds nothing to any score.
        self.share = np.divide(1.0, weight, out=np.zeros(dims), where=weight > 0)
        unit = LEVEL * float(np.sqrt(np.mean(weight**4))) if dims else 0.0
        level, squares, whole = np.zeros((rows, dims), np.uint8), np.zeros(LEVELS), np.zeros(rows)
        for d in range(dims):
            impact = np.abs(vectors[:, d].astype(np.float64)) * weight[d]
            level[:, d] = np.minimum(impact / unit, LEVELS - 1) if unit else 0
            squares += np.bincount(level[:, d], impact * impact, LEVELS)
            whole += impact * impact
        below = np.cumsum(squares)
        cuts = [int(np.searchsorted(below, part * below[-1], side="right")) if part else 0 for part in OPEN]
        self.rounds, high, open_before = [], LEVELS, np.zeros(rows)
        for low in cuts:
            part, left = np.zeros((dims + 1, rows), np.float32), np.zeros(rows)
            for d in range(dims):
                now = (level[:, d] >= low) & (level[:, d] < high)
                part[d, now] = vectors[now, d]
                left += np.where(level[:, d] < low, vectors[:, d] * weight[d], 0.0) ** 2
            left = np.sqrt(left)
            # The last line turns the bound of what was open before into that of what is open now.
            part[dims] = left - open_before
            self.rounds.append(part)
            high, open_before = low, left
        self.room = (np.empty(0, np.float32), np.empty(0, bool))
        self.reach = float(np.sqrt(whole.max(initial=0.0)))

    def scores(self, queries: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a query and a row."""
        out, step = np.zeros(len(q), np.int64), max(1, RESCORED // max(1, queries.shape[1]))
        for low in range(0, len(q), step):
            at = slice(low, low + step)
            out[at] = np.einsum("pd,pd->p", self.vectors[rows[at]].astype(np.int64), queries[q[at]])
        return out

    def _threshold(self, upper: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """For each query the k-th best exact score of 2k rows that lead: those with the highest bounds of their stretch."""
        n, rows = upper.shape
        stretches = min(rows, 32 * k)
        by = upper[:, : rows // stretches * stretches].reshape(n, stretches, -1)
        best = by.max(axis=2)
        lead = np.argpartition(-best, 2 * k, axis=1)[:, : 2 * k]
        at = lead * by.shape[2] + by[np.arange(n)[:, None], lead].argmax(axis=2)
        score = self.scores(queries, np.repeat(np.arange(n), 2 * k), at.ravel()).reshape(n, 2 * k)
        score[at == own[:, None]] = np.iinfo(np.int64).min
        return np.sort(score, axis=1)[:, k]

    def pairs(self, queries: np.ndarray, k: int, own: np.ndarray, few: float = FEW) -> tuple[np.ndarray, np.ndarray]:
        """(query, row), ascending: the rows that can be among the k best for each query. own: a row that cannot, or -1;
        few: the part of rows at which exact scores of all that are left cost less than more segments."""
        (rows, dims), n = self.vectors.shape, len(queries)
        if rows <= 4 * k:
            q, row = np.divmod(np.arange(n * rows), rows)
            other = row != own[q]
            return q[other], row[other]
        norm = np.sqrt(np.square(queries * self.share).sum(axis=1))
        asked = np.column_stack([queries * (self.share > 0), norm]).astype(np.float32)
        # Single precision: each value, product and sum of the rounds is off by 2**-24 of what they add up to at most.
        slack = 1 + 4 * (len(self.rounds) * (dims + 1) + 16) * 2.0**-24 * norm * self.reach
        todo, mine = np.arange(n), np.flatnonzero(own >= 0)
        # The same memory for all batches: fresh pages cost more than the sums.
        if self.room[0].size < n * rows:
            self.room = (np.empty(n * rows, np.float32), np.empty(n * rows, bool))
        upper, kept = (x[: n * rows].reshape(n, rows) for x in self.room)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, part in enumerate(self.rounds):
            if i == 0:
                np.matmul(asked, part, out=upper)
                upper[mine, own[mine]] = -np.inf
            else:
                upper += asked[todo] @ part
            least = self._threshold(upper, queries[todo], k, own[todo]) - slack[todo]
            np.greater_equal(upper, np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None], out=kept[: len(todo)])
            q, row = np.divmod(np.flatnonzero(kept[: len(todo)]), rows)
            settled = np.bincount(q, minlength=len(todo)) <= max(few * rows, 4 * k)
            if i == len(self.rounds) - 1:
                settled[:] = True
            found.append((todo[q[settled[q]]], row[settled[q]]))
            if settled.all():
                break
            todo, upper = todo[~settled], upper[~settled]
        q, row = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(q, kind="stable")
        return q[order], row[order]

    def possible(self, query: np.ndarray, k: int, own: int, few: float = FEW) -> np.ndarray:
        """The rows that can be among the k best for one query."""
        return self.pairs(query[None, :], k, np.array([own]), few)[1]

    def best(self, queries: np.ndarray, k: int, own: np.ndarray, few: float = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best for each query, the first row of equals."""
        step, out = max(1, HELD // max(1, len(self.vectors))), []
        for low in range(0, len(queries), step):
            some = queries[low : low + step]
            q, row = self.pairs(some, k, own[low : low + step], few)
            score = self.scores(some, q, row)
            order = np.lexsort((-score, q))
            q, row, score = q[order], row[order], score[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((q[top] + low, row[top], score[top]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dims), lists.type.value_type.to_pandas_dtype())
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _first(matrix: np.ndarray, n: int) -> np.ndarray:
    """The first n of equal rows, ascending. With one more than k, the others have k rows before them besides a query's own."""
    _, kind = np.unique(matrix.view(f"V{matrix.shape[1] * matrix.itemsize}").ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    return np.sort(order[np.arange(len(order)) - np.searchsorted(kind[order], kind[order]) < n])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(block, asks, rows): each batch, cut where the block or the kind of row changes."""
    for b in batches:
        if b.num_rows:
            block, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (asks[1:] != asks[:-1])) + 1, [len(block)]])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield int(block[low]), bool(asks[low]), b.slice(low, high - low)


def _search(k: int, few: float):
    """The k best of a block for each query. Batches come sorted: a block's own rows, then the queries that stream past."""
    kinds = {"query": pa.int64(), "query_id": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def best(held: pa.Table, index: ImpactIndex, asked: pa.RecordBatch) -> pa.RecordBatch:
        names, ids = held.column("row").to_numpy(), held.column("vec_id").combine_chunks()
        place = {x: i for i, x in enumerate(names.tolist())}
        dims = index.vectors.shape[1]
        wide = max(dims, int(asked.column("v").value_lengths().to_numpy().max()))
        queries = _matrix(asked.column("v"), wide)[:, :dims].astype(np.int64)  # components that no row has add nothing
        own = np.array([place.get(x, -1) for x in asked.column("row").to_pylist()])
        q, row, score = index.best(queries, k, own, few)
        found = (asked.column("row").take(pa.array(q)), asked.column("vec_id").take(pa.array(q)), pa.array(names[row]), ids.take(pa.array(row)), pa.array(score))
        return pa.RecordBatch.from_arrays([v.cast(kinds[c]) for c, v in zip(kinds, found, strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, index = -1, [], None, None
        for block, asks, piece in _pieces(batches):
            if block != at:
                at, parts, index = block, [], None
            if not asks:
                parts.append(piece)
            elif parts:
                if index is None:
                    # In the order of equals: by id, those without one last.
                    held = pa.Table.from_batches(parts).sort_by([("vec_id", "ascending"), ("row", "ascending")])
                    lists = held.column("v").combine_chunks()
                    matrix = _matrix(lists, max(1, int(lists.value_lengths().to_numpy().max())))
                    first = _first(matrix, k + 1)
                    held, index = held.take(pa.array(first)), ImpactIndex(matrix[first])
                yield best(held, index, piece)

    return run


def _blocks(n: int, wide: int, block: int) -> int:
    """How many blocks n rows make: more and more of them up to MANY, then larger ones, so that queries are copied less."""
    most = max(1, block * WIDE // max(WIDE, wide))
    return max(1, -(-n // (GROWN * most)), min(MANY, -(-n // most)))


def search(vectors: DataFrame, asked: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, few: float = FEW) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row for which the SQL condition `asked` holds."""
    ship(vectors.sparkSession)
    fit = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    asks = F.expr(asked) & F.col(key).isNotNull()
    rows = vectors.where(fit).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    n, most, wide = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.max(F.size("v"))).first()
    if most and most * most * wide >= 2.0**62:
        raise ValueError(f"scores of components up to {most / 256:g} do not fit 64 bits")
    width = next((x for x, bits in (("smallint", 15), ("int", 31)) if (most or 0) < 2**bits), "bigint")
    rows = rows.withColumn("v", F.col("v").cast(f"array<{width}>"))
    blocks = _blocks(n, wide or 0, block)
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "v")
    past = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "asks", "row", "vec_id", "v")
    dealt = held.union(past).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_search(k, few), "query long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
