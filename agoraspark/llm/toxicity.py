"""Operator 5, toxicity by class-conditional Kneser-Ney models.

Two byte models, of toxic and of ordinary labelled texts, share their backoff: a byte after its context of ORDER - 1
bytes has in class k the probability (count_k - D)+ / context_k + D * types_k / context_k * shared, and `shared` is the
interpolated Kneser-Ney probability of all lower orders, from the continuation counts of both classes together. So an
expression that one class has hardly seen falls back to what both share, and only real differences give a
log-likelihood ratio. A text's ratios are normalised by length: over the whole text, over its words and over the
stretches that stand out most. A logistic curve turns these into a score; it is fitted on about FIT_ROWS labelled rows at most,
each measured by models that have not seen its own half of the labels.

Counts come from all labelled training texts, in Spark, by the exact string with partial sums. All distinct strings are
gathered and broadcast, so the table grows with the corpus; it has up to 24 bytes a string.

Edge cases: null and empty texts, and an empty label table, score by the curve's value for no evidence; repeated labels
of a document count each; rows with a null label or doc_id are not learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm import bytesets as bs
from agoraspark.llm.common import ship, small, table

ORDER = 4
FIT_ROWS = 20_000
THRESHOLD = 0.3
DISCOUNT = 0.75
#: Words below this mean ratio a byte are no evidence.
FLOOR = 0.25
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[*range(0x09, 0x0E)]] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """For each position, its byte and the 3 before it, as a number."""
    low = _LOWER[data]
    code = low.copy()
    for j in range(1, ORDER):
        code[j:] |= low[:-j] << np.uint32(8 * j)
    return code


def hashed(code: np.ndarray) -> np.ndarray:
    """One to one: different codes have different hashes."""
    return code.astype(np.uint32, copy=False) * np.uint32(0x9E3779B1)


def _broken(ends: np.ndarray, n: int) -> np.ndarray:
    """The positions whose gram does not lie within one row."""
    at = (ends[:-1, None] + np.arange(ORDER - 1)[None, :]).ravel()
    return at[at < n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        side = b.column("side").to_numpy(zero_copy_only=False)
        for begin, data, ends in bs.text_groups(b.column("text")):
            code = grams(data)
            of = np.repeat(side[begin : begin + len(ends) - 1], np.diff(ends))
            of[_broken(ends, len(data))] = -1
            for s in range(4):
                found, n = np.unique(code[of == s], return_counts=True)
                counts = [pa.array(n if k == s else np.zeros_like(n)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *counts], ["code", "n0", "n1", "n2", "n3"])


def _grouped(names: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The place of each row among the distinct names, then the sums of values by name."""
    _, place = np.unique(names, return_inverse=True)
    return place, *(np.bincount(place, v) for v in values)


def shared_backoff(codes: np.ndarray, order: int) -> np.ndarray:
    """Of each gram, the probability of its last byte after the order - 2 before it, from continuation counts."""
    if order <= 1:
        return np.full(len(codes), 1 / 256)
    short = codes & np.uint32((1 << (8 * (order - 1))) - 1)
    kinds, place, follows = np.unique(short, return_inverse=True, return_counts=True)
    lower = shared_backoff(kinds, order - 1)
    context, total, types = _grouped(kinds >> np.uint32(8), follows, np.ones(len(kinds)))
    p = (np.maximum(follows - DISCOUNT, 0) + DISCOUNT * types[context] * lower) / total[context]
    return p[place]


def ratios(codes: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each gram. Both classes back off to the Kneser-Ney model of both together, so that a
    gram met once or twice says little, and one that neither has met says nothing."""
    _, place = np.unique(codes >> np.uint32(8), return_inverse=True)

    def smoothed(n: np.ndarray, base: np.ndarray) -> np.ndarray:
        total, types = np.bincount(place, n), np.bincount(place, n > 0)
        left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        return np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[place] + left[place] * base

    shared = smoothed(toxic + plain, shared_backoff(codes, ORDER))
    return np.log(smoothed(toxic, shared)) - np.log(smoothed(plain, shared))


def lookup_tables(codes: np.ndarray, *values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of values (one a code): the hashes of all codes in order, their values, and where each slot of hashes
    begins; 2 slots a code or more. The tables share all but the values."""
    h = hashed(codes)
    order = np.argsort(h)
    h = h[order]
    bits = min(32, max(10, int(2 * len(codes)).bit_length()))
    begins = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.int32)
    # Behind the last: no slot's first code, so that every place that begins names can be read.
    h = np.append(h, np.uint32(0))
    return [(h, np.append(v[order], 0).astype(np.float32), begins) for v in values]


def lookup_table(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return lookup_tables(codes, values)[0]


def looked_up(codes: np.ndarray, model: tuple) -> np.ndarray:
    """The value of each code; 0 of a code that the table does not hold."""
    held, values, begins = model
    h, last = hashed(codes), len(held) - 1
    out = np.zeros(len(h), np.float32)
    shift = np.uint32(33 - len(begins).bit_length())
    at, open_ = begins[h >> shift], np.arange(len(h))
    # Codes of a slot lie in order: go on while the one that is there is less.
    while len(open_):
        there = held[at]
        hit = (there == h) & (at < last)
        out[open_[hit]] = values[at[hit]]
        on = (there < h) & (at < last)
        h, at, open_ = h[on], at[on] + 1, open_[on]
    return out


def measured(data: np.ndarray, ends: np.ndarray, model: tuple) -> np.ndarray:
    """For each row: the mean ratio of its bytes, the means of its 1, 3 and 8 most toxic words, and log length."""
    out = np.zeros((len(ends) - 1, 5))
    if not len(data):
        return out
    value = looked_up(grams(data), model)
    value[_broken(ends, len(data))] = 0
    sums = np.zeros(len(data) + 1)
    np.cumsum(value, dtype=np.float64, out=sums[1:])
    size = np.maximum(np.diff(ends), 1)
    out[:, 0] = (sums[ends[1:]] - sums[ends[:-1]]) / size
    out[:, 4] = np.log(size)
    gap = _LOWER[data] == 32
    gap[ends[:-1][ends[:-1] < len(data)]] = True
    cuts = np.append(np.flatnonzero(gap), len(data))
    word = np.diff(sums[cuts]) / np.maximum(np.diff(cuts), ORDER)
    strong = np.flatnonzero(word > FLOOR)
    row = np.searchsorted(ends, cuts[strong], "right") - 1
    order = np.lexsort((-word[strong], row))
    word, row = word[strong][order], row[order]
    first = np.searchsorted(row, np.arange(len(ends) - 1))
    count = np.diff(np.append(first, len(row)))
    total = np.concatenate([[0], np.cumsum(word)])
    for k, top in ((1, 1), (2, 3), (3, 8)):
        out[:, k] = (total[first + np.minimum(count, top)] - total[first]) / top
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, evidence: int = 4) -> tuple[np.ndarray, ...]:
    """(mean, scale, weights with the intercept last, least and largest x), by Newton steps with a small ridge. More of the
    first `evidence` columns never lowers a score: one whose weight would be negative is left out, the worst first."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    used = np.ones(z.shape[1], bool)
    while True:
        w, part = np.zeros(used.sum()), z[:, used]
        penalty = np.append(np.full(len(w) - 1, 1.0), 1e-3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p) + 1e-9)[:, None]).T @ part + np.diag(penalty), part.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        every = np.zeros(z.shape[1])
        every[used] = w
        if every[:evidence].min() >= 0:
            return mean, scale, every, x.min(axis=0), x.max(axis=0)
        used[every[:evidence].argmin()] = False


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, side, pick) of the labelled texts to learn from; side: 2 * toxic + a half given by the text; pick: a hash."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    own = labels.where("toxic in (0, 1) and doc_id is not null").where(part != 2).select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    return docs.select("doc_id", "text").join(small(own), "doc_id").select("text", (2 * F.col("toxic") + half).alias("side"), F.xxhash64("doc_id", "text").alias("pick"))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The models and the curve, learned from all labelled training rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = training(docs, labels)
    counted = rows.mapInArrow(_count, "code long, n0 long, n1 long, n2 long, n3 long")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]
    held = counted.groupBy("code").agg(*sums).toArrow().sort_by("code")
    codes = held["code"].to_numpy().astype(np.uint32)
    n = np.column_stack([held[f"n{k}"].to_numpy().astype(np.float64) for k in range(4)])

    def model(*choices: tuple[int, ...]) -> list[tuple]:
        """A model for each choice of halves."""
        sums = [(sum(n[:, 2 + h] for h in halves), sum(n[:, h] for h in halves)) for halves in choices]
        return lookup_tables(codes, *(ratios(codes, toxic, plain) for toxic, plain in sums))

    if not len(codes) or not n[:, :2].sum() or not n[:, 2:].sum():
        return {"model": None, "curve": None, "prior": float(n[:, 2:].sum() > 0)}
    other = spark.sparkContext.broadcast(model((1,), (0,)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = b.column("side").to_numpy(zero_copy_only=False)
            for begin, data, ends in bs.text_groups(b.column("text")):
                own = side[begin : begin + len(ends) - 1]
                two = [measured(data, ends, m) for m in other.value]
                x = np.where((own % 2 == 0)[:, None], two[0], two[1])
                yield pa.RecordBatch.from_arrays([pa.array(own // 2), *(pa.array(c) for c in x.T)], ["y", *"abcde"])

    # By a threshold of a hash, where the rows are: no task gathers texts to draw from.
    part = min(1.0, FIT_ROWS / max(1, rows.select("pick").count()))
    sample = rows.where(F.pmod("pick", F.lit(1 << 30)) < int(part * (1 << 30)))
    seen = sample.mapInArrow(measure, "y long, a double, b double, c double, d double, e double").toPandas()
    other.unpersist()
    curve = fit_logistic(seen[list("abcde")].to_numpy(), seen["y"].to_numpy(np.float64))
    return {"model": model((0, 1))[0], "curve": curve, "prior": 0.0}


def scores(texts: pa.Array, known: dict) -> np.ndarray:
    """The score of each text of a column."""
    out = np.full(len(texts), known["prior"])
    if known["model"] is None:
        return out
    mean, scale, w, least, largest = known["curve"]

    def curve(x: np.ndarray) -> np.ndarray:
        # Nothing is known beyond what was seen: a longer text than any counts as the longest.
        z = (np.clip(x, least, largest) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))

    out[:] = curve(np.zeros((1, len(mean))))
    for begin, data, ends in bs.text_groups(texts):
        out[begin : begin + len(ends) - 1] = curve(measured(data, ends, known["model"]))
    return out


def scored(docs: DataFrame, learned: dict, key: str = "doc_id") -> DataFrame:
    """key and score of every row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array(scores(b.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([b.column("key"), out], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, score double")
    return rows.withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that score below THRESHOLD; learned from training_docs, or docs themselves."""
    learned = learn(docs if training_docs is None else training_docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, shared.value))

    return docs.where(score("text") < THRESHOLD)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, learn(docs, labels))
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    return out.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
