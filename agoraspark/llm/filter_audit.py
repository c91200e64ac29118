"""Operator 13, filter interaction audit: what five filters remove in every order, from one SQL CUBE over their failure flags.

1. Every text is read once, into four flags and 128 bits of itself; copies of a smaller id's text set the fifth. Rows that
   agree in part, flags and labels are counted before anything is cubed: at most 128 cells a part.
2. `GROUP BY CUBE (part, a, b, c, d, e)` runs over the cells. A row of a part whose selected flags (those grouped by) are
   all false holds the survivors of just that subset of filters.
3. A step of an order adds one filter to a subset, and survivors of the subset and of the subset with the filter, joined,
   tell what it removes. There are 80 such pairs, whatever the order; the 120 orders of five steps each look theirs up.

Edge cases: null texts are empty, null sources are the part ''; a text without words passes B; rows of a null id are no
copies and have none, and no labels; repeated rows of one id are not copies of each other; several labels of an id count
if any says 1; a part has all its rows of result, zeros included; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm.common import HOT_ROWS, saved, small, table, words

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails A to D, by its own content."""
    tokens = words(text)
    return {
        "a": F.size(tokens) < 50,
        "b": 100 * F.size(F.array_distinct(tokens)) < 65 * F.size(tokens),
        "c": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "d": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, key: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, a, b, c, d, e) of every row of docs. A text that many rows share, a third of them if need be, has its
    smallest id found with partial sums and brought back by a broadcast; other copies meet in a shuffled join."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = failures(F.col("text"))
    rows = saved(rows.select("doc_id", "part", *[c.alias(n) for n, c in own.items()], F.unhex(F.md5("text")).alias("body")))
    firsts = rows.groupBy("body").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    firsts = saved(firsts.where("first < last").select("body", "first", "n"))
    hot = small(firsts.where(F.col("n") > HOT_ROWS).drop("n"))
    rest = rows.join(hot.select("body"), "body", "left_anti").join(firsts.where(F.col("n") <= HOT_ROWS).drop("n"), "body", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rest.unionByName(rows.join(hot, "body")).select("doc_id", "part", *own, copy.alias("e"))


def cells(flags: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, a, b, c, d, e, n, good, toxic): documents by part and flags, and those that labels call good or toxic."""
    known = labels.where("quality = 1 or toxic = 1").groupBy(F.col(key).alias("doc_id"))
    known = known.agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    names = ["part", *FILTERS.lower()]
    once = flags.groupBy("doc_id", *names).agg(F.count("*").alias("n"))  # the rows of one id are one row for each cell
    once = once.join(known, "doc_id", "left").select(*names, "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]])
    return once.groupBy(*names).agg(*[F.sum(c).alias(c) for c in COUNTS])


def survivors(found: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): what is left of each part after each subset of filters (bit i of mask: the i-th) that
    leaves any. Rows of the cube for all parts together are left out."""
    flags = list(FILTERS.lower())
    cubed = found.cube("part", *flags).agg(F.grouping("part").alias("every"), *[F.grouping(f).alias(f"_{f}") for f in flags], *[F.sum(c).alias(c) for c in COUNTS])
    passes = [(F.col(f"_{f}") == 1) | ~F.col(f) for f in flags]
    mask = sum(((1 - F.col(f"_{f}").cast("int")) * F.lit(1 << i) for i, f in enumerate(flags)), F.lit(0))
    kept = cubed.where(F.col("every") == 0)
    for p in passes:
        kept = kept.where(p)
    return kept.select("part", mask.cast("int").alias("mask"), *COUNTS)


def audit(flags: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley of the step's filter."""
    left = saved(survivors(saved(cells(flags, labels, key))))
    size, full = len(FILTERS), (1 << len(FILTERS)) - 1
    pairs = [(mask, mask | 1 << i, i, mask | 1 << i == full, factorial(bin(mask).count("1")) * factorial(size - 1 - bin(mask).count("1"))) for i in range(size) for mask in range(full + 1) if not mask >> i & 1]
    steps = [("".join(FILTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(size)) for k in range(size)]
    literal = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(p, ("mask", "after", "filter", "whole", "orders"), strict=True)]) for p in pairs])
    every = left.where("mask = 0").select("part", F.inline(literal))
    after = left.select("part", F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_after") for c in COUNTS])
    met = every.join(left, ["part", "mask"], "left").join(after, ["part", "after"], "left").fillna(0, [*COUNTS, *[f"{c}_after" for c in COUNTS]])
    for c in COUNTS:
        met = met.withColumn(f"{c}_gone", F.col(c) - F.col(f"{c}_after"))
    met = saved(met.select("part", "mask", "filter", "whole", "orders", F.col("n_after").alias("kept"), *[f"{c}_gone" for c in COUNTS]))
    own = met.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("mask") == 0, F.col("n_gone"))).alias("fails"),
        F.sum(F.when(F.col("whole"), F.col("n_gone"))).alias("unique_fails"),
        F.sum(F.col("n_gone") * F.col("orders")).alias("shapley"),
    )
    told = met.join(own, ["part", "filter"]).join(F.broadcast(left.sparkSession.createDataFrame(steps, "filter_order string, step int, mask int, filter int")), ["mask", "filter"])
    return told.select(
        "part", "filter_order", "step", "kept", F.col("n_gone").alias("removed"), (F.col("fails") - F.col("n_gone")).alias("redundant"),
        "unique_fails", F.col("good_gone").alias("good_lost"), F.col("toxic_gone").alias("toxic_lost"), "shapley",
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
