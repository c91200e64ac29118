"""Operator 2, benchmark decontamination by spaced seeds, DataFrame functions only.

An overlap is confirmed where some `window` consecutive item tokens (the whole item, if shorter) agree in `agree` of all
places. Items of fewer than WHOLE tokens must agree in all places; `shortest` can leave out items of fewer tokens than it
says. Each of the fixed MASKS reads six token places and ignores those between. They are laid over every position of every
document and item, and equal hashes of what is read give hits (document, item, diagonal). However the places that may
differ lie in a window of 12 to 20 tokens, some mask reads none of them at some position, so no overlap is lost (a test
goes through all ways). Around each hit the item is laid over the document and compared token by token. An item of fewer
than WHOLE tokens has one hash of all its tokens, and gives one hit a document, the first.

Positions are looked at cheapest first: a mask can match only if all tokens it reads occur in the benchmark, which a bitmap
of token hashes tells, of a fixed size whatever the benchmark; most positions end at their first two tokens. The seeds of
the benchmark are broadcast if a count shows them small, else joined by a shuffle; so are the hits.

Edge cases: tokens are runs of letters and digits, lower-cased; null and empty texts have none and are clean; items
without tokens match nothing; repeated rows are judged alike; equal items are reported each; an empty benchmark leaves all
clean; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm.common import fingerprint, packed, saved, small, table

#: Items of fewer tokens must agree whole.
WHOLE = 12
#: The places that each mask reads (1) and ignores (0).
MASKS = ("1101111", "1111000101", "11001000111", "1111010000001")
BITMAP = 1 << 16


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def vocabulary(bench: DataFrame) -> Column:
    """A bitmap of BITMAP bits, as an array of longs, of the token hashes in bench (item_ids)."""
    at = F.col("t").bitwiseAND(F.lit(BITMAP - 1))
    bits = bench.select(F.explode("item_ids").alias("t")).select(F.floor(at / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    known = {r["word"]: r["bits"] for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()}
    return F.array(*[F.lit(known.get(i, 0)).cast("long") for i in range(BITMAP // 64)])


@cache
def covered(wide: int, agree: float) -> bool:
    """Whether some mask reads none of the places that differ, however as many as may lie in a window of so many tokens."""
    laid = [frozenset(at + i for i, c in enumerate(m) if c == "1") for m in MASKS for at in range(wide - len(m) + 1)]
    return all(any(m.isdisjoint(differ) for m in laid) for differ in combinations(range(wide), wide - ceil(wide * agree - 1e-9)))


def seeds(rows: DataFrame, ids: str, whole: list[int], *keep: str) -> DataFrame:
    """(keep..., at, kind, seed): what each mask (kind: its number), and each run of `whole` tokens (kind: minus its length),
    reads at each position of the token ids; a null id matches nothing."""
    there = lambda p, places: reduce(and_, [F.get(ids, p + i).isNotNull() for i in places])

    def of(kind: int, places: list[int]) -> Column:
        begin = "_ones" if len(places) == 1 else "_twos"
        starts = F.filter(begin, lambda p: there(p, places[2:])) if places[2:] else F.col(begin)
        seed = lambda p: F.xxhash64(F.lit(kind), *[F.get(ids, p + i) for i in places])
        return F.transform(starts, lambda p: F.struct(p.alias("at"), F.lit(kind).alias("kind"), seed(p).alias("seed")))

    none, least = F.array().cast("array<int>"), 1 if 1 in whole else 2
    ones = F.when(F.size(ids) >= least, F.filter(F.sequence(F.lit(0), F.size(ids) - least), lambda p: there(p, [0]))).otherwise(none)
    every = [of(k, [i for i, c in enumerate(m) if c == "1"]) for k, m in enumerate(MASKS)] + [of(-n, list(range(n))) for n in whole]
    # No filter here, and an outer inline, which infers none: pushed down, it would compute the ids anew for each place.
    rows = rows.withColumn("_ones", ones).withColumn("_twos", F.filter("_ones", lambda p: there(p, [1])))
    return rows.select(*keep, F.inline_outer(F.concat(*every)))


def overlaps(
    docs: DataFrame, items: DataFrame, window: int = 20, agree: float = 0.8, key: str = "doc_id", item: str = "item_id", shortest: int = 1
) -> DataFrame:
    """(doc, item, at, tokens_agreeing): the confirmed overlaps; doc is 128 bits of key and text, at the diagonal."""
    bench = items.select(F.col(item).alias("item"), hashed(F.col("text")).alias("item_ids")).where(F.size("item_ids") >= max(1, shortest))
    bench, m = saved(bench), F.size("item_ids")
    wide = [r[0] for r in bench.where(m >= WHOLE).select(F.least(F.lit(window), m)).distinct().collect()]
    if lost := [n for n in sorted(wide) if not covered(n, agree)]:
        raise ValueError(f"the masks do not find every overlap of {lost[0]} tokens that agrees in {agree} of them")
    whole = sorted(r[0] for r in bench.where(m < WHOLE).select(m).distinct().collect())
    kind = F.when(m < WHOLE, -m)
    probe = seeds(bench.withColumn("own", kind), "item_ids", whole, "item", "own")
    probe = probe.where("if(own is null, kind >= 0, kind = own and at = 0)").select("item", F.col("at").alias("item_at"), "seed")
    probe = small(probe)
    known = vocabulary(bench)
    texts = docs.select(fingerprint(key, "text").alias("doc"), "text").where("text <> ''")
    in_bench = lambda t: F.getbit(known[F.shiftright(t.bitwiseAND(F.lit(BITMAP - 1)), 6).cast("int")], t.bitwiseAND(F.lit(63)).cast("int")) == 1
    marked = F.transform(hashed(F.col("text")), lambda t: F.when(in_bench(t), t))
    laid = seeds(texts.select("doc", marked.alias("ids")), "ids", whole, "doc").join(probe, "seed")
    laid = laid.select("doc", "item", "kind", (F.col("at") - F.col("item_at")).alias("at"))
    # A whole item's first place tells all; of a mask's, every diagonal is a hit of its own.
    hits = laid.groupBy("doc", "item", F.when(F.col("kind") >= 0, F.col("at")).alias("diagonal")).agg(F.min("at").alias("at"))
    hits = saved(hits.drop("diagonal"))
    found = texts.join(small(hits.select("doc").distinct()), "doc", "left_semi").dropDuplicates(["doc"])
    both = found.select("doc", hashed(F.col("text")).alias("ids")).join(small(hits), "doc").join(small(bench), "item")
    same = F.transform("item_ids", lambda t, i: F.when(F.get("ids", i + F.col("at")) == t, 1).otherwise(0))
    wide = F.least(F.lit(window), m)
    need = F.when(m < WHOLE, m).otherwise(wide * agree)
    both = both.select("doc", "item", "at", same.alias("same"), m.alias("m"), wide.alias("wide"), need.alias("need"))
    both = both.where(F.aggregate("same", F.lit(0), lambda a, x: a + x) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.col("m") - F.col("wide") + 1)
    inside = lambda s: F.aggregate(F.slice("same", s, F.col("wide")), F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(starts, inside))
    return both.withColumn("tokens_agreeing", best).where(best >= F.col("need")).drop("same", "m", "wide", "need")


def contaminated(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """(doc, n_items, items): the documents that hold a benchmark passage, with the items in order, comma-joined."""
    found = overlaps(docs, items, **options).select("doc", "item").distinct()
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string")), ",")
    return found.groupBy("doc").agg(F.count("*").alias("n_items"), listed.alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of items."""
    found = small(saved(contaminated(docs, items, **options).select(F.col("doc").alias("_doc"))))
    return packed(docs).join(found, "_doc", "left_anti").select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = small(saved(contaminated(docs, items)))
    out = docs.select("doc_id", fingerprint("doc_id", "text").alias("doc")).join(found, "doc", "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"),
    )
