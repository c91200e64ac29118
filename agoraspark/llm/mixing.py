"""Operator 6, mixing sources to target weights: a multivariate-hypergeometric splitting tree, DataFrame functions only.

1. Each source gets a target in words: its weight's part of all words, but at most `cap` times its own; what is over
   goes to the others by weight until none is above (water-filling in closed form).
2. A source's target is a number of blocks of `block_words`, the last one short: its quota. A binary tree over the output
   shards splits the exact quotas: at each node the left half draws its number of blocks of each source from the
   multivariate hypergeometric law, source after source (one row a node, an array over sources).
3. A source's documents are laid out in a permuted order, once for each pass that the target needs. A shard draws its
   blocks from this line: the whole passes are dealt without gaps; of the last pass, of which only a part is wanted, each
   shard has a stretch of its own in proportion to the blocks drawn before it, and takes the first words there. So shards
   draw disjoint words, the tree decides which words of the last pass are taken, and a source meets its target to the
   word. A document is in a shard as far as the shard's words cover it; within a shard documents are shuffled by a hash.

Edge cases: a null source is a source of its own, the last; null and blank texts have size 0 and are taken 0 times;
repeated rows count each; an empty table gives no rows; extra columns are ignored. Reruns agree: all draws come from
md5 of the seed. Sources and shards are few (one row a source holds its shards), documents any number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.llm.common import fingerprint, packed, saved, small, table

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: A source's line is summed in so many runs of hash order, so that no task gets a whole source.
RUNS = 1024


def _unit(*parts: Column) -> Column:
    """In (0, 1), from md5 of the parts."""
    digest = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(src, nth, source_size, target) of each source of sizes (src, source_size); one row a source.

    The level lam with sum(min(lam * weight, cap * size)) = all words is what repeated resharing ends at. Sources are
    ordered by the level at which they fill up; the first whose level is enough for the rest fixes lam.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    nth = F.row_number().over(order)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("nth", nth).withColumn("w", F.element_at(kinds, ((F.col("nth") - 1) % len(weights) + 1)))
    s = s.withColumn("full", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("full") / F.col("w"), "nth")
    every = Window.orderBy("one").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("one", F.lit(1)).withColumns({
        "total": F.sum("source_size").over(every),
        "before": F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    s = s.withColumn("lam", (F.col("total") - F.col("before")) / F.col("rest"))
    enough = F.when(F.col("lam") * F.col("w") <= F.col("full"), F.struct(F.col("full") / F.col("w"), "nth", "lam"))
    s = s.withColumn("lam", F.min(enough).over(every)["lam"])
    return s.select("src", "nth", "source_size", F.least(F.col("lam") * F.col("w"), F.col("full")).alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is written and computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of `draws` blocks, drawn without return from good + bad, are good: the quantile at u.

    Folds over the values within 12 standard deviations of the mean, once to add up the weights (each the one before
    times a ratio) and once to find the value where they pass u of the sum. Outside lies less than 1e-30.
    """
    n = F.greatest(good + bad, F.lit(1.0))
    moments = F.struct(
        good.alias("g"), bad.alias("b"), draws.alias("d"), (draws * good / n).alias("mean"),
        F.sqrt(draws * good / n * (1 - good / n) + 1).alias("sd"),
    )

    def ends(m: Column) -> Column:
        low = F.greatest(F.lit(0.0), m["d"] - m["b"], F.floor(m["mean"] - 12 * m["sd"] - 12).cast("double"))
        high = F.least(m["g"], m["d"], F.ceil(m["mean"] + 12 * m["sd"] + 12).cast("double"))
        return F.struct(m.alias("m"), low.alias("low"), F.greatest(low, high).alias("high"))

    def quantile(e: Column) -> Column:
        m = e["m"]
        steps = F.sequence(e["low"].cast("long"), e["high"].cast("long"))

        def after(w: Column, k: Column) -> Column:
            return w * (m["g"] - k) * (m["d"] - k) / ((k + 1) * (m["b"] - m["d"] + k + 1))

        def add(t: Column, k: Column) -> Column:
            return F.struct(after(t["w"], k.cast("double")).alias("w"), (t["s"] + t["w"]).alias("s"))

        def find(t: Column, k: Column) -> Column:
            now = t["s"] + t["w"]
            at = F.when((now < t["goal"]) & (k < e["high"]), (k + 1).cast("double")).otherwise(t["at"])
            return F.struct(after(t["w"], k.cast("double")).alias("w"), now.alias("s"), at.alias("at"), t["goal"].alias("goal"))

        one, none = F.lit(1.0).alias("w"), F.lit(0.0).alias("s")
        goal = u * F.aggregate(steps, F.struct(one, none), add, lambda t: t["s"])
        return F.aggregate(steps, F.struct(one, none, e["low"].alias("at"), goal.alias("goal")), find, lambda t: t["at"])

    return _let(_let(moments, ends), quantile)


def split_quotas(blocks: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """(nth, cuts): for each source, the first block of every shard and the end, from (nth, blocks).

    The nodes of one level of the tree are rows with an array over sources. A node of k shards gives its left half
    round(k_left / k) of its blocks; the sources' parts are drawn one after another, each from what is left.
    """
    every = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "blocks"))), lambda x: x["blocks"].cast("double")).alias("q"))
    nodes = every.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    width = shards
    while width > 1:
        k = F.col("hi") - F.col("lo")
        half = F.floor((k + 1) / 2).cast("int")
        total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
        take = F.round(total * half / k)
        empty = F.array().cast("array<double>")
        start = F.struct(total.alias("left"), take.alias("need"), empty.alias("out"), F.lit(0).alias("i"))

        def draw(t: Column, x: Column) -> Column:
            u = _unit(F.lit(str(seed)), F.col("lo").cast("string"), F.col("hi").cast("string"), t["i"].cast("string"))
            after = lambda got: F.struct(
                (t["left"] - x).alias("left"), (t["need"] - got).alias("need"),
                F.concat(t["out"], F.array(got)).alias("out"), (t["i"] + 1).alias("i"),
            )
            return _let(hypergeometric(u, x, t["left"] - x, t["need"]), after)

        drawn = F.aggregate("q", start, draw, lambda t: t["out"])
        cut = nodes.where(k > 1).withColumn("got", drawn)
        left = cut.select("lo", (F.col("lo") + half).alias("hi"), F.col("got").alias("q"))
        right = cut.select((F.col("lo") + half).alias("lo"), "hi", F.zip_with("q", "got", lambda a, b: a - b).alias("q"))
        nodes = saved(nodes.where(k <= 1).union(left).union(right))
        width = (width + 1) // 2
    each = nodes.select("lo", F.posexplode("q").alias("i", "n"))
    upto = Window.partitionBy("i").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum("n").over(upto).cast("long"))
    return ends.groupBy((F.col("i") + 1).alias("nth")).agg(F.array_sort(F.collect_list("end")).alias("cuts"))


def stretches(quotas: DataFrame, block_words: int) -> DataFrame:
    """(nth, stretches): where on a source's line each shard takes its words, as (shard, low, high), in the line's order.

    quotas: (nth, source_size, goal, cuts). A shard between cuts a and b owns the words [a, b) of the goal. Those of whole
    passes lie on the line as they are; those of the part `rest` of a last pass are moved on by a gap that grows with the
    place, so that all of the pass can be reached.
    """
    size, goal = F.col("source_size"), F.col("goal")
    whole = F.floor(goal / F.greatest(size, F.lit(1))) * size
    rest = goal - whole

    def of(i: Column) -> Column:
        low = F.least(goal, F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)) * block_words)
        high = F.least(goal, F.get("cuts", i) * block_words)
        at = F.greatest(low, whole) - whole
        gap = F.least(size - rest, F.floor((size - rest).cast("double") * at.cast("double") / F.greatest(rest, F.lit(1)).cast("double")))
        begin = whole + at + gap
        piece = lambda a, b: F.struct(i.alias("shard"), a.cast("long").alias("low"), b.cast("long").alias("high"))
        return F.array(piece(low, F.least(high, whole)), piece(begin, begin + high - F.greatest(low, whole)))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts") - 1), of))
    found = F.filter(every, lambda x: x["high"] > x["low"])
    return quotas.select("nth", F.array_sort(F.transform(found, lambda x: F.struct(x["low"], x["high"], x["shard"]))).alias("stretches"))


def drawn(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, shards: int = 8, block_words: int = 4096,
    seed: int = 17, key: str = "doc_id",
) -> DataFrame:
    """One row for each row of docs: key, src, size, source_size, target and draws, the array of (pass, shard, taken,
    spot) of the words that shards take of it, by pass and place; spot is the place in the shard's shuffled order."""
    rows = docs.select(F.col(key), F.col("source").alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_t"))
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.col("_t").cast("string")))
    rows = rows.withColumn("_ident", F.concat_ws(":", F.lit(str(seed)), own))
    rows = rows.withColumn("_at", F.conv(F.substring(F.md5("_ident"), 1, 8), 16, 10).cast("long"))
    rows = saved(rows.withColumn("_run", F.floor(F.col("_at") / (2**32 // RUNS)).cast("int")))
    runs = rows.groupBy("src", "_run").agg(F.sum("size").alias("_words"))
    sizes = targets(runs.groupBy("src").agg(F.sum("_words").alias("source_size")), weights, cap)
    sizes = saved(sizes.withColumn("goal", F.floor("target").cast("long")))
    cuts = split_quotas(sizes.select("nth", F.ceil(F.col("goal") / block_words).alias("blocks")), shards, seed)
    taken_at = stretches(sizes.join(cuts, "nth"), block_words)
    sources = saved(sizes.join(taken_at, "nth").drop("nth"))
    before = Window.partitionBy("src").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("src").alias("_src"), F.col("_run").alias("_r"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("src", "_run").orderBy("_at", key, "_t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    rows = rows.join(small(saved(runs)), F.col("src").eqNullSafe(F.col("_src")) & (F.col("_run") == F.col("_r"))).drop("_src", "_r")
    rows = rows.join(small(sources.withColumnRenamed("src", "_src")), F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    last = F.ceil(F.col("goal") / F.greatest("source_size", F.lit(1))).cast("int") - 1

    def one_pass(p: Column) -> Column:
        low = F.col("_start") + F.col("_in") + p * F.col("source_size")
        spot = F.conv(F.substring(F.md5(F.concat_ws(":", "_ident", F.lit("spot"), p.cast("string"))), 1, 8), 16, 10).cast("long")
        words = lambda x: F.least(x["high"], low + F.col("size")) - F.greatest(x["low"], low)
        near = F.filter("stretches", lambda x: words(x) > 0)
        return F.transform(near, lambda x: F.struct(p.alias("pass"), x["shard"].alias("shard"), words(x).cast("long").alias("taken"), spot.alias("spot")))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), one_pass))
    return rows.select(key, "src", "size", "source_size", "target", found.alias("draws"))


def taken(docs: DataFrame, **options: object) -> DataFrame:
    """One row for each row of docs: key, src, size, source_size, target, taken (the sum of all shards' draws) and shards
    (shard:words of each draw, comma-joined)."""
    out = drawn(docs, **options)
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda n, x: n + x["taken"])
    listed = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["taken"].cast("string"))), ",")
    return out.select(*[c for c in out.columns if c != "draws"], words.alias("taken"), listed.alias("shards"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, all columns, once for each pass that takes any of their words, in the shard that takes the first:
    shard by shard, and within a shard in its shuffled order."""
    narrow = docs.select(F.hex(fingerprint("doc_id", "text")).alias("_doc"), "source", "text")
    # One copy for each pass, at the first of its draws.
    firsts = F.filter("draws", lambda x, i: (i == 0) | (F.get("draws", i - 1)["pass"] != x["pass"]))
    placed = F.transform(firsts, lambda x: F.struct(x["shard"].alias("shard"), x["spot"].alias("spot")))
    copies = drawn(narrow, key="_doc", **options).select(F.unhex("_doc").alias("_doc"), placed.alias("draws")).where(F.size("draws") > 0)
    copies = saved(copies.groupBy("_doc").agg(F.count("*").alias("_same"), F.flatten(F.collect_list("draws")).alias("draws")))
    repeated = small(copies.where("_same > 1").select("_doc"))
    rows = packed(docs)
    rows = rows.join(repeated, "_doc", "left_anti").unionByName(rows.join(repeated, "_doc", "left_semi").dropDuplicates(["_doc"]))
    dealt = rows.join(small(copies.select("_doc", "draws")), "_doc").select("row", "_doc", F.posexplode("draws").alias("_nth", "draw"))
    dealt = dealt.select("row", F.col("draw.shard").alias("_shard"), F.col("draw.spot").alias("_spot"), "_doc", "_nth")
    order = ["_shard", "_spot", "_doc", "_nth"]
    return dealt.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")
