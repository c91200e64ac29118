"""Operator 4, sharding: jump consistent hashing of stable keys, DataFrame functions only.

Jump consistent hashing (Lamping and Veach) walks the growing number of shards: a key in shard b leaves it next when
there are floor((b + 1) / u) + 1 shards, u uniform in (0, 1] and fixed by key and step. So a key's shard depends on the
key and the number of shards alone, and one more shard takes keys only into itself. The u of a step are taken from
md5(key:step), so that any engine can repeat them.

Edge cases: a null key counts as the text "null"; null texts have no bytes; repeated rows get slots of their own; rows
of an empty table give no rows; columns of the input other than the key are ignored, or kept by `sharded`, which renames
those called shard or slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraspark.llm.common import saved, small, table

SHARDS = 24
#: Each shard is numbered in so many runs of hash order, so that no task gets a whole shard.
RUNS = 1024


def uniform(key: Column, step: Column) -> Column:
    """In (0, 1], from the first 32 bits of md5(key:step)."""
    digest = F.substring(F.md5(F.concat(key, F.lit(":"), step.cast("string"))), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def jumps(key: Column, shards: int) -> Column:
    """(shard, grown_shard) of a key, 0 to shards - 1, and with one shard more. The jumps are a fold over as many steps as
    could ever be needed; once past the last shard nothing changes. The expected number of jumps is ln(shards) + 1; a step
    costs a hash only while the key still moves."""
    if shards < 1:
        raise ValueError("shards must be positive")
    stable = F.coalesce(key.cast("string"), F.lit("null"))
    state = lambda shard, grown, j: F.struct(shard.alias("shard"), grown.alias("grown_shard"), j.cast("long").alias("j"))

    def jump(at: Column, step: Column) -> Column:
        b = at["j"]
        moved = state(F.when(b < shards, b.cast("int")).otherwise(at["shard"]), b.cast("int"), F.floor((b + 1) / uniform(stable, step)))
        return F.when(b <= shards, moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), state(F.lit(0), F.lit(0), F.lit(0)), jump)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key."""
    return jumps(key, shards)["shard"]


def numbered(df: DataFrame, group: str, order: Column, ties: list[Column], name: str = "slot") -> DataFrame:
    """df with a gapless number from 0 within each group, by order (32 bits, as a long) and ties.

    The order is cut in RUNS ranges; rows are numbered within (group, range), and the counts of the ranges, at most
    RUNS rows for each group, give each range its start. No task needs a whole group.
    """
    df = df.withColumn("_order", order).withColumn("_run", F.floor(F.col("_order") / (2**32 // RUNS)).cast("int"))
    counts = df.groupBy(group, "_run").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_run", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(group, "_run").orderBy("_order", *ties))
    return (
        df.withColumn("_rank", rank)
        .join(small(saved(starts)), [group, "_run"])
        .withColumn(name, F.col("_start") + F.col("_rank") - 1)
        .drop("_order", "_run", "_rank", "_start")
    )


def place(key: Column, tie: Column) -> Column:
    """Where a row stands in its shard: 32 bits of a hash of its key; of tie, if it has none."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("null:"), tie.cast("string")))
    return F.conv(F.substring(F.md5(own), 1, 8), 16, 10).cast("long")


def sharded(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """docs, all columns, with shard and slot; columns of docs that have these names come back as own_shard and own_slot."""
    taken, kept = {c.lower() for c in docs.columns}, []
    for c in docs.columns:
        name = c
        while name.lower() in ("shard", "slot") or (name != c and name.lower() in taken):
            name = f"own_{name}"
        kept.append(F.col(f"`{c}`").alias(name))
    rows = docs.select(F.struct(*kept).alias("row"), F.xxhash64("text").alias("_text"), jump_shard(F.col(key), shards).alias("shard"))
    return numbered(rows, "shard", place(F.col(f"row.{key}"), F.col("_text")), [F.col(f"row.{key}"), F.col("_text")]).select("row.*", "shard", "slot")


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, text: str = "text") -> DataFrame:
    """The narrow table of all rows of docs: key, size, text_crc32, law, shard, slot and grown_shard. Texts are read once."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key),
        (F.length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        jumps(F.col(key), shards).alias("at"),
    )
    rows = saved(rows.select(key, "size", "text_crc32", "law", "at.shard", "at.grown_shard"))
    return numbered(rows, "shard", place(F.col(key), F.col("text_crc32")), [F.col(key), F.col("text_crc32"), F.col("size")])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
