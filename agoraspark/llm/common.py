"""What several operators share: the shared folder, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from agoraspark.session import new_folder, ship

#: A side of at most this many bytes, with ROW_BYTES for every row, is broadcast; beyond it the join is left to a shuffle.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 16
#: A key of more rows comes back by a broadcast join of its own.
HOT_ROWS = 2000
#: The ASCII white space that separates words in all contracts.
GAPS = r"[\x20\x09-\x0D]+"


__all__ = ["components", "fingerprint", "joined_apart", "packed", "saved", "ship", "small", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows, written to the shared folder and read again. Survives a lost executor."""
    path = new_folder(df.sparkSession, "llm")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: DataType) -> Column:
    """The bytes of a column's value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(f"`{name}`")
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.octet_length(F.to_json(F.struct(F.col(f"`{name}`"))))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to hold at most so many bytes, else df as it is.

    The limit keeps the measurement itself from growing: a table of more rows than could fit is not read to its end.
    """
    rows = most // ROW_BYTES
    width = sum((F.coalesce(_width(f.name, f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(ROW_BYTES))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most else df


def joined_apart(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has one row for each key, and in n how many rows of left have it. Keys of more than
    hot_rows rows, at most one in hot_rows of all rows, are broadcast, so that none fills a task of the shuffled join."""
    right = saved(right)
    hot = small(right.where(F.col("n") > hot_rows).drop("n"))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") <= hot_rows).drop("n"), key)
    return rest.unionByName(left.join(hot, key))


def fingerprint(*names: str) -> Column:
    """128 bits of a row's values in the named columns; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")) for n in names]
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))


def packed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, _doc): the rows with all columns in a struct, where no name of theirs can clash, and 128 bits of key and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), fingerprint(key, "text").alias("_doc"))


def words(text: Column) -> Column:
    """The words of a text; none of null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours the smallest node it sees, then
    every node hands its smaller ones the smallest. Each is one aggregation with partial sums and one join, so a node
    with very many edges needs no task of its own; the rounds grow with the logarithm of the longest path. Loops and
    null ends are ignored.
    """
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if now.isEmpty():
        return now.selectExpr("a as node", "b as component")
    mark = None
    for _ in range(limit):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = large.join(low, "a")
        now = saved(
            both.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(seen) == mark and seen[0] == seen[2]:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

