"""Ranks and top rows in pseudo-random order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.hashing import seeded
from pairmill.session import cut

BUCKET_DIGITS = 3


def global_rank(df: DataFrame, digest_col: str, tie: str, out: str = "rank") -> DataFrame:
    """1-based rank by (digest, tie). Rows are counted per leading hex digits of the digest
    (4096 buckets, one small row each); within a bucket a window numbers them."""
    bucketed = df.withColumn("__b", F.substring(digest_col, 1, BUCKET_DIGITS))
    counts = bucketed.groupBy("__b").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__b").orderBy(digest_col, tie)
    return bucketed.withColumn("__r", F.row_number().over(inner)).join(base, "__b").withColumn(out, F.col("__base") + F.col("__r")).drop("__b", "__r", "__base")


def range_rank(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """0-based rank by `order`: rows are sorted by range in parallel, numbered in their
    partition and kept in the shared folder; only a count per partition is added. Equal
    leading columns, however many rows have them, are split over partitions."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    placed = placed.withColumn("__p", F.shiftright("__m", 33)).withColumn("__m", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    return placed.join(F.broadcast(base), "__p").withColumn(out, F.col("__base") + F.col("__m")).drop("__p", "__m", "__base")


def top_per_class(df: DataFrame, class_col: str, n: int, *order: str) -> DataFrame:
    """The n first rows of each class; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(class_col).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def nested_subsets(df: DataFrame, class_col: str, sizes: tuple[int, ...], digest: str, key: str) -> DataFrame:
    """(size, rank, ...) for subsets of the `size` first rows of each class by (digest, key), each
    in a seeded order of its own rows. One ranking serves all sizes, so a smaller subset lies
    in each larger one, and only the largest subset's rows are carried on."""
    w = Window.partitionBy(class_col).orderBy(digest, key)
    first = df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= max(sizes))
    each = first.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: F.col("__k") <= s)))
    shuffled = Window.partitionBy("size").orderBy(seeded("shuffle", F.col(key)), key)
    return each.withColumn("rank", F.row_number().over(shuffled)).drop("__k")
