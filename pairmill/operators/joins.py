"""Joins with their checks: validated left joins, lookups, exact matches by any of several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def left_join_validated(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """1:1 left join; with `check`, repeated keys and rows without a partner are errors."""
    joined = left.join(right.withColumn("__right", F.lit(True)), key, "left")
    if check:
        if not duplicates(left, key).isEmpty() or not duplicates(right, key).isEmpty():
            raise ValueError(f"{key} is not unique")
        if not joined.filter("__right is null").isEmpty():
            raise ValueError(f"{key} without a partner")
    return joined.drop("__right")


def lookup(left: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner join to a dimension in which a missing key is an error."""
    missing = left.join(dim, key, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"{key} missing from the dimension")
    return left.join(dim, key)


#: A key with at least 1/HOT_SHARE of all rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of `rows` to a table with one row per key, whose column `count` says how
    many of `rows` have the key. Hot keys are met by a broadcast of their rows of `per_key`
    (at most HOT_SHARE, whatever the input), where `rows` lie; the others meet in a shuffle,
    in which no key has more than 1/HOT_SHARE of all rows. Both inputs are read twice: give
    tables or checkpoints. Null keys meet nothing; the result has no column `count`."""
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE >= total
    hot = per_key.filter(is_hot)
    if hot.isEmpty():
        return rows.join(per_key.drop(count), key)
    at_once = rows.join(F.broadcast(hot.drop(count)), key)
    shuffled = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(~is_hot).drop(count), key)
    return at_once.unionByName(shuffled)


def unpivot_keys(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, kind, value) with a row for each non-null, non-empty key: an OR of equalities
    becomes one equi-join. `value` is the key's md5, so whole texts aren't shuffled."""
    pairs = ", ".join(f"'{k}', nullif({k}, '')" for k in keys)
    rows = df.selectExpr(f"{id_col} as id", f"stack({len(keys)}, {pairs}) as (kind, value)").filter("value is not null")
    return rows.select("id", "kind", F.unhex(F.md5(F.col("value").cast("binary"))).alias("value"))


def match_any_key(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """(left_id, right_id, kind) for rows that share the value of a key."""
    a = unpivot_keys(left, left_id, keys).withColumnRenamed("id", left_id)
    b = unpivot_keys(right, right_id, keys).withColumnRenamed("id", right_id)
    return a.join(b, ["kind", "value"]).select(left_id, right_id, "kind").distinct()


def shared_values(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """(kind, value, n_left, n_right) for each value on both sides: how many ids of each side
    have it. A popular value is one row, not all pairs of its ids."""
    count = lambda df, i, n: unpivot_keys(df, i, keys).distinct().groupBy("kind", "value").agg(F.count("*").alias(n))
    return count(left, left_id, "n_left").join(count(right, right_id, "n_right"), ["kind", "value"])


def with_any_key(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """Distinct ids of `left` that share the value of a key with a row of `right`."""
    there = unpivot_keys(right, right_id, keys).select("kind", "value").distinct()
    return unpivot_keys(left, left_id, keys).join(there, ["kind", "value"], "left_semi").select(F.col("id").alias(left_id)).distinct()


def first_of_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """Union in which a key of an earlier source wins, whatever the partitioning."""
    ranked = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    others = [c for c in out.columns if c not in (key, "__source")]
    best = out.groupBy(key).agg(F.min(F.struct("__source", *others)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in others])


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: keys missing from `actual` and keys it has beyond `expected`."""
    both = expected.select(key).distinct().withColumn("e", F.lit(1)).join(actual.select(key).distinct().withColumn("a", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))
