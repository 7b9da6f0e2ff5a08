"""Hamming-radius joins by pigeonhole bands.

Two fingerprints within `radius` bits agree on one of radius + 1 disjoint bands, so an
equi-join on (band, value) finds every such pair and a bit count decides. Equal
fingerprints are one row before the join, and a band value that very many have (near-constant
images) is banded again by the other digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions.hashing import hamming, hex_words
from pairmill.session import cut


def bands(signature: Column, nibbles: int, radius: int) -> Column:
    """Array of radius + 1 substrings that cover a hex fingerprint."""
    if radius + 1 > nibbles:
        raise ValueError("more bands than hex digits")
    base, more = divmod(nibbles, radius + 1)
    parts, at = [], 1
    for i in range(radius + 1):
        size = base + (i < more)
        parts.append(F.substring(signature, at, size))
        at += size
    return F.array(*parts)


#: Pairs of a band value beyond which it is banded again, and how often.
HOT_PAIRS, LEVELS = 1_000_000, 4


def _banded(df: DataFrame, col: str, nibbles: int, radius: int) -> DataFrame:
    """(s, w, key, rest): a row for each band of each distinct fingerprint, with the digits left."""
    distinct = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("s")).distinct()
    rows = distinct.select("s", hex_words(F.col("s"), nibbles).alias("w"), F.lit("").alias("key"), F.col("s").alias("rest"))
    return _deeper(rows, nibbles, radius)


def _deeper(rows: DataFrame, nibbles: int, radius: int) -> DataFrame:
    """Rows banded once more, by the digits that their key doesn't have yet."""
    base, more = divmod(nibbles, radius + 1)
    if not base:
        raise ValueError("more bands than hex digits")
    sizes = [base + (i < more) for i in range(radius + 1)]
    starts = [1 + sum(sizes[:i]) for i in range(radius + 1)]
    rest = F.col("rest")
    parts = [
        F.struct(F.concat_ws("/", F.nullif("key", F.lit("")), F.concat(F.lit(f"{i}:"), F.substring(rest, at, n))).alias("key"), F.concat(F.substring(rest, 1, at - 1), F.substring(rest, at + n, nibbles)).alias("rest"))
        for i, (at, n) in enumerate(zip(starts, sizes))
    ]
    return rows.select("s", "w", F.explode(F.array(*parts)).alias("p")).select("s", "w", "p.key", "p.rest")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    b = right.select(F.col("s").alias("b"), F.col("w").alias("b_w"), "key")
    return left.select(F.col("s").alias("a"), F.col("w").alias("a_w"), "key").join(b, "key")


def _candidates(left: DataFrame, right: DataFrame | None, nibbles: int, radius: int) -> DataFrame:
    """(a, a_w, b, b_w) of fingerprints that agree on a band; `right` is None for pairs within
    `left`. A band value with very many pairs isn't joined: what agrees there may differ by
    `radius` bits in the other digits, so these are banded in turn, and only what agrees on a
    second band meets. LEVELS times at most, or until too few digits are left."""
    out = None
    longest = -(-nibbles // (radius + 1))
    for level in range(LEVELS):
        left, right = cut(left), None if right is None else cut(right)
        n = left.groupBy("key").agg(F.count("*").alias("n"))
        if right is not None:
            n = n.join(right.groupBy("key").agg(F.count("*").alias("m")), "key")
        hot = cut(n.filter((F.col("n") * F.col("n" if right is None else "m")) > HOT_PAIRS).select("key"))
        nibbles -= longest
        if level == LEVELS - 1 or nibbles <= radius or hot.isEmpty():
            met = _met(left, left if right is None else right)
            return (met if out is None else out.unionByName(met)).drop("key")
        cold = lambda x: x.join(hot, "key", "left_anti")
        met = _met(cold(left), cold(left if right is None else right))
        out = met if out is None else out.unionByName(met)
        again = lambda x: _deeper(x.join(hot, "key", "left_semi").select("s", "w", "key", "rest"), nibbles, radius)  # noqa: E731, B023
        left, right = again(left), None if right is None else again(right)
    raise AssertionError


def hamming_self(df: DataFrame, col: str, nibbles: int, radius: int) -> DataFrame:
    """(a, b, distance) for distinct fingerprints a < b within `radius` bits."""
    pairs = _candidates(_banded(df, col, nibbles, radius), None, nibbles, radius).filter("a < b")
    return _near(pairs, nibbles, radius)


def hamming_cross(left: DataFrame, right: DataFrame, col: str, nibbles: int, radius: int) -> DataFrame:
    """(a, b, distance) for a fingerprint of each side, equal ones included."""
    return _near(_candidates(_banded(left, col, nibbles, radius), _banded(right, col, nibbles, radius), nibbles, radius), nibbles, radius)


def _near(pairs: DataFrame, nibbles: int, radius: int) -> DataFrame:
    d = hamming(F.col("a_w"), F.col("b_w"), -(-nibbles // 16))
    return pairs.withColumn("distance", d.cast("int")).filter(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def within(a: Column, b: Column, nibbles: int, radius: int) -> Column:
    """Whether two hex fingerprints are within `radius` bits; null if one is null."""
    return hamming(hex_words(a, nibbles), hex_words(b, nibbles), -(-nibbles // 16)) <= radius
