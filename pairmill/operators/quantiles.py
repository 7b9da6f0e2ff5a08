"""Exact quantiles with linear interpolation, without one buffer of all values.

A sketch of bounded size brackets each wanted rank; one pass counts what lies below and inside
each bracket. Brackets with few different values inside are read out as (value, count); the
others are sketched again inside, and where that no longer helps (a very frequent value beside
very many others) the bracket's different values are sorted by range and added up per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.session import cut

#: The sketch is off by at most rows / ACCURACY ranks; different values that may be read out.
ACCURACY, READ_OUT = 2_000, 50_000


def _by_sorting(counts: DataFrame, rank: int) -> float:
    """The value at a 0-based rank of (x, n), by range partitions."""
    placed = cut(counts.repartitionByRange("x").sortWithinPartitions("x").withColumn("p", F.spark_partition_id()))
    before = 0
    for r in sorted(placed.groupBy("p").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["p"]):
        if before + r["n"] > rank:
            reach = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
            part = placed.filter(F.col("p") == r["p"]).withColumn("reach", reach)
            return part.filter(F.col("reach") > rank - before).agg(F.min("x")).first()[0]
        before += r["n"]
    raise ValueError("rank beyond the rows")


def select_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values of a one-column table at 0-based ranks, nulls left out."""
    x = F.col("x")
    rows = values.toDF("x").filter(x.isNotNull())
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    bracket = {k: (low, high) for k in ranks}
    found: dict[int, float] = {}
    inside_before: dict[int, int] = {}
    while bracket:
        spans = sorted(set(bracket.values()))
        facts = rows.agg(*[f(c).alias(f"{n}{i}") for i, (a, b) in enumerate(spans) for n, f, c in (("below", F.count_if, x < a), ("inside", F.count_if, x.between(a, b)), ("kinds", F.approx_count_distinct, F.when(x.between(a, b), x)))]).first()
        at = {s: (facts[f"below{i}"], facts[f"inside{i}"], facts[f"kinds{i}"]) for i, s in enumerate(spans)}
        todo: dict[tuple, list[int]] = {}
        for k, s in bracket.items():
            todo.setdefault(s, []).append(k)
        deeper: dict[int, tuple[float, float]] = {}
        for (a, b), ks in todo.items():
            below, inside, kinds = at[a, b]
            within = rows.filter(x.between(a, b))
            if a == b:
                found |= {k: a for k in ks}
            elif kinds * 1.2 <= READ_OUT:
                reach, left = below, sorted(ks)
                for r in sorted(within.groupBy("x").count().collect(), key=lambda r: r["x"]):
                    reach += r["count"]
                    while left and left[0] < reach:
                        found[left.pop(0)] = r["x"]
            elif all(inside * 2 > inside_before.get(k, 2 * inside + 1) for k in ks):
                counts = cut(within.groupBy("x").agg(F.count("*").alias("n")))
                found |= {k: _by_sorting(counts, k - below) for k in ks}
            else:
                slack = 2 / ACCURACY
                place = lambda k, d: min(1.0, max(0.0, (k - below) / max(1, inside - 1) + d))
                ends = within.agg(F.percentile_approx("x", [p for k in ks for p in (place(k, -slack), place(k, slack))], ACCURACY)).first()[0]
                for i, k in enumerate(ks):
                    deeper[k], inside_before[k] = (a if place(k, -slack) == 0 else ends[2 * i], b if place(k, slack) == 1 else ends[2 * i + 1]), inside
        bracket = deeper
    return found


def quantiles(df: DataFrame, column: str, wanted: list[float]) -> list[float | None]:
    """Quantiles of a column, between two values in proportion; null without values."""
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    n = values.count()
    if not n:
        return [None] * len(wanted)
    places = [(n - 1) * q for q in wanted]
    at = select_ranks(values, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]
