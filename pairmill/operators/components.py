"""Connected components by randomised contraction.

Each round gives every node the neighbour (or itself) that comes first in a fresh
pseudo-random order, contracts the edges onto those representatives, and keeps the
mapping. The expected number of edges falls by a constant factor a round whatever the
graph's shape, so a chain of n nodes takes O(log n) rounds. Work per round is two
partial aggregations and two equi-joins; nothing is collected. A component with a large
share of all nodes is named where its nodes lie, not in one task.

Rounds are tables, not checkpoints: a checkpoint keeps the planner's estimate of its size, an
estimate of a join is the product of its sides', and so the digits of a round's estimate would
be three times those of the round before, millions after a dozen rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.operators.joins import join_hot
from pairmill.session import scratch, stored


def _rank(col, round_no: int):
    return F.struct(F.xxhash64(col, F.lit(round_no)).alias("h"), col.alias("n"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an
    edge to another node are absent; rows with a null end and self-loops are ignored."""
    half = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    base = scratch(edges.sparkSession, "components")
    live = stored(half.unionByName(half.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{base}/live-0")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        k = len(rounds)
        first = live.groupBy("u").agg(F.min(_rank(F.col("v"), k)).alias("m"))
        step = stored(first.select("u", F.least("m", _rank(F.col("u"), k))["n"].alias("r")), f"{base}/step-{k}")
        rounds.append(step)
        ends = live.join(step, "u").select(F.col("r").alias("ru"), F.col("v").alias("u")).join(step, "u")
        live = stored(ends.filter("ru <> r").select(F.col("ru").alias("u"), F.col("r").alias("v")).distinct(), f"{base}/live-{(k + 1) % 2}")
    if not rounds:
        return half.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    root = rounds[-1].select("u", "r")
    for step in reversed(rounds[:-1]):
        later = root.select(F.col("u").alias("lu"), F.col("r").alias("lr"))
        root = step.join(later, F.col("r") == F.col("lu"), "left").select("u", F.coalesce("lr", "r").alias("r"))
    root = stored(root, f"{base}/root")
    least = stored(root.groupBy("r").agg(F.min("u").alias("component"), F.count("*").alias("n")), f"{base}/least")
    return join_hot(root, least, "r", "n").select(F.col("u").alias("node"), "component")
