"""Confusion counts, F1 scores, paired comparisons and the paired cluster bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.operators.ranking import global_rank

CLASSES = 4


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, p, n), only cells with rows."""
    return df.groupBy(*keys, "y", "p").agg(F.count("*").alias("n"))


def dense(cells: DataFrame) -> DataFrame:
    """All 16 cells of an ungrouped confusion table."""
    grid = cells.sparkSession.range(CLASSES * CLASSES).selectExpr("cast(id div 4 as int) as y", "cast(id % 4 as int) as p")
    return grid.join(cells, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_f1(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, support, predicted, hits, f1); f1 is 0 without support and predictions."""
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")))).alias("x"))
    sums = sides.groupBy(*keys, "x.label").agg(F.sum("x.s").alias("support"), F.sum("x.q").alias("predicted"), F.sum("x.h").alias("hits"))
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return sums.withColumn("f1", f1)


def macro_f1(cells: DataFrame, *keys: str) -> DataFrame:
    """Mean F1 over the four classes (an absent class counts 0) and over those with support."""
    return class_f1(cells, *keys).groupBy(*keys).agg(
        (F.sum("f1") / CLASSES).alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("active_macro_f1"), F.sum("support").alias("n")
    )


def transitions(df: DataFrame, *keys: str) -> DataFrame:
    """From (y, p_a, p_b): how predictions change from a to b."""
    a, b = F.col("p_a") == F.col("y"), F.col("p_b") == F.col("y")
    corrected, broken = F.count_if(~a & b), F.count_if(a & ~b)
    return df.groupBy(*keys).agg(
        F.count_if(F.col("p_a") != F.col("p_b")).alias("changed"), corrected.alias("corrected"), broken.alias("broken"), F.count_if(~a & ~b).alias("both_wrong"), (corrected - broken).alias("net")
    )


def cluster_bootstrap(grouped: DataFrame, draws: int, seed: str = "bootstrap") -> DataFrame:
    """(model, draw, macro_f1) from per-group cells (model, group_id, y, p, n).

    A draw takes as many groups as there are, with replacement: slot s of draw d takes the
    group numbered hash(seed, d, s) modulo their number, so all models share a draw, reruns
    agree. A group's cells are one row before they meet the slots, with a column for each cell
    that occurs (classes squared per model at most), so a slot is shuffled once and adds one row.
    """
    spark = grouped.sparkSession
    groups = global_rank(grouped.select("group_id").distinct().withColumn("h", F.md5(F.col("group_id").cast("binary"))), "h", "group_id", "g")
    count = groups.count()
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "slot").cast("binary")), 1, 12), 16, 10).cast("long") % max(1, count) + 1
    slots = spark.range(draws * count).selectExpr(f"id div {max(1, count)} as draw", f"id % {max(1, count)} as slot")
    found = grouped.select("model", "y", "p").distinct().collect()
    if not found:
        return macro_f1(grouped.withColumn("draw", F.lit(0).cast("long")), "model", "draw").select("model", "draw", "macro_f1")
    of = lambda c: F.when(F.col("model").eqNullSafe(c["model"]) & F.col("y").eqNullSafe(c["y"]) & F.col("p").eqNullSafe(c["p"]), F.col("n"))
    wide = grouped.groupBy("group_id").agg(*[F.coalesce(F.sum(of(c)), F.lit(0)).alias(f"n{i}") for i, c in enumerate(found)])
    drawn = slots.select("draw", place.alias("g")).join(groups.select("g", "group_id").join(wide, "group_id").drop("group_id"), "g")
    sums = drawn.groupBy("draw").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(found))])
    kinds = {c: grouped.schema[c].dataType for c in ("model", "y", "p")}
    row = lambda i, c: F.struct(*[F.lit(c[k]).cast(t).alias(k) for k, t in kinds.items()], F.col(f"n{i}").alias("n"))
    cells = sums.select("draw", F.explode(F.array(*[row(i, c) for i, c in enumerate(found)])).alias("c")).select("draw", "c.*").filter("n > 0")
    return macro_f1(cells, "model", "draw").select("model", "draw", "macro_f1")


#: Groups of a block, and draws whose weights a task holds at once.
BLOCK, DRAWS_AT_ONCE = 1024, 1000


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.sha256(repr(key).encode()).digest()))


def block_weights(seed: str, draws: int, groups: int, block: int, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Of a block of groups, how often each draw takes each: arrays (some draws, groups of the
    block), in order of the draws. A draw's `groups` choices are split in two, binomially, between
    the halves of the blocks, and so on down to the block, then over its groups; each split is
    seeded by the blocks it is about, so all tasks agree without a message between them."""
    low, high, n = 0, -(-groups // size), np.full(draws, groups, dtype=np.int64)
    held = lambda a, b: min(groups, b * size) - a * size  # noqa: E731  groups in blocks a to b
    while high - low > 1:
        middle = (low + high) // 2
        left = _rng(seed, low, high).binomial(n, held(low, middle) / held(low, high))
        low, high, n = (low, middle, left) if block < middle else (middle, high, n - left)
    own, rng = held(block, block + 1), _rng(seed, "block", block)
    for i in range(0, draws, DRAWS_AT_ONCE):
        yield rng.multinomial(n[i : i + DRAWS_AT_ONCE], np.full(own, 1 / own))


def split_bootstrap(grouped: DataFrame, draws: int, seed: str = "bootstrap") -> DataFrame:
    """(model, draw, macro_f1) from per-group cells (model, group_id, y, p, n), by the law of
    `cluster_bootstrap` and for any number of groups: a draw takes as many groups as there are,
    with replacement, and all models share it. The work is a product of weights and cells per
    block of groups; a task adds its blocks up and gives one row per draw and cell, whatever the
    number of groups."""
    groups = global_rank(grouped.select("group_id").distinct().withColumn("h", F.md5(F.col("group_id").cast("binary"))), "h", "group_id", "g")
    count = groups.count()
    models = sorted(r["model"] for r in grouped.select("model").distinct().collect())
    width = CLASSES**2
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model")) - 1
    cell = place * width + F.col("y") * CLASSES + F.col("p")
    keyed = grouped.join(groups.select("group_id", (F.col("g") - 1).alias("g")), "group_id").select(F.expr(f"g div {BLOCK}").alias("block"), "g", cell.cast("long").alias("cell"), F.col("n").cast("double").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(models) * width))
        some, rows, at = False, [], None

        def add() -> None:
            block, g, c, n = (np.concatenate(x) for x in zip(*rows))
            cells = np.zeros((min(BLOCK, count - int(block[0]) * BLOCK), total.shape[1]))
            np.add.at(cells, (g - block[0] * BLOCK, c), n)
            done = 0
            for w in block_weights(seed, draws, count, int(block[0])):
                total[done : done + len(w)] += w @ cells
                done += len(w)

        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(4)]
            edges = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    if at is not None and columns[0][i] != at:
                        add()
                        rows = []
                    at, some = columns[0][i], True
                    rows.append([x[i:j] for x in columns])
        if some:
            add()
            d, c = np.nonzero(total)
            yield pa.record_batch([pa.array(d), pa.array(c), pa.array(total[d, c])], names=["draw", "cell", "n"])

    parts = keyed.repartition("block").sortWithinPartitions("block").mapInArrow(run, "draw long, cell long, n double")
    name = F.element_at(F.array(*map(F.lit, models)), (F.expr(f"cell div {width}") + 1).cast("int"))
    cells = parts.groupBy("draw", "cell").agg(F.sum("n").cast("long").alias("n"))
    named = cells.select("draw", name.alias("model"), F.expr(f"cell % {width} div {CLASSES}").alias("y"), F.expr(f"cell % {CLASSES}").alias("p"), "n")
    return macro_f1(named, "model", "draw").select("model", "draw", "macro_f1")


def interval(draws: DataFrame, a: str, b: str) -> DataFrame:
    """2.5 and 97.5 percentiles of b - a over shared draws."""
    both = draws.groupBy("draw").agg(F.max(F.when(F.col("model") == b, F.col("macro_f1"))).alias("vb"), F.max(F.when(F.col("model") == a, F.col("macro_f1"))).alias("va"))
    d = both.select((F.col("vb") - F.col("va")).alias("d"))
    return d.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg("d").alias("mean"))
