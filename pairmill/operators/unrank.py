"""Distinct pairs drawn uniformly from a whole space of pairs that is never made.

The k (k - 1) / 2 pairs of each group are numbered, group behind group. A keyed permutation of
the numbers (a Feistel network, a power of two wide) is asked for its first values; those below
the number of pairs, at least half, are pair numbers without repetition, and arithmetic turns a
number into its two members. Drawing all numbers gives each pair once, whatever the size of a
group, and a draw costs the same in a group of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.operators.ranking import range_rank

ROUNDS = 4


def widths(space: int) -> tuple[int, int]:
    """Bits of the two halves of the numbers that are permuted."""
    bits = max(2, (max(1, space) - 1).bit_length())
    return bits - bits // 2, bits // 2


def permuted(t: Column, space: int, seed: str) -> Column:
    """The place of t, 0 <= t < 2 ** bits, in a permutation of these numbers."""
    a, b = widths(space)
    left, right = F.shiftright(t, b), t.bitwiseAND(F.lit((1 << b) - 1))
    for i in range(ROUNDS):
        mixed = lambda x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(i)), x.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")  # noqa: E731, B023
        if i % 2:
            right = right.bitwiseXOR(mixed(left).bitwiseAND(F.lit((1 << b) - 1)))
        else:
            left = left.bitwiseXOR(mixed(right).bitwiseAND(F.lit((1 << a) - 1)))
    return F.shiftleft(left, b) + right


def members(number: Column) -> tuple[Column, Column]:
    """(i, j), i < j, of the pair with a number in the order (0, 1), (0, 2), (1, 2), (0, 3)..."""
    near = F.floor((F.sqrt(8.0 * number + 1) + 1) / 2)
    whole = lambda j: (j * (j - 1)).cast("long")
    j = F.when(whole(near) > 2 * number, near - 1).when(whole(near + 1) <= 2 * number, near + 1).otherwise(near)
    return (number - F.shiftright(whole(j), 1)).alias("i"), j.alias("j")


def draw(groups: DataFrame, wanted: int, seed: str) -> DataFrame:
    """(t, first, i, j): pairs of members i < j (0-based) of the groups (first, n) in which they
    stand, `first` naming a group; about `wanted` of them, and all if `wanted` is the number of
    pairs or more. t is a pair's place in the draw: a shorter draw is the beginning of a longer."""
    sized = groups.filter("n > 1").select("first", "n", F.expr("n * (n - 1) div 2").alias("pairs"))
    spans = range_rank(sized, "first", out="g")
    total = sized.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
    space, count = int(total[0]), int(total[1])
    spark = groups.sparkSession
    a, b = widths(space)
    most = 1 << (a + b)
    t = spark.range(min(most, -(-max(0, wanted) * most // space)) if space else 0).select(F.col("id").alias("t"))
    numbers = t.withColumn("m", permuted(F.col("t"), space, seed)).filter(F.col("m") < space)
    # groups lie side by side in the numbers; a block of numbers meets those that reach into it
    width = max(1, -(-space // max(1, count)))
    starts = _starts(spans)
    blocks = starts.withColumn("block", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + pairs - 1) div {width}"))))
    met = numbers.withColumn("block", F.expr(f"m div {width}")).join(blocks, "block").filter((F.col("m") >= F.col("start")) & (F.col("m") < F.col("start") + F.col("pairs")))
    return met.select("t", "first", *members(F.col("m") - F.col("start")))


def _starts(spans: DataFrame) -> DataFrame:
    """(first, pairs, start): running sums over ranked groups, by blocks of ranks."""
    block = F.expr("g div 4096")
    sums = spans.groupBy(block.alias("b")).agg(F.sum("pairs").alias("s"))
    base = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("pairs").over(Window.partitionBy("b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("b", block).withColumn("own", inner).join(base, "b").select("first", "pairs", (F.col("base") + F.col("own")).alias("start"))


def permuted_sql(t: str, seed: str) -> str:
    """The same permutation in SQL over a table `par` (space, a, b); gives (t, m)."""
    step = f"SELECT t, t >> b AS l, t & ((1::BIGINT << b) - 1) AS r, a, b, space FROM ({t}), par"
    for i in range(ROUNDS):
        own, other, bits = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        mixed = f"xor({own}, ('0x' || left(md5('{seed}:{i}:' || {other}), 15))::BIGINT & ((1::BIGINT << {bits}) - 1)) AS {own}"
        step = f"SELECT t, {mixed}, {other}, a, b, space FROM ({step})"
    return f"SELECT t, (l << b) + r AS m FROM ({step}) WHERE (l << b) + r < space"
