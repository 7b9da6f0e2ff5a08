"""Mixing sources to target weights by a low-discrepancy schedule.

The mix takes SHARE of all words. Targets follow the weights, with at most EPOCHS passes
over a source; what a source can't give is reshared by weight. The mix is a sequence of
slots of `block` words: slot t maps the golden-ratio point frac(t * phi) through the
cumulative target shares to a source, so every stretch of the mix is near its shares; the
slots of a source are ranked, and rank r takes the r-th block of the source's shuffled
(hash-ordered) word stream, which starts anew when it ends. A source's slots stop at its
target (the last block is cut there); the few blocks that the schedule's discrepancy
leaves open follow at its end. So a source's words equal its target rounded down, and the
mixed documents come in the order of their slots: the one that takes a pass's first words.

Scale. Ranks and word offsets are prefix sums in two levels (sums per bucket, then within
a bucket), so a source with a third of all rows is never one task. Equal rows are one row
with a count first. The block grows with the corpus, so there are at most about SLOTS slots;
documents meet blocks in an equi-join on (source, block), slots meet sources in one on
ranges of points. Sums over sources are the only single-task windows: their size is the
number of sources, not of documents.

Defined cases. Null text has size 0 and is never taken. Null source is a source of its
own, last in order. Null ids are ids like others. Repeated rows are separate documents that
follow each other in the stream. No rows: no rows. No words at all: all targets and amounts
are 0. Very long texts: a row meets as many blocks as it fills. Columns with any other names,
also those used here, pass through `mix`. Order within a source: xxhash64 of id and text,
then id, so reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.quality_rules import words_of
from pairmill.operators.joins import join_hot
from pairmill.operators.ranking import range_rank
from pairmill.session import cut

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2
EPOCHS = 2
#: Most slots of the schedule, about; the block is at least MIN_BLOCK words.
SLOTS, MIN_BLOCK = 1 << 20, 64
#: floor(2^32 / golden ratio), odd: multiples modulo 2^32 are the golden-ratio sequence.
GOLDEN = 2654435769
#: Buckets of the hash order per source for prefix sums; slots per bucket of the schedule.
BUCKETS, SLOT_BUCKET = 4096, 16_384
#: Ranges of points by which slots meet sources.
RANGES = 1 << 14


def _prefix(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """`out`: sum of `value` over the rows of the same keys that come before, in two levels."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(base, [*keys, bucket]).withColumn(out, F.col("__base") + F.col("__local")).drop("__base", "__local")


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source, source_size, target) from (source, size): src numbers the sources by
    code point, null last. Resharing until none is above its cap has one fixed point:
    min(cap, level * weight) with the level at which the targets sum to the total. Sources
    in order of cap / weight are capped up to some place, and the rest share what is left."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap, weight = F.col("source_size") * EPOCHS, F.col("weight")
    ranked = (
        per.withColumn("src", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS)) + 1))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * SHARE_NUM / SHARE_DEN)
    )
    tight = Window.orderBy((cap / weight).asc(), "src")
    level = (
        ranked.withColumn("caps", F.coalesce(F.sum(cap).over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("weights"))
        # the first source that isn't capped sets the level
        .withColumn("open", F.col("level") * weight <= cap)
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(Window.orderBy((cap / weight).asc(), "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return level.select("src", "source", "source_size", F.round(F.least(cap.cast("double"), F.col("level") * weight), 4).alias("target"))


def _schedule(goals: DataFrame, block: int) -> DataFrame:
    """(src, rank, slot) for every block that is taken, by the golden-ratio schedule."""
    need = goals.withColumn("need", F.ceil(F.floor("target") / block).cast("long"))
    by_src = Window.orderBy("src")
    edges = need.withColumn("hi", F.sum("target").over(by_src)).withColumn("all", F.sum("target").over(Window.partitionBy()))
    edges = edges.filter("target > 0").select("src", "need", F.floor((F.col("hi") - F.col("target")) / F.col("all") * 2**32).alias("lo"))
    # cumulative weights as a step function: source `src` has the points from lo up to the next source's
    spans = edges.withColumn("hi", F.coalesce(F.lead("lo").over(by_src), F.lit(1 << 32))).filter("lo < hi")
    width = (1 << 32) // RANGES
    ranged = spans.withColumn("range", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    slots_needed = need.agg(F.sum("need").alias("n")).first()["n"] or 0
    # t * GOLDEN mod 2^32 in steps that stay below 2^63
    point = F.expr(f"(((id div 65536) * {GOLDEN} % 4294967296) * 65536 + (id % 65536) * {GOLDEN}) % 4294967296")
    slots = goals.sparkSession.range(slots_needed).select(F.col("id").alias("slot"), point.alias("x"), F.expr(f"id div {SLOT_BUCKET}").alias("slot_bucket"))
    placed = slots.withColumn("range", F.expr(f"x div {width}")).join(ranged, "range").filter("lo <= x and x < hi").select("src", "need", "slot", "slot_bucket")
    ranked = _prefix(placed.withColumn("one", F.lit(1).cast("long")), ["src"], "slot_bucket", ["slot"], "one", "rank")
    used = ranked.filter("rank < need").select("src", "rank", "slot")
    have = placed.groupBy("src").agg(F.count("*").alias("have"))
    rest = need.join(have, "src", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
    late = rest.select("src", F.explode(F.sequence(F.col("have").cast("long"), F.col("need") - 1)).alias("rank"))
    return used.unionByName(late.withColumn("slot", F.col("rank") + F.lit(slots_needed)))


def _key(doc_id: Column, source: Column, h: Column) -> Column:
    """Equal for rows with equal id, source and text; a null is like another null."""
    part = lambda c: (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))
    (a, b), (c, d) = part(doc_id), part(source)
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), h.alias("h"))


_PASSES = [f"pass_{e}" for e in range(EPOCHS)]


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    size = F.greatest(F.lit(0), F.coalesce(F.size(words_of(text)), F.lit(0))).cast("long")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), text).alias("h"))
    return cut(plain.withColumn("key", _key(F.col("doc_id"), F.col("source"), F.col("h"))))


def _groups(rows: DataFrame) -> DataFrame:
    """(key, doc_id, source, size, h, copies, source_size, target, pass_0 .., slot_0 .., last_0 ..): a row
    for equal rows, with the words that all of them give in each pass, the slot that takes the
    first of these and the last slot that takes any."""
    goals = cut(targets(rows))
    total = goals.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    block = max(MIN_BLOCK, -int(-total // SLOTS))
    counted = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "h")], F.count("*").alias("copies"))
    named = counted.join(goals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # rows of size 0 take no place in the stream
    real = named.filter("size > 0").withColumns({"bucket": F.pmod("h", F.lit(BUCKETS)), "span": F.col("size") * F.col("copies")})
    placed = cut(_prefix(real, ["src"], "bucket", ["h", "doc_id"], "span", "start"))
    passes = placed.select("src", "start", "span", "source_size", "target", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])).alias("epoch"))
    passes = passes.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("b", F.col("a") + F.col("span")).filter("a < floor(target)")
    pieces = passes.withColumn("rank", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")))
    met = pieces.join(_schedule(goals, block), ["src", "rank"])
    end = F.least(F.col("b"), (F.col("rank") + 1) * block, F.floor("target"))
    got = met.withColumn("got", F.greatest(F.lit(0), end - F.greatest(F.col("a"), F.col("rank") * block))).filter("got > 0")
    of = lambda e, c: F.when(F.col("epoch") == e, F.col(c))
    sums = [f(e) for e in range(EPOCHS) for f in (lambda e: F.sum(of(e, "got")).alias(f"pass_{e}"), lambda e: F.min_by("slot", of(e, "rank")).alias(f"slot_{e}"), lambda e: F.max(of(e, "slot")).alias(f"last_{e}"))]
    per = got.groupBy("src", "start").agg(*sums)
    taken = placed.join(per, ["src", "start"], "left").drop("src", "start", "bucket", "span", "weight")
    none = named.filter("size = 0")
    return taken.unionByName(none.drop("src"), allowMissingColumns=True).fillna(0, _PASSES)


#: Whether some of equal rows give words in a pass and others don't, or not all of theirs.
_SPLIT = " or ".join(f"(pass_{e} > 0 and pass_{e} < size * copies)" for e in range(EPOCHS))


def _each(group: str, j: Column | None = None) -> list[Column]:
    """A row's words in each pass: alike among equal rows, or those of the j-th, as equal rows
    give their words one after the other."""
    at = lambda c: F.col(f"{group}{c}")
    if j is None:
        return [F.expr(f"{group}pass_{e} div {group}copies") for e in range(EPOCHS)]
    return [F.greatest(F.lit(0), F.least(at("size"), at(f"pass_{e}") - j * at("size"))) for e in range(EPOCHS)]


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with `__j`, a number from 0 on among those of equal key, without a task for a key."""
    ranked = cut(range_rank(rows.withColumn("__rid", F.monotonically_increasing_id()), key, "__rid", out="__rank"))
    first = cut(ranked.groupBy(key).agg(F.min("__rank").alias("__first"), F.count("*").alias("__n")))
    return cut(join_hot(ranked, first, key, "__n").withColumn("__j", F.col("__rank") - F.col("__first")).drop("__rank", "__first", "__rid"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, h, pass_0 .., taken): a row for each input row
    with the words that each pass takes of it."""
    rows = _rows(docs, id_col, text_col, source_col)
    groups = cut(_groups(rows))
    plain = ["doc_id", "source", "size", "source_size", "target", "h"]
    words = lambda *j: [c.alias(p) for c, p in zip(_each("", *j), _PASSES)]
    out = groups.filter("copies = 1").select(*plain, *words())
    many = groups.filter("copies > 1").withColumn("n", F.col("copies"))
    if not many.isEmpty():
        own = rows.select("key")
        out = out.unionByName(join_hot(own, cut(many.filter(f"not ({_SPLIT})")), "key", "n").select(*plain, *words()))
        split = cut(many.filter(_SPLIT))
        if not split.isEmpty():
            numbered = _numbered(own.join(split.select("key"), "key", "left_semi"), "key")
            out = out.unionByName(join_hot(numbered, split, "key", "n").select(*plain, *words(F.col("__j"))))
    return out.withColumn("taken", sum((F.col(p) for p in _PASSES[1:]), F.col(_PASSES[0])))


def mix_report(docs: DataFrame, **cols: str) -> DataFrame:
    return plan_mix(docs, **cols).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None) -> DataFrame:
    """The mixed documents in the order of their slots, partition after partition, in the columns
    of the input (and the slot, if `slot_col` names a column for it): a row for each pass that
    takes words of a document, with those words (the whole text if all are taken). Rows that
    are equal in id, source and text share the slots of their words by chance."""
    groups = _groups(_rows(docs, id_col, text_col, source_col)).filter(" or ".join(f"{p} > 0" for p in _PASSES))
    facts = ["size", "copies", "h", *_PASSES, *[f"{c}_{e}" for c in ("slot", "last") for e in range(EPOCHS)]]
    groups = cut(groups.select(F.col("key").alias("__mix_key"), F.expr(_SPLIT).alias("__mix_split"), F.struct(*facts).alias("__mix"), F.col("copies").alias("__mix_n")))
    keyed = docs.withColumn("__mix_key", _key(F.col(id_col), F.col(source_col), F.xxhash64(F.col(id_col), F.col(text_col))))
    text, split = F.col(text_col), groups.filter("__mix_split")
    last = groups.agg(F.max(F.greatest(*[F.col(f"__mix.last_{e}") for e in range(EPOCHS)])).alias("s")).first()["s"] or 0

    def passes(rows: DataFrame, j: Column | None = None) -> DataFrame:
        g = lambda c: F.col(f"__mix.{c}")
        by_chance = lambda e: g(f"slot_{e}") + F.pmod(F.xxhash64("__mix_rid"), g(f"last_{e}") - g(f"slot_{e}") + 1)
        slots = [F.when(g("copies") == 1, g(f"slot_{e}")).otherwise(by_chance(e)) for e in range(EPOCHS)]
        each = F.array(*[F.struct(n.alias("n"), s.alias("slot")) for n, s in zip(_each("__mix.", j), slots)])
        given = rows.withColumn("__mix_rid", F.monotonically_increasing_id()).withColumn("__mix_p", F.explode(each)).filter("__mix_p.n > 0")
        some = F.array_join(F.slice(words_of(text), 1, F.col("__mix_p.n").cast("int")), " ")
        taken = given.withColumn(text_col, F.when(F.col("__mix_p.n") < g("size"), some).otherwise(text))
        return taken.select(*docs.columns, F.col("__mix_p.slot").alias("__mix_slot"), g("h").alias("__mix_h"))

    if split.isEmpty():
        out = passes(join_hot(keyed, groups.drop("__mix_split"), "__mix_key", "__mix_n"))
    else:
        out = passes(join_hot(keyed, cut(groups.filter("not __mix_split").drop("__mix_split")), "__mix_key", "__mix_n"))
        split = cut(split.drop("__mix_split"))
        out = out.unionByName(passes(join_hot(_numbered(keyed.join(split.select("__mix_key"), "__mix_key", "left_semi"), "__mix_key"), split, "__mix_key", "__mix_n"), F.col("__j")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = out.repartitionById(parts, F.expr(f"cast(__mix_slot * {parts} div {last + 1} as int)")).sortWithinPartitions("__mix_slot", "__mix_h")
    return ordered.select(*docs.columns, *([F.col("__mix_slot").alias(slot_col)] if slot_col else []))
