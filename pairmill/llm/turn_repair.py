"""Repair of conversations: the cheapest edits after which roles read `(s?(ua)+)?`.

A row of a conversation is kept (K, 0), given the other role (R, 1) or deleted (D, 2); an empty
turn is inserted (I, 5) anywhere. Blank and repeated rows must go, a cut-off row that stays costs
5 more. The automaton of legal conversations has four states (nothing yet, after `s`, after `u`,
after `a`), so a higher-order fold over the sorted turns carries four (cost, audit) structs, the
least of each state; `least` compares the cost, then the audit by bytes. Two audits of one cost
over the same rows are never one the beginning of the other (the further edits would cost
something), so the least of a state stays the least whatever follows.

Scale. Rows get a global rank by (conversation, turn, role, text), sorted by range in parallel,
and blocks of BLOCK ranks; flags come from windows inside a block and from pre-aggregated first
ranks, and a conversation's rows of one block are folded together. So a conversation of any
length is many short folds: a part that may continue an earlier one is folded from each of the
four states, and parts are then composed as the four-state tables that they are. One row per
part, not per turn, meets in a conversation's row; its audit and its repaired text are cells of
the result and grow with it. Only built-in functions are used, and a lost executor costs a reread
of the ranked rows, which are checkpointed.

Defined cases. Null role or text: one space, so blank. Null turns come first. Rows of equal turn
are in order of role, then text; repeated rows are duplicates. A null conversation id is one
conversation. The role's initial is its first character as it is; a role with another initial
than s, u, a (or one in the wrong place) must be given another role or go. An empty table: no
rows. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.operators.ranking import range_rank
from pairmill.session import cut

#: Ranks of a block: rows folded together, and texts gathered in one cell, at most.
BLOCK = 256
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
WORD, SPACE_CLASS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
_BEST = "struct<cost:bigint,audit:string>"
STATES = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space in key, role, text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("__copy")
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("__copy")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.transform(F.array(x), f)[0]


def _then(best: Column, cost: Column | int, letter: str, allowed: Column | bool = True) -> Column:
    return F.when(best.isNotNull() & F.lit(allowed), F.struct((best["cost"] + cost).cast("long").alias("cost"), F.concat(best["audit"], F.lit(letter)).alias("audit")))


def _states(*s: Column) -> Column:
    return F.struct(*[x.alias(f"s{i}") for i, x in enumerate(s)])


def _insertions(acc: Column) -> Column:
    """`acc` with the turns that may be inserted at this place: two at most are worth it."""
    s0, s1, s2, s3 = (acc[f"s{i}"] for i in STATES)
    u = F.least(s2, _then(F.least(s0, s1, s3), INSERT, "I"))
    return _let(u, lambda s2: _states(s0, s1, s2, F.least(s3, _then(s2, INSERT, "I"))))


def _turn(acc: Column, t: Column) -> Column:
    s0, s1, s2, s3 = (acc[f"s{i}"] for i in STATES)
    role, stays = t["initial"], ~t["must_go"]
    extra = F.when(t["cut_off"], CUT_OFF).otherwise(0)

    def moved(ready: Column) -> Column:
        to_u = F.least(_then(ready, extra, "K", stays & (role == "u")), _then(ready, extra + REROLE, "R", stays))
        to_a = F.least(_then(s2, extra, "K", stays & (role == "a")), _then(s2, extra + REROLE, "R", stays))
        gone = [_then(s, DELETE, "D") for s in (s0, s1, s2, s3)]
        to_s = _then(s0, extra, "K", stays & (role == "s"))
        return _states(gone[0], F.least(gone[1], to_s), F.least(gone[2], to_u), F.least(gone[3], to_a))

    return _let(_let(F.least(s0, s1, s3), moved), _insertions)


def _fold(turns: Column, start: Column) -> Column:
    none, zero = F.lit(None).cast(_BEST), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).cast(_BEST)
    first = _let(_states(*[F.when(start == i, zero).otherwise(none) for i in STATES]), _insertions)
    return F.aggregate(turns, first, _turn)


def _compose(acc: Column, part: Column) -> Column:
    """The bests after a part, whose tables say what it makes of each state before it."""
    after = []
    for j in STATES:
        ways = []
        for i in STATES:
            x, y = acc[f"s{i}"], F.get(part["tables"], F.lit(i))[f"s{j}"]
            ways.append(F.when(x.isNotNull() & y.isNotNull(), F.struct((x["cost"] + y["cost"]).alias("cost"), F.concat(x["audit"], y["audit"]).alias("audit"))))
        after.append(F.least(*ways))
    return _states(*after)


def _flagged(ranked: DataFrame) -> DataFrame:
    """(conv_id, block, rank, turn, initial, fault, new_turn, illegal) of ranked rows; the last
    two compare a row with the one before it in its block."""
    digest = F.unhex(F.sha2(F.col("text"), 256))
    first = ranked.groupBy("conv_id", "role", digest.alias("d")).agg(F.min("rank").alias("rank")).select("rank", F.lit(False).alias("seen"))
    blank = ~F.col("text").rlike(WORD)
    whole = F.col("text").rlike(rf"[.!?]{SPACE_CLASS}*\z")
    rows = ranked.select("conv_id", "block", "rank", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), whole.alias("whole"))
    fault = F.when(F.col("blank"), "blank").when(F.coalesce("seen", F.lit(True)), "duplicate").when(~F.col("whole"), "truncated")
    rows = rows.join(first, "rank", "left").withColumn("fault", fault).drop("blank", "whole", "seen")
    w = Window.partitionBy("block").orderBy("rank")
    same = F.lag(F.lit(True)).over(w).isNotNull() & F.lag("conv_id").over(w).eqNullSafe(F.col("conv_id"))
    pair = F.concat(F.lag("initial").over(w), F.col("initial"))
    new_turn = F.col("turn").isNotNull() & ~(same & F.lag("turn").over(w).eqNullSafe(F.col("turn")))
    return rows.select("*", new_turn.alias("new_turn"), (same & ~pair.isin("su", "ua", "au")).alias("illegal"))


def _parts(flagged: DataFrame) -> DataFrame:
    """A row for each conversation and block, its turns folded."""
    turn = F.struct("rank", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), (F.col("fault").eqNullSafe("truncated")).alias("cut_off"))
    edge = F.struct("turn", "initial")
    n = lambda c, name: F.count_if(c).alias(name)
    grouped = flagged.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.min_by(edge, "rank").alias("first"), F.max_by(edge, "rank").alias("last"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        n(F.col("new_turn"), "turns_met"), n(F.col("illegal"), "illegal"), *[n(F.col("fault") == f, f) for f in ("blank", "duplicate", "truncated")],
    )
    opens = F.col("turns")[0]["rank"] % BLOCK == 0
    starts = F.when(opens, F.array(*map(F.lit, STATES))).otherwise(F.array(F.lit(0)))
    return grouped.withColumn("tables", F.transform(starts, lambda s: _fold(F.col("turns"), s))).withColumn("n", F.size("turns")).drop("turns")


def _whole(parts: DataFrame) -> DataFrame:
    """A row for each conversation: its facts, cost and audit, and its parts (block, n)."""
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns_met")]
    part = F.struct("block", "n", "first", "last", "tables")
    rows = parts.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(part)).alias("parts"))
    none, zero = F.lit(None).cast(_BEST), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).cast(_BEST)
    ends = F.aggregate("parts", _states(zero, none, none, none), _compose)
    best = _let(ends, lambda e: F.least(e["s0"], e["s3"]))
    # what the windows of blocks couldn't see: a part's first row beside the last of the part before
    before, after = F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts"))
    pairs = F.zip_with(before, after, lambda x, y: F.struct(x["last"].alias("x"), y["first"].alias("y")))
    split = F.size(F.filter(pairs, lambda p: p["x"]["turn"] == p["y"]["turn"]))
    illegal = F.size(F.filter(pairs, lambda p: ~F.concat(p["x"]["initial"], p["y"]["initial"]).isin("su", "ua", "au")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns_met") - split), F.lit(0))
    slim = F.transform("parts", lambda p: F.struct(p["block"].alias("block"), p["n"].alias("n")))
    facts = rows.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + illegal).alias("illegal"), best.alias("best"), slim.alias("parts"))
    return facts.select("*", "best.cost", "best.audit").drop("best")


def _repaired(whole: DataFrame, ranked: DataFrame) -> DataFrame:
    """(conv_id, repaired): `role:text` lines of what the audit keeps, gives a role and inserts."""
    out = F.length(F.translate("audit", "D", ""))
    edits = whole.select("conv_id", "parts", F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0)).alias("edits"), F.regexp_extract("audit", "I*$", 0).alias("tail"), (out % 2).alias("systems"))

    def place(acc: Column, p: Column) -> Column:
        own = F.slice(acc["left"], F.lit(1), p["n"])
        entry = F.struct(p["block"].alias("block"), own.alias("edits"), acc["outs"].alias("outs"))
        made = F.length(F.translate(F.array_join(own, ""), "D", ""))
        rest = F.slice(acc["left"], p["n"] + 1, F.greatest(F.size(acc["left"]), F.lit(1)))
        return F.struct(rest.alias("left"), (acc["outs"] + made).alias("outs"), F.concat(acc["placed"], F.array(entry)).alias("placed"))

    first = F.struct(F.col("edits").alias("left"), F.lit(0).alias("outs"), F.array().cast("array<struct<block:bigint,edits:array<string>,outs:int>>").alias("placed"))
    placed = edits.select("conv_id", "tail", "systems", F.posexplode(F.aggregate("parts", first, place)["placed"]).alias("i", "p"), F.size("parts").alias("k"))
    plan = placed.select("conv_id", F.col("p.block").alias("block"), "p.edits", "p.outs", "systems", F.when(F.col("i") == F.col("k") - 1, F.col("tail")).otherwise("").alias("tail"))
    lines = ranked.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("lines"))
    plan, lines = plan.withColumnRenamed("conv_id", "cid").withColumnRenamed("block", "b"), lines
    met = plan.join(lines, F.col("cid").eqNullSafe(F.col("conv_id")) & (F.col("b") == F.col("block")))
    line = "array<struct<edit:string,role:string,text:string>>"
    new = lambda n: F.array_repeat(F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")), n)
    own = lambda x, e: F.concat(new(F.length(e) - 1), F.array(F.struct(F.substring(e, -1, 1).alias("edit"), x["role"].alias("role"), x["text"].alias("text")))).cast(line)
    stay = F.filter(F.concat(F.flatten(F.zip_with("lines", "edits", own)), new(F.length("tail")).cast(line)), lambda x: x["edit"] != "D")

    def written(x: Column, i: Column) -> Column:
        place = F.col("outs") + i - F.col("systems")
        role = F.when(x["edit"] == "K", x["role"]).when(F.pmod(place, F.lit(2)) == 0, "user").otherwise("assistant")
        return F.concat(role, F.lit(":"), x["text"])

    texts = met.select("conv_id", "block", F.transform(stay, written).alias("out"))
    joined = texts.filter(F.size("out") > 0).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", F.array_join("out", "\n").alias("x")))).alias("xs"))
    return joined.select(F.col("conv_id").alias("cid"), F.array_join(F.col("xs.x"), "\n").alias("repaired"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), a row for each
    conversation of `rows` (conv_id, turn, role, text)."""
    space = F.lit(" ")
    turns = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    ranked = range_rank(turns, "conv_id", "turn", "role", "text").withColumn("block", F.floor(F.col("rank") / BLOCK))
    whole = cut(_whole(_parts(_flagged(ranked))))
    texts = _repaired(whole, ranked)
    full = whole.join(texts, F.col("conv_id").eqNullSafe(F.col("cid")), "left").withColumn("repaired", F.coalesce("repaired", F.lit("")))
    return full.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def repair_report(rows: DataFrame, original: DataFrame) -> DataFrame:
    """`repair(rows)` for each conversation of `original`, with the sha256 of the repaired text;
    one without rows has zeros, an empty audit and the empty text."""
    found = repair(rows)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = original.select(F.col("conv_id").alias("__id")).distinct()
    both = ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts]
    return both.select(F.col("__id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
