"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within RADIUS = 3 bits are linked. Links are found in two steps, both of
which emit variants within half the radius and shuffle on the variants:

1. Screen. Of the two 32-bit halves of a linked pair, one differs in at most half the
   radius (1 bit). Every distinct fingerprint emits, for each half, its variants within
   1 bit (a half of even parity emits its 32 neighbours, one of odd parity itself, so a
   pair that differs in 1 bit meets exactly there), each with a block of the other half
   that such a pair must share: a third if the half differs, a quarter if not. That is
   107 keys of 40 to 43 bits on average; only fingerprints whose key holds another
   fingerprint go on.
2. Ball. The survivors emit whole 64-bit variants of odd parity: even fingerprints those
   1 bit away (64), odd ones themselves and those 2 bits away (2017). All pairs within 3
   bits meet. Around one variant, every even fingerprint is linked to all others there,
   and so is the variant itself if it is a fingerprint; so one of those serves as the
   centre of a star, and no pairs within a group are made. A group without such a centre
   holds only odd fingerprints that may be 4 bits apart; their links show up at other
   variants. Distance <= 3 of every star edge is verified.

A variant's group holds distinct fingerprints only, so at most 2081 rows whatever the
number of copies. Fingerprints and components with a large share of all rows get their names
by a broadcast of at most joins.HOT_SHARE rows. Nothing is collected; lineage is cut by
checkpoints in the shared folder.

Defined cases. Null, empty and blank texts have fingerprint 0 and link like any other.
Fewer than three words: the whole sequence is the one shingle. Very long texts are read
whole, their shingles' bits counted in blocks. Repeated rows have the same component; rows of
one id with different texts may have different ones. A null id is never a component's name
unless all ids of the component are null. No rows: no rows. Other columns, whatever their
names, pass through `dedup`, which keeps one row of each component: that with the smallest
id, of these the one whose text comes first by hash, a null id last; of rows with equal id
and text any one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pairmill.llm.units import bounded_batches
from pairmill.operators.components import connected_components
from pairmill.operators.joins import join_hot
from pairmill.session import cut

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 65_536


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of ASCII-lower-cased word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    digests = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])
    bits = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(bits[i : i + BLOCK], axis=1).sum(0, dtype=np.int64) for i in range(0, len(bits), BLOCK))
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


#: Per half: its bits, the other half's bits.
_HALVES = (("shiftrightunsigned(fp, 32)", "fp & 4294967295L"), ("fp & 4294967295L", "shiftrightunsigned(fp, 32)"))


def _screen_keys() -> str:
    """SQL for the array of a fingerprint's screening keys: tag, variant of a half, block of the other."""
    parts, tag = [], 0
    for x, y in _HALVES:
        flips = f"if(bit_count({x}) % 2 = 1, array({x}), transform(sequence(0, 31), i -> ({x}) ^ shiftleft(1L, i)))"
        for shift, bits in ((0, 11), (11, 11), (22, 10)):
            block = f"(shiftrightunsigned({y}, {shift}) & {2**bits - 1}L)"
            parts.append(f"transform({flips}, z -> shiftleft({tag}L, 44) | shiftleft(z, 11) | {block})")
            tag += 1
        for shift in (0, 8, 16, 24):
            parts.append(f"array(shiftleft({tag}L, 44) | shiftleft({x}, 11) | (shiftrightunsigned({y}, {shift}) & 255L))")
            tag += 1
    return f"concat({', '.join(parts)})"


_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_TWO = np.concatenate([[np.uint64(0)], *(_ONE[i] | _ONE[i + 1 :] for i in range(63))]).astype(np.uint64)


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, fp, even): variants of odd parity within half the radius, rounded down for
    even fingerprints and up for odd ones."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        odd = np.bitwise_count(fps) % 2 == 1
        for mine, masks, even in ((fps[~odd], _ONE, True), (fps[odd], _TWO, False)):
            step = max(1, 500_000 // len(masks))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                yield pa.record_batch(
                    {
                        "variant": (part[:, None] ^ masks).ravel().view(np.int64),
                        "fp": np.repeat(part, len(masks)).view(np.int64),
                        "even": np.full(len(part) * len(masks), even),
                    }
                )


def links(fps: DataFrame) -> DataFrame:
    """Star edges (src, dst) that connect exactly what links within RADIUS bits connect.
    `fps` has distinct, non-null fingerprints in column fp."""
    # a table of fingerprints is small and reread in few tasks; each gives a hundred keys
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = spread.select("fp", F.explode(F.expr(_screen_keys())).alias("key"))
    keyed = keyed.repartition("key")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("key")
    # keys of `shared` are unique; a semi-join would be pushed below the repartition, and the
    # two sides would then work out and shuffle the keys each for itself
    near = cut(keyed.join(shared, "key").select("fp").distinct())
    ball = near.repartition("fp").mapInArrow(_ball, "variant long, fp long, even boolean").repartition("variant")
    centres = (
        ball.groupBy("variant")
        .agg(
            F.min(F.when(F.col("even"), F.col("fp"))).alias("e"),
            F.max(F.when(F.col("variant") == F.col("fp"), F.col("fp"))).alias("s"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
        .select("variant", F.coalesce("e", "s").alias("centre"))
        .filter("centre is not null")
    )
    edges = ball.join(centres, "variant").filter("fp <> centre").select(F.col("fp").alias("src"), F.col("centre").alias("dst"))
    return edges.filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS).distinct()


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return cut(bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), _fingerprints(text).alias("fp")))


def _components(marked: DataFrame) -> DataFrame:
    """(fp, copies, root, component_id) for every distinct fingerprint; root is one of the
    component's fingerprints."""
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    joined = connected_components(links(least.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = cut(least.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    return cut(join_hot(rooted, named, "root", "members").select("fp", "copies", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    marked = _fingerprinted(docs, id_col, text_col).drop("h")
    return join_hot(marked, _components(marked).drop("root"), "fp", "copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns kept."""
    marked = _fingerprinted(docs, id_col, text_col)
    rows = join_hot(marked, _components(marked).drop("component_id"), "fp", "copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("first")
    stay = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__simhash_id"), F.col("first.h").alias("__simhash_h"))
    # rows that repeat a survivor's id and text are few, or else met in one place: they are counted first
    copies = marked.groupBy(F.col("doc_id").alias("__simhash_id"), F.col("h").alias("__simhash_h")).agg(F.count("*").alias("n")).filter("n > 1")
    same = (F.col("__simhash_id").eqNullSafe(F.col("__simhash_id_2"))) & (F.col("__simhash_h") == F.col("__simhash_h_2"))
    copies = copies.toDF("__simhash_id_2", "__simhash_h_2", "__simhash_n")
    stay = cut(stay.join(copies, same, "left").select("__simhash_id", "__simhash_h", F.col("__simhash_n").isNotNull().alias("__simhash_more")))
    hashed = docs.withColumn("__simhash", F.xxhash64(F.col(text_col)))
    kept = hashed.join(stay, (F.col("__simhash") == F.col("__simhash_h")) & F.col(id_col).eqNullSafe(F.col("__simhash_id")))
    if stay.filter("__simhash_more").isEmpty():
        return kept.select(*docs.columns)
    more = kept.filter("__simhash_more").dropDuplicates(["__simhash_id", "__simhash_h"])
    return kept.filter("not __simhash_more").unionByName(more).select(*docs.columns)
