"""Column functions for identities and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairmill.functions.text import normalize_caption


def object_key(raw: Column) -> Column:
    return F.md5(raw.cast("binary"))


def public_pair_id(bytes_md5: Column, caption: Column) -> Column:
    """Id of a generated pair from its image's md5 and its normalised caption."""
    return F.concat(F.lit("public_"), F.sha2(F.concat(bytes_md5, F.char(F.lit(0)), normalize_caption(caption)).cast("binary"), 256))


def seeded(seed: str, *parts: Column, separator: bool = True) -> Column:
    """sha256 of seed and parts: a pseudo-random order that any partitioning repeats."""
    cols = [F.lit(seed), *(p.cast("string") for p in parts)]
    joined = F.concat(*(x for c in cols[:-1] for x in (c, F.char(F.lit(0)))), cols[-1]) if separator else F.concat(*cols)
    return F.sha2(joined.cast("binary"), 256)


def uniform(digest: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of a digest."""
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def is_md5(text: Column) -> Column:
    return F.coalesce(text.rlike("\\A[0-9a-f]{32}\\z"), F.lit(False))


def hex_words(signature: Column, nibbles: int) -> Column:
    """A hex fingerprint as 64-bit words, for xor and bit counts."""
    return F.array(*[F.conv(F.substring(signature, i, 16), 16, -10).cast("long") for i in range(1, nibbles + 1, 16)])


def hamming(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words)), F.lit(0))


def sorted_json(*columns: str) -> Column:
    """The columns as a JSON object with its keys in order; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
