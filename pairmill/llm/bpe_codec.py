"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to CHUNK characters is one piece. A longer one is cut into chunks that
overlap by OVERLAP characters; tasks pre-tokenise the chunks in parallel, each from its
own start, and note the boundaries they find in the overlaps. Two scans that share one
boundary agree from there on, so neighbours are stitched at the first boundary of the
overlap that both have. Between two such places lies a piece, encoded by itself; a text's
ids are those of its pieces in order. Where an overlap has no common boundary (one run
of letters, say) the two chunks become one piece. Decoding concatenates the raw bytes
of the ids.

Only boundaries between an ASCII letter, digit or full stop and an ASCII space or line
end count as places to stitch: every class table agrees on them.

Defined cases. Null text: as the empty text, no ids. Null or repeated ids and repeated rows:
each row has its own result. Empty table: no rows. Other columns of the input, whatever
their names, aren't looked at. Texts of any length: a task works on a batch of chunks, and
pieces are digested one after the other; only a text's ids, a cell of the result, and a text
without a place to stitch are in one place whole. The vocabulary file is a parameter, read by
the driver (under 1 MB) and sent with the plan.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.units import UnitEncoder, bounded_batches, packed, slices

CHUNK, OVERLAP = 20_000, 400


# Fixed value: the pattern whose texts may be cut into units.
UNIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """A rank file with its pattern; the encoder is built once in each worker process. With
    a pattern other than UNIT_PATTERN, texts go to the library uncut."""

    _built: dict[str, tuple] = {}

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.key = hashlib.sha256(ranks + pattern.encode()).hexdigest()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def _own(self) -> tuple[UnitEncoder, pa.Array]:
        if self.key not in self._built:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            enc = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
            spelt = {rank: piece for piece, rank in table.items()}
            bytes_of = pa.array([spelt.get(i, b"") for i in range(max(table.values()) + 1)], pa.large_binary())
            id_bytes = pc.binary_length(bytes_of).to_numpy()
            self._built.clear()
            self._built[self.key] = (UnitEncoder(lambda texts: [enc.encode_ordinary(t) for t in texts], id_bytes, self.pattern != UNIT_PATTERN), bytes_of)
        return self._built[self.key]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, side by side, and how many each text has."""
        return self._own()[0].encode(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw bytes of the ids, side by side, and where each id's bytes begin (and the end)."""
        raw = self._own()[1].take(pa.array(ids, pa.int64()))
        edges = np.frombuffer(raw.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: edges[-1]], edges


def public_codec(name: str = "byte_bpe_multi_50k.tiktoken") -> Codec:
    import public_tokenizers

    return Codec.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN)


def _encode_pieces(codec: Codec):
    """Replaces the last column, a piece of text, by its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for part in slices(b, last):
                ids, sizes = codec.encode(part.column(last))
                own = {f.name: part.column(k) for k, f in enumerate(b.schema) if k < last}
                yield pa.record_batch(own | {"ids": packed(np.concatenate([[0], 4 * np.cumsum(sizes)]), ids.astype("<u4")).cast(pa.binary())})

    return run


def _results(doc_ids: pa.Array, ids: list[bytes], ids_sha256: list[str], decoded_sha256: list[str]) -> pa.RecordBatch:
    n_tokens = pa.array([len(x) // 4 for x in ids], pa.int64())
    return pa.record_batch({"doc_id": doc_ids, "ids": pa.array(ids, pa.binary()), "n_tokens": n_tokens, "ids_sha256": pa.array(ids_sha256, pa.string()), "decoded_sha256": pa.array(decoded_sha256, pa.string())})


def _encode_whole(codec: Codec):
    """Encodes, decodes and digests texts of one piece each in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                ids, sizes = codec.encode(part.column(1))
                raw, edges = codec.decode(ids)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                cells = [flat[i:j] for i, j in zip(at, at[1:])]
                of_text = edges[ends].tolist()
                decoded = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(of_text, of_text[1:])]
                yield _results(part.column(0), cells, [hashlib.sha256(x).hexdigest() for x in cells], decoded)

    return run


def _join_pieces(codec: Codec):
    """Results of texts whose pieces (row, doc_id, ids) come one after the other: ids and their
    decoded bytes are digested a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, doc_id, parts, digests = None, None, [], (hashlib.sha256(), hashlib.sha256())

        def done() -> pa.RecordBatch:
            return _results(doc_id, [b"".join(parts)], *([d.hexdigest()] for d in digests))

        for b in batches:
            for i in range(b.num_rows):
                if (now := b.column(0)[i].as_py()) != row:
                    if parts:
                        yield done()
                    row, doc_id, parts, digests = now, b.column(1).slice(i, 1), [], (hashlib.sha256(), hashlib.sha256())
                ids = b.column(2)[i].as_py()
                parts.append(ids)
                digests[0].update(ids)
                digests[1].update(codec.decode(np.frombuffer(ids, "<u4"))[0])
        if parts:
            yield done()

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """For each chunk: places in its first and in its last `overlap` characters (counted
    from the next chunk's start) where its scan has a boundary that can be stitched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        scan = regex.compile(pattern)
        good = regex.compile(r"(?<=[A-Za-z0-9.])(?=[ \n])")

        def places(text: str, lo: int, hi: int) -> list[int]:
            """Boundaries p, lo < p < hi, of the scan from 0, whose neighbours are plain."""
            plain = {m.start() for m in good.finditer(text, max(0, lo - 1), min(len(text), hi + 1))}
            found = []
            for m in scan.finditer(text):
                if m.end() >= hi:
                    break
                if m.end() > lo and m.end() in plain:
                    found.append(m.end())
            return found

        for b in batches:
            k = b.schema.get_field_index("piece")
            texts = b.column(k).to_pylist()
            head = [places(t, 0, overlap) for t in texts]
            tail = [[p - chunk for p in places(t, chunk, chunk + overlap)] for t in texts]
            yield pa.record_batch(
                {f.name: b.column(i) for i, f in enumerate(b.schema)} | {"head": pa.array(head, pa.list_(pa.int32())), "tail": pa.array(tail, pa.list_(pa.int32()))}
            )

    return run


def _pieces_of_long(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, piece_no, piece) for texts longer than a chunk."""
    n = F.expr(f"greatest(1, cast(ceil((length(text) - {overlap}) / {chunk}) as int))")
    chunks = long.select("row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("text"), k * chunk + 1, F.lit(chunk + overlap)))).alias("k", "piece"))
    seen = chunks.mapInArrow(_boundaries(pattern, chunk, overlap), chunks.schema.simpleString()[7:-1].replace(":", " ") + ", head array<int>, tail array<int>")
    by_row = Window.partitionBy("row").orderBy("k")
    # where this chunk's share ends, in characters after the next chunk's start
    stitched = seen.withColumn("meet", F.array_min(F.array_intersect("tail", F.lead("head").over(by_row)))).withColumn("last", F.lead("k").over(by_row).isNull())
    begun = stitched.withColumn("begin", F.lag("meet").over(by_row)).withColumn("first", F.col("k") == 0)
    end = F.when(F.col("last"), F.length("piece")).when(F.col("meet").isNull(), F.lit(chunk)).otherwise(F.col("meet") + chunk)
    begin = F.when(F.col("first"), 0).otherwise(F.coalesce("begin", F.lit(0)))
    cut = begun.select("row", "doc_id", "k", F.substring(F.col("piece"), begin + 1, end - begin).alias("piece"), F.when(F.col("first") | F.col("begin").isNotNull(), 1).otherwise(0).alias("opens"))
    # chunks without a common boundary belong to the piece before them
    numbered = cut.withColumn("piece_no", F.sum("opens").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "doc_id", "piece_no").agg(F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("parts")).select(
        "row", "doc_id", "piece_no", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("piece")
    )


def encode_documents(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256), one row per input row; ids are
    little-endian unsigned 32-bit integers."""
    plain = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    out = f"doc_id {kind}, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    is_long = F.length("text") > chunk
    short = plain.filter(~is_long).mapInArrow(_encode_whole(codec), out)
    # rows are told apart by their place in the input, which a reread of the same files repeats
    long = plain.withColumn("row", F.monotonically_increasing_id()).filter(is_long)
    pieces = _pieces_of_long(long, codec.pattern, chunk, overlap)
    done = pieces.mapInArrow(_encode_pieces(codec), f"row long, doc_id {kind}, piece_no long, ids binary")
    in_order = done.repartition("row").sortWithinPartitions("row", "piece_no").select("row", "doc_id", "ids")
    return short.unionByName(in_order.mapInArrow(_join_pieces(codec), out))
