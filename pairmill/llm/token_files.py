"""Token ids in Parquet files: list columns, controlled row groups, page indexes.

Documents are range-partitioned and sorted by id, encoded where they lie, and written by
Spark's Parquet writer: the ids as a list column with dictionary encoding (a vocabulary of
50,000 fits one dictionary page), the metadata columns beside it with delta encoding
(format v2), row groups of ROW_GROUP bytes and pages of PAGE_ROWS rows, whose indexes let a
reader that asks for some ids or for metadata alone skip the token pages. Each file knows
its block (range partition) and each row its token offset in the block, so the start of
any document is that plus the tokens of earlier blocks: a sum over blocks, one row each.

Encoding is by the tokenizers library; a worker keeps the ids of units it has met (see
`units`). END_ID closes every document.

Defined cases. Null text: the end id alone. Null doc_id: sorted first. Repeated ids: in
order of their text; equal rows have each their own place. Empty table: no rows. Very long
texts are encoded whole, a bounded number of units at a time. Bytes that aren't UTF-8 are
read as U+FFFD. Other columns of the input, whatever their names, aren't looked at. An
executor lost while writing: its tasks run again, the writer commits whole files only.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.llm.units import UnitEncoder, bounded_batches, slices

END_ID = 0
ROW_GROUP, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 500


class TokenizerFile:
    """A tokenizers-library file; the encoder is built once in each worker process."""

    _built: dict[str, UnitEncoder] = {}

    def __init__(self, text: str):
        self.text, self.key = text, hashlib.sha256(text.encode()).hexdigest()

    @classmethod
    def public(cls, name: str = "byte_bpe_50k.json") -> TokenizerFile:
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            return cls(f.read())

    def fits_units(self) -> bool:
        """Whether texts may be cut into units: a plain byte-level pre-tokenizer and no other rule on texts."""
        spec = json.loads(self.text)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return plain and not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, side by side, and how many each text has."""
        if self.key not in self._built:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(self.text)
            self._built.clear()
            vocab = own.get_vocab(with_added_tokens=True)
            id_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            # a byte-level vocabulary spells each byte as one character
            for token, i in vocab.items():
                id_bytes[i] = len(token)
            intact = tuple(t["content"] for t in json.loads(self.text).get("added_tokens", []))
            self._built[self.key] = UnitEncoder(lambda t: [e.ids for e in own.encode_batch_fast(t, add_special_tokens=False)], id_bytes, not self.fits_units(), intact)
        return self._built[self.key].encode(texts)


def _encode(tokenizer: TokenizerFile):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = 0
        for b in batches:
            for own in slices(b, 2):
                ids, sizes = tokenizer.encode(own.column(2))
                ends = np.cumsum(sizes + 1)
                flat = np.full(len(ids) + len(sizes), END_ID, dtype=np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.record_batch({"block": own.column(0), "doc_id": own.column(1), "block_start": ends - sizes - 1 + offset, "n_tokens": sizes + 1, "tokens": tokens})
                offset += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, tokenizer: TokenizerFile, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write (block, doc_id, block_start, n_tokens, tokens) in ascending id order."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # by the beginning of the text too: rows of one id, or without an id, are split over tasks
    keyed = rows.withColumn("head", F.substring("text", 1, 64))
    ordered = keyed.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "head", "text").select(F.spark_partition_id().alias("block"), "doc_id", "text")
    coded = ordered.mapInArrow(_encode(tokenizer), f"block int, doc_id {dict(rows.dtypes)['doc_id']}, block_start long, n_tokens long, tokens array<int>")
    (
        coded.write.mode("errorifexists")
        .option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path)
    )


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(block, before): tokens in all earlier blocks, from metadata columns alone."""
    sums = spark.read.parquet(path).groupBy("block").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(b.num_columns - 1)
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        ends = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        yield pa.record_batch({f.name: b.column(k) for k, f in enumerate(b.schema) if k < b.num_columns - 1} | {"ids_crc32": pa.array(crc, pa.int64())})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, read back from the files."""
    files = bounded_batches(spark.read.parquet(path)).select("block", "block_start", "doc_id", "n_tokens", "tokens")
    kind = dict(files.dtypes)["doc_id"]
    digests = files.mapInArrow(_crc, f"block int, block_start long, doc_id {kind}, n_tokens long, ids_crc32 long")
    return digests.join(read_starts(spark, path), "block").select(
        "doc_id", (F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, tokens) of some documents: the filter reaches row groups and pages by their indexes."""
    return spark.read.parquet(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "tokens")
