"""CSV whose quoted cells hold line ends, read by as many tasks as the file has blocks.

Where a record ends depends on all quotes before it: a line end ends a record if their number is
even. So the file is read as lines, split anywhere as Spark splits text, and each block counts its
quotes; a running parity over the few rows of blocks says whether a block begins inside a cell,
and with that every task finds its own records. A record over the end of a block is two or more
fragments, which meet in a small grouping. Records are then parsed by Spark's own CSV parser.

The first pass reads the lines for their parities, the other two for fragments and for whole
records; only fragments are shuffled. A row of blocks stands for one split
(`spark.sql.files.maxPartitionBytes`), so what is broadcast is about 32 bytes for each 128 MB.

Defined cases. A quote belongs to a quoted cell, doubled inside it; a quote in an unquoted cell
isn't CSV. Blank lines between records are no records; a carriage return before the line end
that ends a record belongs to the line end. A cell may be longer than a block. Each file has the
header, which must name the columns in order; another one, a record that doesn't fit and a file
that ends inside a cell are errors. A file without a line has no records.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.session import cut

_OPTIONS = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "FAILFAST", "multiLine": "true"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): lines in order within each block (file, at)."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """Each batch's parts of one block, and whether a part is the block's first."""
    last = None
    for b in batches:
        file, at = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            if j > i:
                key = (int(file[i]), int(at[i]))
                yield key, key != last, b.slice(i, j - i)
                last = key


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, odd, ends_even, ends_odd): whether a block has an odd number of quotes, and
    whether a record ends in it if it begins outside or inside a cell."""
    rows: list[list] = []
    for key, first, part in _runs(batches):
        if first:
            rows.append([*key, False, False, False])
        row = rows[-1]
        after = (np.cumsum(pc.count_substring(part.column(2), '"').to_numpy()) + row[2]) % 2
        row[2], row[3], row[4] = bool(after[-1]), row[3] or bool((after == 0).any()), row[4] or bool((after == 1).any())
    columns = list(zip(*rows)) or [[]] * 5
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.bool_()] * 3))], names=["file", "at", "odd", "ends_even", "ends_odd"])


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, at, inside, record): whether each block begins inside a cell, and the number of
    the record of its file's cut records that it begins in."""
    found = lines.mapInArrow(_parities, "file long, at long, odd boolean, ends_even boolean, ends_odd boolean")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c.cast("long")).over(before), F.lit(0))
    known = found.withColumn("inside", total(F.col("odd")) % 2 == 1)
    ends = F.when(F.col("inside"), F.col("ends_odd")).otherwise(F.col("ends_even"))
    return known.withColumn("ends", ends).withColumn("record", total(F.col("ends"))).select("file", "at", "inside", "record")


def _joined(lines: pa.Array, edges: np.ndarray) -> pa.Array:
    """Lines between edges as one string each."""
    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), lines)
    return pc.binary_join(lists, "\n")


def _plain(records: pa.Array) -> pa.Array:
    ended = pc.utf8_rtrim(pc.if_else(pc.ends_with(records, "\r"), records, ""), "\r")
    records = pc.if_else(pc.ends_with(records, "\r"), ended, records)
    return records.filter(pc.not_equal(records, ""))


def _records(columns: list[str], fragments: bool):
    """Whole records (null, null, null, text) or else fragments (file, record, at, text) of
    (file, at, value, inside, record)."""

    def head(text: str) -> None:
        found = next(csv.reader([text], strict=True))
        if found != columns:
            raise ValueError(f"CSV header with other columns than {', '.join(columns)}")

    def made(file: int | None, record: int | None, at: int | None, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        return pa.record_batch([pa.array([file] * n, pa.int64()), pa.array([record] * n, pa.int64()), pa.array([at] * n, pa.int64()), texts.cast(pa.string())], names=["file", "record", "at", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def left() -> Iterator[pa.RecordBatch]:
            """What stands behind the last record that ended in the block."""
            if fragments and state and state["held"]:
                yield made(state["file"], state["record"], state["at"], pa.array(["\n".join(state["held"])]))

        for (file, at), first, part in _runs(batches):
            if first:
                yield from left()
                inside = part.column(3)[0].as_py()
                state = {"file": file, "at": at, "odd": inside, "cut": inside, "record": part.column(4)[0].as_py(), "held": [], "head": at == 0}
            lines = part.column(2)
            after = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + state["odd"]) % 2
            state["odd"] = bool(after[-1])
            ends = np.flatnonzero(after == 0) + 1
            if not len(ends):
                state["held"] += lines.to_pylist()
                continue
            opening = "\n".join([*state["held"], *lines.slice(0, ends[0]).to_pylist()])
            whole = _joined(lines.slice(int(ends[0]), int(ends[-1] - ends[0])), ends - ends[0]) if len(ends) > 1 else pa.array([], pa.string())
            state["held"] = lines.slice(int(ends[-1])).to_pylist()
            if state["cut"]:
                if fragments:
                    yield made(file, state["record"], at, pa.array([opening]))
            else:
                whole = pa.concat_arrays([pa.array([opening]), whole])
            state["record"], state["cut"] = state["record"] + (not state.get("ended", False)), False
            state["ended"] = True
            if not fragments:
                whole = _plain(whole)
                if state["head"] and len(whole):
                    head(whole[0].as_py())
                    state["head"], whole = False, whole.slice(1)
                if len(whole):
                    yield made(None, None, None, whole)
        yield from left()

    return run


def read_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(value): a row for each record of a CSV file or folder, its header checked and dropped."""
    lines = _lines(spark, path)
    placed = lines.join(F.broadcast(cut(_blocks(lines))), ["file", "at"]).select("file", "at", "value", "inside", "record")
    schema = "file long, record long, at long, value string"
    whole = placed.mapInArrow(_records(columns, False), schema).select("value")
    parts = placed.mapInArrow(_records(columns, True), schema)
    grouped = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("xs"))
    # a record of two lines or more has its line end where the fragments meet
    text = F.array_join(F.col("xs.value"), "\n")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    closed = F.when(quotes % 2 == 0, F.regexp_replace(text, r"\r\z", "")).otherwise(F.raise_error(F.lit("a CSV file ends inside a quoted cell")))
    # the header of a file whose first record is longer than its first block
    is_head = F.col("xs")[0]["at"] == 0
    header = F.concat_ws(",", *[F.lit(c) for c in columns])
    heads = F.when(is_head & (F.col("record") == 0) & (closed == header), F.lit(None)).otherwise(closed)
    return whole.unionByName(grouped.select(heads.alias("value")).filter("value <> ''"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of a CSV file or folder whose header names the columns of `schema` in order."""
    records = read_records(spark, path, schema.names)
    parsed: Column = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), _OPTIONS)
    return records.select(parsed.alias("r")).select("r.*")
