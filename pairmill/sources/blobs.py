"""Content-addressed blobs and digests.

Blobs are rows (md5, bytes) of a Parquet table: puts are an anti-join on the table's keys,
so equal content is stored once; gets verify the bytes against their name.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put(blobs: DataFrame, path: str, bytes_col: str = "bytes") -> None:
    """Append what isn't stored yet."""
    spark = blobs.sparkSession
    new = blobs.filter(F.col(bytes_col).isNotNull()).select(F.md5(bytes_col).alias("md5"), F.col(bytes_col).alias("bytes")).dropDuplicates(["md5"])
    try:
        stored = spark.read.parquet(path).select("md5")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(stored, "md5", "left_anti")
    new.write.mode("append").parquet(path)


def get(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(md5, bytes) of the named blobs whose bytes fit their name."""
    return spark.read.parquet(path).join(names.select("md5").distinct(), "md5", "left_semi").filter(F.md5("bytes") == F.col("md5"))


def put_files(files: DataFrame, folder: str) -> int:
    """Writes (name, bytes) as files into a folder of the shared store and gives their number.
    Each is written under another name and then moved, so a file is whole or absent, and a task
    that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _store(folder)
        fs.create_dir(at, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = f"{at}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data or b"")
                fs.move(part, f"{at}/{name}")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("name", "bytes").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def audit(used: DataFrame, stored: DataFrame) -> DataFrame:
    """(md5, state) for used blobs that are missing or don't fit their name."""
    full = used.select("md5").distinct().join(stored.select("md5", "bytes"), "md5", "left")
    state = F.when(F.col("bytes").isNull(), "missing").when(F.md5("bytes") != F.col("md5"), "corrupt")
    return full.select("md5", state.alias("state")).filter("state is not null")


#: Bytes of a file that a task holds at once.
READ_BLOCK = 1 << 20


def _store(path: str) -> tuple[FileSystem, str]:
    """The store of a path and the path in it; Spark gives paths with and without escapes."""
    if path.startswith(("file:", "/")):
        at = re.sub("^file:/+", "/", path)
        return LocalFileSystem(), at if os.path.exists(at) else unquote(at)
    return FileSystem.from_uri(quote(path, safe=":/%@?=&"))


def opened(path: str):
    """A stream of a file of the shared store."""
    fs, at = _store(path)
    return fs.open_input_stream(at)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, sizes = [], []
        for path in b.column(0).to_pylist():
            state, size = hashlib.sha256(), 0
            with opened(path) as f:
                while block := f.read(READ_BLOCK):
                    state.update(block)
                    size += len(block)
            digests.append(state.hexdigest())
            sizes.append(size)
        yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def digest_paths(paths: DataFrame, column: str) -> DataFrame:
    """(column, bytes, sha256) of files: tasks stream them in blocks and hold the digest's state
    only, so a file may be larger than a task's memory. One task reads a file, in order; the files
    are dealt over tasks. In a store that pyarrow doesn't open, Spark reads whole files (up to 2 GB)."""
    spark = paths.sparkSession
    named = paths.select(F.col(column).alias("path"))
    first = named.first()
    if first is not None:
        try:
            _store(first["path"])
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            files = spark.read.format("binaryFile").load([r["path"] for r in named.collect()])
            return files.select(F.col("path").alias(column), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return named.repartition(F.xxhash64("path")).mapInArrow(_streamed, "path string, bytes long, sha256 string").withColumnRenamed("path", column)


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, bytes, sha256) of files of any size; a folder stands for the files in it."""
    conf, names = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:  # names only, as Spark lists them too, but with empty files
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(conf).listFiles(at, True)
        while found.hasNext():
            names.append((found.next().getPath().toString(),))
    hidden = F.element_at(F.split("path", "/"), -1).rlike("^[._]")
    return digest_paths(spark.createDataFrame(names, "path string").filter(~hidden), "path").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def verify_manifest(manifest: DataFrame, found: DataFrame, required: tuple[str, ...] = (), needs_prefix: str = "") -> DataFrame:
    """(name, state) of files that differ from a manifest (name, bytes, sha256): size first.
    `required` names that the manifest lacks are `unlisted`, a manifest without any name that
    begins with `needs_prefix` too (named by the prefix and `*`), and names that leave the
    folder are `unsafe`."""
    spark = manifest.sparkSession
    wanted = spark.createDataFrame([(n,) for n in required], "name string").join(manifest.select("name"), "name", "left_anti")
    if needs_prefix and manifest.filter(F.col("name").startswith(needs_prefix)).isEmpty():
        wanted = wanted.unionByName(spark.createDataFrame([(f"{needs_prefix}*",)], "name string"))
    unsafe = F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    have = found.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    full = manifest.join(have, "name", "left")
    state = F.when(unsafe, "unsafe").when(F.col("b").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "digest")
    return full.select("name", state.alias("state")).filter("state is not null").unionByName(wanted.select("name", F.lit("unlisted").alias("state")))


#: Characters of lines that one row holds on their way to the digest.
DIGEST_BLOCK = 1 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, k, n, lines): a partition's lines in order, joined to blocks."""
    held, size, k, part, count = [], 0, 0, 0, 0

    def block() -> pa.RecordBatch:
        return pa.record_batch({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int64()), "n": pa.array([count], pa.int64()), "lines": ["\n".join(held)]})

    for b in batches:
        for part, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.append(line)
            size, count = size + len(line) + 1, count + 1
            if size >= DIGEST_BLOCK:
                yield block()
                held, size, count, k = [], 0, 0, k + 1
    if held:
        yield block()


def ordered_digest(rows: DataFrame, line: Column, *order: Column, end: str = "") -> DataFrame:
    """One row: the sha256 of all lines in order, with a line feed between them and `end`
    behind the last, and their number. Null lines count as empty. The rows are sorted by
    range in parallel; a digest of one stream has to see it in order, so one task reads the
    sorted blocks of lines one after the other and holds only the digest's state. Ties in
    `order` are in the order of the lines."""
    names = [f"o{i}" for i in range(len(order))]
    keyed = rows.select(*[o.alias(n) for o, n in zip(order, names)], F.coalesce(line, F.lit("")).alias("line"))
    placed = keyed.repartitionByRange(*names, "line").sortWithinPartitions(*names, "line").select(F.spark_partition_id().alias("part"), "line")
    blocks = placed.mapInArrow(_blocks, "part int, k long, n long, lines string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = hashlib.sha256(), 0
        for b in batches:
            for count, lines in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not count:
                    continue
                state.update((("\n" if n else "") + lines).encode())
                n += count
        if n:
            state.update(end.encode())
        yield pa.record_batch({"sha256": [state.hexdigest()], "rows": pa.array([n], pa.int64())})

    # a row without lines, so that there is a digest of no rows too
    start = rows.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n"), F.lit("").alias("lines"))
    return blocks.unionByName(start).repartition(1).sortWithinPartitions("part", "k").mapInArrow(digest, "sha256 string, rows long")


def chunk_plan(rows: DataFrame, rank: str, size: int) -> DataFrame:
    """(chunk, first, last, n) of part files of `size` rows by 1-based rank."""
    k = F.expr(f"({rank} - 1) div {size}")
    return rows.groupBy(k.alias("chunk")).agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n"))
