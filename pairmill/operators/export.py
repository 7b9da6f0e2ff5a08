"""Resumable export: part files of a fixed number of rows, each with a receipt.

A part is named by its ranks, `start-end`. A run compares each stored part with its receipt and
with the ids that the plan wants there; parts that verify are kept, the others (absent, damaged,
unreadable, of other ids, without a receipt) are made again, alone. A part is written before its
receipt, so a run that dies between the two makes the part again. Receipts are taken from what can
be read back, not from what was sent. All work is per part: no task sees more than `size` rows of
one, and only the parts to be made are transformed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.session import cut
from pairmill.sources import blobs

RECEIPT = "part string, rows long, first_id string, last_id string, ids_sha256 string, sha256 string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _bind(spark: SparkSession, path: str, provenance: dict) -> None:
    """The export's manifest: written once; a run with other facts is an error."""
    said = json.dumps(provenance, sort_keys=True)
    if not _exists(spark, f"{path}/manifest"):
        if _exists(spark, f"{path}/parts"):
            raise ValueError("parts without a manifest: export to another folder")
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    elif [r["value"] for r in spark.read.text(f"{path}/manifest").collect()] != [said]:
        raise ValueError("the folder has an export of other provenance: export to another one")


def part_name(rank: Column, size: int) -> Column:
    """`start-end` of the part of `size` rows with a 0-based rank; the last part may be shorter."""
    first = F.floor(rank / size) * size
    return F.concat_ws("-", F.lpad(first.cast("string"), 12, "0"), F.lpad((first + size).cast("string"), 12, "0"))


def receipts_of(parts: DataFrame, key: str, line: Column) -> DataFrame:
    """A receipt for each part of `parts` (part, rank, key, ...): digests in order of rank."""
    row = F.struct("rank", F.col(key).cast("string").alias("id"), F.sha2(line, 256).alias("h"))
    rows = F.sort_array(F.collect_list(row))
    digest = lambda c: F.sha2(F.array_join(F.col(c), "\n"), 256)
    got = parts.groupBy("part").agg(F.count("*").alias("rows"), rows.alias("r"))
    return got.select("part", "rows", F.col("r")[0]["id"].alias("first_id"), F.element_at("r", -1)["id"].alias("last_id"), digest("r.id").alias("ids_sha256"), digest("r.h").alias("sha256"))


def export(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], line: Column, path: str, size: int, provenance: dict) -> DataFrame:
    """Exports `make(rows)` of `rows` (rank, key, ...), 0-based ranks without gaps, and gives the
    receipts with `state`: whether this run `reused` the part or has `written` it. `make` keeps
    rank and key and changes rows one by one; `line` is what a row's digest is taken of."""
    spark = rows.sparkSession
    _bind(spark, path, provenance | {"size": size})
    named = rows.withColumn("part", part_name(F.col("rank"), size))
    plan = receipts_of(named, key, F.lit("")).select("part", F.col("ids_sha256").alias("want"))
    kept = spark.createDataFrame([], RECEIPT)
    if _exists(spark, f"{path}/parts") and _exists(spark, f"{path}/receipts"):
        stored = spark.read.option("ignoreCorruptFiles", "true").schema(make(named).schema).parquet(f"{path}/parts")
        said = spark.read.schema(RECEIPT).parquet(f"{path}/receipts")
        kept = receipts_of(stored, key, line).join(said, said.schema.names)
    kept = cut(plan.join(kept, "part").filter("ids_sha256 = want").drop("want"))  # read before parts are written
    todo = named.join(kept.select("part"), "part", "left_anti")
    made = make(todo)
    write = lambda df, at: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(at)
    write(made.repartition("part"), f"{path}/parts")
    back = spark.read.schema(made.schema).parquet(f"{path}/parts").join(kept.select("part"), "part", "left_anti")
    written = cut(receipts_of(back, key, line))
    write(written, f"{path}/receipts")
    state = lambda df, s: df.select("part", "rows", "first_id", "last_id", "ids_sha256", "sha256", F.lit(s).alias("state"))
    receipts = state(kept, "reused").unionByName(state(written, "written"))
    _covered(plan, receipts)
    return receipts


def _covered(plan: DataFrame, receipts: DataFrame) -> None:
    """An error unless the receipts are of the planned parts, no more and no less."""
    both = plan.join(receipts.select("part", "ids_sha256"), "part", "full_outer")
    if not both.filter(~F.col("want").eqNullSafe(F.col("ids_sha256"))).isEmpty():
        raise ValueError("parts are missing, left over or of other ids")


def merge(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All parts as one table with the columns of `like`."""
    return spark.read.schema(like.schema).parquet(f"{path}/parts").drop("part")


def provenance_row(spark: SparkSession, path: str) -> DataFrame:
    """(provenance, rows, sha256) of a finished export: its digest is that of the parts' digests
    in order, so it needs no second look at the rows."""
    said = spark.read.schema(RECEIPT).parquet(f"{path}/receipts")
    manifest = spark.read.text(f"{path}/manifest").first()["value"]
    total = blobs.ordered_digest(said, F.col("sha256"), F.col("part")).select("sha256")
    rows = said.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return total.select(F.lit(manifest).alias("provenance"), F.lit(rows).cast("long").alias("rows"), "sha256")
