"""Readers that say what is wrong with a file instead of reading around it."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.sources import csv_split

# Columns of a labelled pair file, and of a run log.
PAIR_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("obj_1", T.StringType()), T.StructField("obj_2", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("same_figure", "same_paper", "related_papers", "unrelated_papers")]])
EVENT_SCHEMA = "event string, step long, macro double, best double, train_rows long, val_rows long, total_steps long, reload_verified boolean, config struct<seed:long,val_every:long,init_checkpoint:string>, _bad string"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with cells of any size, one file read by many tasks; the header must name the columns
    in order."""
    return csv_split.read_csv(spark, path, PAIR_SCHEMA)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet or CSV by suffix, only the asked-for columns; another suffix is an error."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
    else:
        raise ValueError(f"{posixpath.basename(path)}: neither .parquet nor .csv")
    return df.select(*columns) if columns else df


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds `e`, the parsed event, and `malformed` for lines that are no event; blank lines go."""
    kept = lines.filter(F.trim(F.col(value)) != "")
    parsed = kept.withColumn("e", F.from_json(value, EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.withColumn("malformed", F.col("e._bad").isNotNull() | F.col("e.event").isNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run log; malformed lines are an error that names the file only."""
    parsed = parse_events(spark.read.text(path))
    if not parsed.filter("malformed").isEmpty():
        raise ValueError(f"{posixpath.basename(path)}: malformed line")
    return parsed.select("e.*").drop("_bad")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """File names in a folder of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))


def shard_completeness(spark: SparkSession, names: list[str], count: int, pattern: str = "train-%05d-of-%05d.parquet") -> DataFrame:
    """(name, state) for names that are missing or not expected in a set of `count` shards; the
    pattern takes a shard's number and, where it asks for it, the count."""
    given = ["id"] + [F.lit(count)] * (pattern.count("%") - 1)
    want = spark.range(count).select(F.format_string(pattern, *given).alias("name"))
    have = spark.createDataFrame([(n,) for n in names], "name string")
    missing = want.join(have, "name", "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(have.join(want, "name", "left_anti").withColumn("state", F.lit("unexpected")))


def read_manifest(spark: SparkSession, path: str, schema: str, *required: str) -> DataFrame:
    """A JSON document as one row of `schema`; a file that isn't one JSON object, or that
    lacks a required field, is an error that names the file and the field only."""
    name = posixpath.basename(path)
    found = spark.read.json(path, multiLine=True, mode="PERMISSIVE", schema=f"{schema}, _bad string", columnNameOfCorruptRecord="_bad").take(2)
    if len(found) != 1 or found[0]["_bad"] is not None:
        raise ValueError(f"{name}: not one JSON object of the expected shape")
    for field in required:
        if found[0][field] is None or found[0][field] in ("", [], {}):
            raise ValueError(f"{name}: {field} is missing")
    plain = spark.createDataFrame([], schema).schema
    return spark.createDataFrame([tuple(found[0][f.name] for f in plain.fields)], plain)


def caption_column(columns: list[str], *preferred: str) -> str:
    """The first of the preferred columns that a table has: one choice for all its rows."""
    for name in preferred:
        if name in columns:
            return name
    raise ValueError(f"none of the columns {', '.join(preferred)}")


def without_labels(df: DataFrame, labels: tuple[str, ...] = ("label", "y", "target")) -> DataFrame:
    """The table itself; an error if it has a label column."""
    if found := sorted(set(df.columns) & set(labels)):
        raise ValueError(f"label columns {found} in a label-free table")
    return df


def write_csv_once(df: DataFrame, path: str) -> None:
    """CSV with a header into a new folder; an existing one is an error and stays as it is."""
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """The distinct, non-empty values of a column as sorted lines of text, in a new folder."""
    lines = df.select(F.col(column).cast("string").alias("value")).filter("value <> ''").distinct()
    lines.repartitionByRange("value").sortWithinPartitions("value").write.mode("errorifexists").text(path)
