"""Incremental work as streams: index what is new with a receipt for each file, and follow runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairmill.sources import blobs


def set_digest(*columns: str) -> Column:
    """A digest of a set of rows that adds up over partitions: their number, the sum and the
    exclusive or of their 64-bit hashes."""
    h = F.xxhash64(*columns)
    return F.concat_ws("-", F.count("*").cast("string"), F.sum(h.cast("decimal(28,0)")).cast("string"), F.hex(F.bit_xor(h)))


def index_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], failed: Column | None = None) -> None:
    """Adds `transform` of the Parquet files that are new since the last call to
    `target`/rows, and a receipt for each file to `target`/receipts: (file, rows, errors,
    source_sha256, index_digest); `failed` says which transformed rows are errors.

    The checkpoint remembers which files a batch has. A batch writes the folder named by its
    number and nothing else, so a batch that is run again, after a failure between the write and
    the commit, replaces what it wrote: no row twice. Receipts are written last."""

    def add(batch: DataFrame, number: int) -> None:
        index_batch(batch, number, target, transform, failed)

    named = spark.readStream.schema(schema).parquet(source).withColumn("__file", F.col("_metadata.file_path"))
    query = named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def index_batch(batch: DataFrame, number: int, target: str, transform: Callable[[DataFrame], DataFrame], failed: Column | None = None) -> None:
    """One batch of `index_new`; a second run of the same number changes nothing."""
    spark = batch.sparkSession
    made = transform(batch)  # keeps __file
    made.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
    back = spark.read.parquet(f"{target}/rows/batch={number}")
    own = [c for c in back.columns if c != "__file"]
    bad = F.lit(False) if failed is None else failed
    counts = back.groupBy("__file").agg(F.count("*").alias("rows"), F.count_if(bad).alias("errors"), set_digest(*sorted(own)).alias("index_digest"))
    digests = blobs.digest_paths(batch.select("__file").distinct(), "__file").select("__file", F.col("sha256").alias("source_sha256"))
    counts.join(digests, "__file").withColumnRenamed("__file", "file").write.mode("overwrite").parquet(f"{target}/receipts/batch={number}")


def indexed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/rows").drop("batch", "__file")


def receipts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/receipts").drop("batch")


def verify_receipts(spark: SparkSession, target: str) -> DataFrame:
    """(file, state): receipts whose rows aren't there as they say (`rows`, `digest`), and indexed
    files without a receipt (`receipt`)."""
    back = spark.read.parquet(f"{target}/rows").drop("batch")
    own = [c for c in back.columns if c != "__file"]
    have = back.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n"), set_digest(*sorted(own)).alias("d"))
    both = receipts(spark, target).join(have, "file", "full_outer")
    state = F.when(F.col("rows").isNull(), "receipt").when(~F.col("n").eqNullSafe(F.col("rows")), "rows").when(F.col("d") != F.col("index_digest"), "digest")
    return both.select("file", state.alias("state")).filter("state is not null")


def live_best(events: DataFrame) -> DataFrame:
    """Best validation per run of a stream (or table) of events, for complete or update mode."""
    v = events.filter("event = 'validation'")
    return v.groupBy("arm", "seed").agg(F.max(F.struct("macro", (-F.col("step")).alias("s"))).alias("m")).select("arm", "seed", F.col("m.macro").alias("best_macro"), (-F.col("m.s")).alias("best_step"))


_OUT = "{key} long, ordinal long, step long, macro double"
_STATE = "keys array<long>, next array<long>, best array<double>, owners array<long>, ordinals array<long>, validations array<boolean>, steps array<long>, macros array<double>"
#: Keys of a state: a call, a state and its frames for each key alone take more than its events.
KEYS_AT_ONCE = 64


def live_running_best(events: DataFrame, key: str) -> DataFrame:
    """Each validation of a run that beats all before it, strictly, from a stream of (key,
    ordinal, event, step, macro) whose rows come in any order: an event is looked at when all
    before it were. A run's state is the next ordinal, the best so far and the events that came too
    early, kept with those of the runs beside it, KEYS_AT_ONCE at most; an ordinal seen before (a file given twice) is dropped. Nulls are no scores."""

    def follow(ids: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            keys, following, bests, owners, *early = state.get
            held = {k: [at, best, {}] for k, at, best in zip(keys, following, bests)}
            for i, o, *x in zip(owners, *early):
                held[keys[i]][2][o] = x
        for f in frames:
            for k, o, event, step, macro in zip(f[key], f["ordinal"], f["event"], f["step"], f["macro"]):
                run = held.setdefault(None if pd.isna(k) else int(k), [1, None, {}])
                if int(o) >= run[0]:
                    run[2][int(o)] = [event == "validation", None if pd.isna(step) else int(step), None if pd.isna(macro) else float(macro)]
        out = []
        for k, run in held.items():
            at, best, early = run
            while at in early:
                is_score, step, macro = early.pop(at)
                if is_score and macro is not None and (best is None or macro > best):
                    out.append((k, at, step, macro))
                    best = macro
                at += 1
            run[:2] = at, best
        flat = [(i, o, *x) for i, run in enumerate(held.values()) for o, x in sorted(run[2].items())]
        state.update((list(held), *[[run[i] for run in held.values()] for i in range(2)], *[[x[i] for x in flat] for i in range(5)]))
        if out:
            yield pd.DataFrame(out, columns=[key, "ordinal", "step", "macro"]).astype({key: "Int64", "step": "Int64"})

    rows = events.select(key, "ordinal", "event", "step", "macro", F.expr(f"{key} div {KEYS_AT_ONCE}").alias("__keys"))
    return rows.groupBy("__keys").applyInPandasWithState(follow, _OUT.format(key=key), _STATE, "append", GroupStateTimeout.NoTimeout)
