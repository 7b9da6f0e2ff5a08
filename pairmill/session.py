"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "pairmill", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; `conf` overrides by full key."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` where the session
    has it, or the one set on its context. Without either, a local one is set on one machine
    (tests), and a cluster is an error."""
    sc = spark.sparkContext
    if set_dir := sc.getConf().get("spark.checkpoint.dir"):
        return set_dir.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on shared storage, so that an iteration's plan stays short and
    a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that is written and reread."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path`, in place of what is there, and reread: for loops whose rounds join
    rounds, since the planner takes a table's size from its files and a checkpoint's from the
    estimate of the plan that made it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
