"""Reconciliation of training-run logs: which runs are complete, and why not.

Rows are (run, arm, seed, ordinal, event, step, macro). Every rule is an aggregate per run, and
the first failing rule names the reason; nothing needs the log in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.probability import validation_steps

# The events of a run.
READY, TRAIN, CHECKPOINT, VALIDATION, DONE = "ready", "train", "checkpoint", "validation", "done"


def best_checkpoint(log: DataFrame, *keys: str) -> DataFrame:
    """Best validation: largest macro, of equal ones the earliest step; and the last step's."""
    v = log.filter(F.col("event") == VALIDATION)
    return v.groupBy(*keys).agg(
        F.max_by("step", F.struct("macro", -F.col("step"))).alias("best_step"), F.max("macro").alias("best_macro"), F.max("step").alias("last_step"), F.max_by("macro", F.struct("step", "ordinal")).alias("last_macro")
    )


def running_best(log: DataFrame, *keys: str) -> DataFrame:
    """Validations that beat all earlier ones of their run."""
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    v = log.filter(F.col("event") == VALIDATION).withColumn("before", F.max("macro").over(before))
    return v.filter(F.col("before").isNull() | (F.col("macro") > F.col("before"))).drop("before")


def last_events(log: DataFrame, *keys: str) -> DataFrame:
    """The last row of each kind of event of a run."""
    return log.groupBy(*keys, "event").agg(F.max("ordinal").alias("ordinal"), F.max_by("step", "ordinal").alias("step"))


def order_check(log: DataFrame, *keys: str) -> DataFrame:
    """Whether a run is done after its last validation."""
    of = lambda e: F.max(F.when(F.col("event") == e, F.col("ordinal")))
    return log.groupBy(*keys).agg(F.coalesce(of(DONE) > of(VALIDATION), F.lit(False)).alias("in_order"))


def errors(log: DataFrame, *keys: str) -> DataFrame:
    """Validation steps that are repeated, and scores that are missing, not finite or not in
    [0, 1]: (keys, rule, n)."""
    v = log.filter(F.col("event") == VALIDATION)
    repeated = v.groupBy(*keys, "step").agg(F.count("*").alias("n")).filter("n > 1").groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("rule", F.lit("duplicate_step"))
    fine = F.coalesce(~F.isnan("macro") & F.col("macro").between(0.0, 1.0), F.lit(False))
    bad = v.filter(~fine).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("rule", F.lit("bad_score"))
    return repeated.unionByName(bad).select(*keys, "rule", "n")


def status(log: DataFrame, exits: DataFrame, min_validations: int, *keys: str) -> DataFrame:
    """(keys, status, reason): the first rule that fails, in order. `exits` has keys and exitcode."""
    of = lambda e: F.max(F.when(F.col("event") == e, F.col("ordinal")))
    n = lambda e: F.count_if(F.col("event") == e)
    per = log.groupBy(*keys).agg(
        n(READY).alias("ready"), n(VALIDATION).alias("validations"), n(CHECKPOINT).alias("checkpoints"), n(DONE).alias("done"), of(VALIDATION).alias("last_validation"), of(DONE).alias("last_done")
    )
    full = exits.join(per, list(keys), "left").fillna(0, ["ready", "validations", "checkpoints", "done"])
    reason = (
        F.when(F.col("exitcode") != 0, "exit_code")
        .when(F.col("ready") == 0, "not_ready")
        .when(F.col("validations") < min_validations, "missing_validations")
        .when(F.col("checkpoints") == 0, "missing_checkpoints")
        .when(F.col("done") == 0, "not_done")
        .when(~F.coalesce(F.col("last_done") > F.col("last_validation"), F.lit(False)), "done_too_early")
    )
    return full.select(*keys, F.when(reason.isNull(), "complete").otherwise("incomplete").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


# Events that end a run, and the arm that starts from a checkpoint.
ENDS, FROM_CHECKPOINT = (DONE, "already_complete"), "public4k"


def reconcile(log: DataFrame, manifest: DataFrame, horizon: int, train_rows: int, val_rows: int) -> DataFrame:
    """(arm, seed, status, reason, chosen_step, chosen_score, final_score) for each run of
    the manifest (run, arm, seed, exitcode). `log` has run, ordinal, event, step, macro, best,
    train_rows, val_rows, total_steps, reload_verified and config (seed, val_every,
    init_checkpoint). The first rule that fails, in order, is the reason: a broken protocol or
    a missing part leaves a run `incomplete`, validations that contradict themselves are an
    `error`. Only complete runs have scores: the best, its earliest step, and that at the horizon."""
    steps = validation_steps(horizon)
    is_val, is_end, is_point = F.col("event") == VALIDATION, F.col("event").isin(*ENDS), F.col("event") == CHECKPOINT
    at = lambda cond, value: F.when(cond, value)
    score_ok = lambda c: F.coalesce(~F.isnan(c) & F.col(c).between(0.0, 1.0), F.lit(False))
    per = log.groupBy("run").agg(
        F.max_by(F.struct("total_steps", "config", "train_rows", "val_rows"), at(F.col("event") == READY, F.col("ordinal"))).alias("ready"),
        F.count_if(is_val & F.col("step").isNull()).alias("no_step"),
        F.count_if(is_val & ~score_ok("macro")).alias("bad_score"),
        F.count_if(is_val & F.col("best").isNotNull() & ~score_ok("best")).alias("bad_best"),
        F.count_if(is_val).alias("validations"),
        F.array_sort(F.collect_set(at(is_val, F.col("step")))).alias("steps"),
        F.count_if(is_point & ~F.coalesce("reload_verified", F.lit(False))).alias("unverified"),
        F.count_if(is_point & F.col("step").isNull()).alias("point_without_step"),
        F.collect_set(at(is_point & F.col("reload_verified"), F.col("step"))).alias("points"),
        F.max(at(is_end, F.struct("ordinal", "step"))).alias("end"),
        F.max(at(is_val, F.col("ordinal"))).alias("last_validation"),
        F.max(at(is_val, F.struct(F.col("macro"), (-F.col("step")).alias("back")))).alias("best_of"),
        F.max(at(is_val & (F.col("step") == horizon), F.col("macro"))).alias("final"),
    )
    ready, cfg = F.col("ready"), F.col("ready")["config"]
    want = F.array(*[F.lit(s).cast("long") for s in steps])
    differs = lambda a, b: ~a.eqNullSafe(b)
    init = cfg["init_checkpoint"]
    rules = [
        ("incomplete", "exit_code", F.col("exitcode") != 0),
        ("incomplete", "missing_ready", ready.isNull()),
        ("incomplete", "total_steps", differs(ready["total_steps"], F.lit(horizon))),
        ("incomplete", "missing_config", cfg.isNull()),
        ("incomplete", "val_every", differs(cfg["val_every"], F.lit(steps[0]))),
        ("incomplete", "seed", differs(cfg["seed"], F.col("seed"))),
        ("incomplete", "train_rows", differs(ready["train_rows"], F.lit(train_rows))),
        ("incomplete", "val_rows", differs(ready["val_rows"], F.lit(val_rows))),
        ("incomplete", "init_checkpoint", F.when(F.col("arm") == FROM_CHECKPOINT, F.coalesce(init, F.lit("")) == "").otherwise(init.isNotNull())),
        ("error", "validation_without_step", F.col("no_step") > 0),
        ("error", "bad_score", F.col("bad_score") > 0),
        ("error", "bad_best", F.col("bad_best") > 0),
        ("error", "duplicate_step", F.col("validations") > F.size("steps")),
        ("error", "unexpected_step", F.size(F.array_except("steps", want)) > 0),
        ("incomplete", "missing_validations", F.size("steps") < len(steps)),
        ("incomplete", "unverified_checkpoint", F.col("unverified") > 0),
        ("incomplete", "checkpoint_without_step", F.col("point_without_step") > 0),
        ("incomplete", "missing_checkpoints", F.size(F.array_except(want, F.col("points"))) > 0),
        ("incomplete", "not_done", F.col("end").isNull()),
        ("incomplete", "done_step", differs(F.col("end")["step"], F.lit(horizon))),
        ("incomplete", "done_too_early", F.col("end")["ordinal"] < F.col("last_validation")),
    ]
    failed = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))) for status, reason, broken in rules])
    full = manifest.join(per, "run", "left").withColumn("failed", failed)
    fine = F.col("failed").isNull()
    return full.select(
        "arm", "seed", F.coalesce(F.col("failed")["status"], F.lit("complete")).alias("status"), F.coalesce(F.col("failed")["reason"], F.lit("")).alias("reason"),
        F.when(fine, -F.col("best_of")["back"]).alias("chosen_step"), F.when(fine, F.col("best_of")["macro"]).alias("chosen_score"), F.when(fine, F.col("final")).alias("final_score"),
    )


def paired(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(seed, best_diff, last_diff): arm b less arm a, for seeds where both are there once."""
    at = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    n = lambda arm: F.count_if(F.col("arm") == arm)
    per = runs.groupBy("seed").agg(n(a).alias("na"), n(b).alias("nb"), *[at(x, c).alias(f"{c}_{k}") for k, x in (("a", a), ("b", b)) for c in ("best_macro", "last_macro")])
    return per.filter("na = 1 and nb = 1").select("seed", (F.col("best_macro_b") - F.col("best_macro_a")).alias("best_diff"), (F.col("last_macro_b") - F.col("last_macro_a")).alias("last_diff"))
