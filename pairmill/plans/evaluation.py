"""Queries of scoring, metrics, paired comparison and run reconciliation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairmill.functions import text
from pairmill.operators import joins, metrics, receipts, runs, scoring
from pairmill.plans.fixtures import Views
from pairmill.plans.registry import query
from pairmill.session import cut, scratch
from pairmill.streaming import incremental

_LABELS = ", ".join(f"(p = {i})::INT AS {n}" for i, n in enumerate(text.LABELS))
_F1 = "f1 AS (SELECT l AS label, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS predicted, count(*) FILTER (y = l AND p = l) AS hits FROM pred_a, range(4) t(l) GROUP BY l)"


def _f1_value(support: str = "support", predicted: str = "predicted", hits: str = "hits") -> str:
    return f"CASE WHEN {support} + {predicted} > 0 THEN 2.0 * {hits} / ({support} + {predicted}) ELSE 0.0 END::DOUBLE"


@query("SELECT t.y, t.p, count(pair_id) AS n FROM (SELECT y.range AS y, p.range AS p FROM range(4) y, range(4) p) t LEFT JOIN pred_a a ON a.y = t.y AND a.p = t.p GROUP BY 1, 2", "pred_a")
def confusion(v: Views):
    return metrics.dense(metrics.confusion(v.predictions(1)))


@query("SELECT y, p, sum(n)::BIGINT AS n FROM (SELECT y, p, count(*) AS n FROM pred_a GROUP BY y, p UNION ALL SELECT y, p, count(*) FROM pred_b GROUP BY y, p) GROUP BY y, p", "pred_a", "pred_b")
def pooled_confusion(v: Views):
    both = metrics.confusion(v.predictions(1)).unionByName(metrics.confusion(v.predictions(5)))
    return both.groupBy("y", "p").agg(F.sum("n").alias("n"))


@query(f"{_F1} SELECT label, support, predicted, hits, round({_f1_value()}, 9) AS f1 FROM f1 WHERE support + predicted > 0", "pred_a")
def class_f1(v: Views):
    cells = metrics.class_f1(metrics.confusion(v.predictions(1)))
    return cells.select("label", "support", "predicted", "hits", F.round("f1", 9).alias("f1"))


@query(
    f"f AS (SELECT task, l AS label, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS predicted, count(*) FILTER (y = l AND p = l) AS hits FROM pred_a, range(4) t(l) GROUP BY task, l) SELECT task, round(sum({_f1_value()}) / 4, 9) AS macro_f1, round(avg({_f1_value()}) FILTER (support > 0), 9) AS active_macro_f1, sum(support)::BIGINT AS n FROM f GROUP BY task", "pred_a"
)
def macro_f1(v: Views):
    m = metrics.macro_f1(metrics.confusion(v.predictions(1), "task"), "task")
    return m.select("task", F.round("macro_f1", 9).alias("macro_f1"), F.round("active_macro_f1", 9).alias("active_macro_f1"), "n")


@query("SELECT group_id, y, p, count(*) AS n FROM pred_a GROUP BY group_id, y, p", "pred_a")
def group_confusion(v: Views):
    return metrics.confusion(v.predictions(1), "group_id")


@query("SELECT task, count(*) AS n, count(*) FILTER (p = y) AS hits, round(count(*) FILTER (p = y) / count(*)::DOUBLE, 9) AS accuracy FROM pred_a WHERE y IN (2, 3) GROUP BY task", "pred_a")
def subset_accuracy(v: Views):
    """Accuracy of four-way decisions on classes 2 and 3."""
    s = v.predictions(1).filter(F.col("y").isin(2, 3)).groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("y")).alias("hits"))
    return s.withColumn("accuracy", F.round(F.col("hits") / F.col("n"), 9))


def _both(v: Views):
    b = v.predictions(5).select("pair_id", F.col("p").alias("p_b"))
    return v.predictions(1).withColumnRenamed("p", "p_a").join(b, "pair_id")


@query(
    "SELECT y, count(*) FILTER (a.p <> b.p) AS changed, count(*) FILTER (a.p <> y AND b.p = y) AS corrected, count(*) FILTER (a.p = y AND b.p <> y) AS broken, count(*) FILTER (a.p <> y AND b.p <> y) AS both_wrong, count(*) FILTER (a.p <> y AND b.p = y) - count(*) FILTER (a.p = y AND b.p <> y) AS net FROM pred_a a JOIN (SELECT pair_id, p FROM pred_b) b USING (pair_id) GROUP BY y", "pred_a", "pred_b"
)
def paired_transitions(v: Views):
    return metrics.transitions(_both(v), "y")


@query(
    f"{_F1}, f2 AS (SELECT l AS label, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS predicted, count(*) FILTER (y = l AND p = l) AS hits FROM pred_b, range(4) t(l) GROUP BY l) SELECT label, round({_f1_value('f2.support', 'f2.predicted', 'f2.hits')} - {_f1_value('f1.support', 'f1.predicted', 'f1.hits')}, 9) AS delta FROM f1 JOIN f2 USING (label) WHERE f1.support > 0", "pred_a", "pred_b"
)
def delta_f1(v: Views):
    a, b = (metrics.class_f1(metrics.confusion(v.predictions(i))) for i in (1, 5))
    return a.filter("support > 0").select("label", F.col("f1").alias("fa")).join(b.select("label", F.col("f1").alias("fb")), "label").select("label", F.round(F.col("fb") - F.col("fa"), 9).alias("delta"))


#: Draws of the bootstrap, as many as a percentile interval needs.
DRAWS = 10_000


_BOOTSTRAP = f"g AS (SELECT group_id, row_number() OVER (ORDER BY md5(group_id), group_id) AS g FROM (SELECT DISTINCT group_id FROM gold)), n AS (SELECT count(*) AS n FROM g), s AS (SELECT d, ('0x' || left(md5('bootstrap:' || d || ':' || s), 12))::BIGINT % n + 1 AS g FROM n, range({DRAWS}) t(d), (SELECT unnest(range(n)) AS s FROM n) u), c AS (SELECT 'a' AS model, group_id, y, p, count(*) AS n FROM pred_a GROUP BY ALL UNION ALL SELECT 'b', group_id, y, p, count(*) FROM pred_b GROUP BY ALL), w AS (SELECT model, d, y, p, sum(n) AS n FROM s JOIN g USING (g) JOIN c USING (group_id) GROUP BY ALL), f AS (SELECT model, d, l, coalesce(sum(n) FILTER (y = l), 0) AS support, coalesce(sum(n) FILTER (p = l), 0) AS predicted, coalesce(sum(n) FILTER (y = l AND p = l), 0) AS hits FROM w, range(4) t(l) GROUP BY model, d, l), m AS (SELECT model, d AS draw, sum({_f1_value()}) / 4 AS macro_f1 FROM f GROUP BY model, d)"


def _draws(v: Views):
    cells = [metrics.confusion(v.predictions(i), "group_id").withColumn("model", F.lit(m)) for m, i in (("a", 1), ("b", 5))]
    return metrics.cluster_bootstrap(cells[0].unionByName(cells[1]), DRAWS)


@query(f"{_BOOTSTRAP} SELECT model, draw, round(macro_f1, 9) AS macro_f1 FROM m", "pred_a", "pred_b", "gold")
def cluster_bootstrap(v: Views):
    return _draws(v).select("model", "draw", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"{_BOOTSTRAP}, x AS (SELECT b.macro_f1 - a.macro_f1 AS x FROM m a JOIN m b USING (draw) WHERE a.model = 'a' AND b.model = 'b') SELECT round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high, round(avg(x), 9) AS mean FROM x", "pred_a", "pred_b", "gold")
def bootstrap_interval(v: Views):
    """The 95 % percentile interval of the paired difference of macro F1."""
    i = metrics.interval(_draws(v), "a", "b")
    return i.select(*[F.round(c, 9).alias(c) for c in ("low", "high", "mean")])


@query(None)
def bootstrap_split(v: Views):
    """The interval from draws made by binomial splitting, which no SQL repeats."""
    cells = [metrics.confusion(v.predictions(i), "group_id").withColumn("model", F.lit(m)) for m, i in (("a", 1), ("b", 5))]
    i = metrics.interval(metrics.split_bootstrap(cells[0].unionByName(cells[1]), DRAWS), "a", "b")
    return i.select(*[F.round(c, 9).alias(c) for c in ("low", "high", "mean")])


@query("SELECT pair_id, round((a.p[1] + b.p[1]) / 2, 9) AS p0, round((a.p[2] + b.p[2]) / 2, 9) AS p1, round((a.p[3] + b.p[3]) / 2, 9) AS p2, round((a.p[4] + b.p[4]) / 2, 9) AS p3 FROM probs_a a JOIN probs_rev b USING (pair_id)", "probs_a", "probs_rev")
def orientation_mean(v: Views):
    m = scoring.orientation_mean(v.probs(1), v.probs(9), "pair_id")
    return m.select("pair_id", *[F.round(F.col("p")[i], 9).alias(f"p{i}") for i in range(4)])


@query(
    f"m AS (SELECT pair_id, CASE WHEN a.task = 'ixi' THEN [(x + b.p[i]) / 2 FOR x, i IN a.p] ELSE a.p END AS p FROM probs_a a JOIN probs_rev b USING (pair_id)), q AS (SELECT pair_id, list_position(p, list_max(p)) - 1 AS p FROM m) SELECT pair_id, {_LABELS} FROM q", "probs_a", "probs_rev"
)
def assemble_submission(v: Views):
    """One-hot rows in a template's ids; image pairs are averaged over both orders."""
    a = v.probs(1)
    ixi = scoring.orientation_mean(a.filter("task = 'ixi'"), v.probs(9).filter("task = 'ixi'"), "pair_id")
    return scoring.assemble(v.gold(), [a.filter("task <> 'ixi'"), ixi], "pair_id")


@query("SELECT ident, count(*) AS n, count(DISTINCT label) AS labels, count(*) - max(c) AS minority FROM (SELECT md5(text) AS ident, n_chars % 4 AS label, count(*) OVER (PARTITION BY md5(text), n_chars % 4) AS c FROM documents) GROUP BY ident HAVING count(*) > 1")
def label_conflicts(v: Views):
    """Repeated identities: their rows, labels and rows beyond the commonest label."""
    d = v.table("documents").select(F.md5(F.col("text").cast("binary")).alias("ident"), (F.col("n_chars") % 4).alias("label"))
    per = d.groupBy("ident", "label").agg(F.count("*").alias("c"))
    return per.groupBy("ident").agg(F.sum("c").alias("n"), F.count("*").alias("labels"), (F.sum("c") - F.max("c")).alias("minority")).filter("n > 1")


#: Characters that a caption is cut to, so short that captions of the tables merge.
SHORT = 60


@query(f"SELECT effective, count(*) AS identities, sum(n)::BIGINT AS rows FROM (SELECT md5(left(text, {SHORT})) AS effective, md5(text) AS full, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY effective HAVING count(*) > 1")
def truncation_merger(v: Views):
    """Different full inputs that are equal after truncation."""
    md5 = lambda c: F.md5(c.cast("binary"))
    full = v.table("documents").groupBy(md5(text.truncate_caption(F.col("text"), SHORT)).alias("effective"), md5(F.col("text")).alias("full")).agg(F.count("*").alias("n"))
    return full.groupBy("effective").agg(F.count("*").alias("identities"), F.sum("n").alias("rows")).filter("identities > 1")


_KEYS = ("user_id", "arm", "seed")


@query("SELECT user_id, arm, seed, arg_max(step, (macro, -step)) AS best_step, max(macro) AS best_macro, max(step) AS last_step, arg_max(macro, (step, ordinal)) AS last_macro FROM runlog WHERE event = 'validation' GROUP BY ALL", "runlog")
def best_checkpoint(v: Views):
    return runs.best_checkpoint(v.runlog(), *_KEYS)


@query("SELECT user_id, ordinal, step, macro FROM (SELECT *, max(macro) OVER (PARTITION BY user_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runlog WHERE event = 'validation') WHERE before IS NULL OR macro > before", "runlog")
def running_best(v: Views):
    return runs.running_best(v.runlog(), "user_id").select("user_id", "ordinal", "step", "macro")


#: Events of a file of the log; each of three triggers takes a third of the files.
EVENTS_A_FILE = 1_000_000


@query("SELECT user_id, ordinal, step, macro FROM (SELECT *, max(macro) OVER (PARTITION BY user_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runlog WHERE event = 'validation') WHERE before IS NULL OR macro > before", "runlog")
def running_best_stream(v: Views):
    """The same from a stream of the log in several files, its events in another order."""
    log = v.runlog().select("user_id", "ordinal", "event", "step", "macro")
    base = scratch(v.spark, "live-log")
    at_once = 1 + v.table("events").count() // EVENTS_A_FILE
    log.repartition(3 * at_once, F.xxhash64("user_id", "ordinal")).sortWithinPartitions(F.desc("ordinal")).write.parquet(f"{base}/in")
    events = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", at_once).parquet(f"{base}/in")
    best = incremental.live_running_best(events, "user_id")
    sink = best.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{base}/out")


@query("SELECT user_id, event, max(ordinal) AS ordinal, arg_max(step, ordinal) AS step FROM runlog GROUP BY user_id, event", "runlog")
def last_event(v: Views):
    return runs.last_events(v.runlog(), "user_id")


@query("SELECT user_id, coalesce(max(ordinal) FILTER (event = 'done') > max(ordinal) FILTER (event = 'validation'), false) AS in_order FROM runlog GROUP BY user_id", "runlog")
def log_order_check(v: Views):
    return runs.order_check(v.runlog(), "user_id")


@query(
    "SELECT user_id, 'duplicate_step' AS rule, sum(n)::BIGINT AS n FROM (SELECT user_id, step, count(*) AS n FROM runlog WHERE event = 'validation' GROUP BY ALL HAVING count(*) > 1) GROUP BY user_id UNION ALL SELECT user_id, 'bad_score', count(*) FROM runlog WHERE event = 'validation' AND NOT coalesce(macro BETWEEN 0 AND 1, false) GROUP BY user_id", "runlog"
)
def run_errors(v: Views):
    return runs.errors(v.runlog(), "user_id")


@query(
    "p AS (SELECT user_id, arm, seed, user_id % 11 = 0 AS failed, count(*) FILTER (event = 'ready') AS r, count(*) FILTER (event = 'validation') AS va, count(*) FILTER (event = 'checkpoint') AS ck, count(*) FILTER (event = 'done') AS d, max(ordinal) FILTER (event = 'validation') AS lv, max(ordinal) FILTER (event = 'done') AS ld FROM runlog GROUP BY ALL), s AS (SELECT *, CASE WHEN failed THEN 'exit_code' WHEN r = 0 THEN 'not_ready' WHEN va < 3 THEN 'missing_validations' WHEN ck = 0 THEN 'missing_checkpoints' WHEN d = 0 THEN 'not_done' WHEN NOT coalesce(ld > lv, false) THEN 'done_too_early' END AS reason FROM p) SELECT user_id, arm, seed, CASE WHEN reason IS NULL THEN 'complete' ELSE 'incomplete' END AS status, coalesce(reason, '') AS reason FROM s", "runlog"
)
def run_status(v: Views):
    """Every eleventh run has a non-zero exit code; the first failing rule is the reason."""
    log = v.runlog()
    exits = log.select(*_KEYS).distinct().withColumn("exitcode", (F.col("user_id") % 11 == 0).cast("int"))
    return runs.status(log, exits, 3, *_KEYS)


#: A run of the protocol for each user: (ordinal, event, step), and what is amiss by user_id % 20.
_PROTOCOL = [(0, "ready", None), (10, "validation", 3), (20, "checkpoint", 3), (30, "validation", 6), (40, "checkpoint", 6), (50, "validation", 9), (60, "checkpoint", 9), (70, "done", 9)]
_HORIZON, _TRAIN_ROWS, _VAL_ROWS = 9, 2230, 794
_AMISS = ["", "exit_code", "missing_ready", "total_steps", "missing_config", "val_every", "seed", "train_rows", "val_rows", "init_checkpoint", "bad_score", "duplicate_step", "unexpected_step", "missing_validations", "unverified_checkpoint", "missing_checkpoints", "not_done", "done_step", "done_too_early", ""]


def protocol_runs(v: Views):
    """(log, manifest) of runs by the protocol, most of them with one thing amiss."""
    d = F.col("run") % 20
    users = v.table("events").select(F.col("user_id").alias("run")).distinct()
    arm = F.when(d % 2 == 0, "gold_only").otherwise("public4k")
    manifest = users.select("run", arm.alias("arm"), F.col("run").alias("seed"), (d == 1).cast("int").alias("exitcode"))
    events = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(e).alias("event"), F.lit(s).cast("long").alias("s")) for o, e, s in _PROTOCOL])
    rows = manifest.select("run", "arm", F.explode(events).alias("e")).select("run", "arm", "e.*")
    is_ready, mid = F.col("event") == "ready", F.col("s") == 6
    gone = (is_ready & (d == 2)) | ((F.col("event") == "validation") & mid & (d == 13)) | ((F.col("event") == "checkpoint") & mid & (d == 15)) | ((F.col("event") == "done") & (d == 16))
    rows = rows.filter(~F.coalesce(gone, F.lit(False)))
    step = F.when((F.col("event") == "validation") & mid & (d == 11), 3).when((F.col("event") == "validation") & mid & (d == 12), 5).when((F.col("event") == "done") & (d == 17), 8).otherwise(F.col("s"))
    score = F.when((F.col("event") == "validation") & ~(mid & (d == 10)), ((F.col("run") * 7 + F.col("s") * 13) % 100) / 100.0)
    init = F.when((F.col("arm") == "public4k") != (d == 9), "start")
    config = F.when(is_ready & (d != 4), F.struct((F.col("run") + (d == 6).cast("int")).alias("seed"), F.when(d == 5, 4).otherwise(3).cast("long").alias("val_every"), init.alias("init_checkpoint")))
    of_ready = lambda value, k: F.when(is_ready, F.when(d == k, 1).otherwise(value)).cast("long")
    log = rows.select(
        "run", F.when((F.col("event") == "done") & (d == 18), 45).otherwise(F.col("o")).alias("ordinal"), "event", step.cast("long").alias("step"), score.alias("macro"), F.lit(None).cast("double").alias("best"),
        of_ready(_TRAIN_ROWS, 7).alias("train_rows"), of_ready(_VAL_ROWS, 8).alias("val_rows"), of_ready(_HORIZON, 3).alias("total_steps"),
        F.when(F.col("event") == "checkpoint", ~(mid & (d == 14))).alias("reload_verified"), config.alias("config"),
    )
    return log, manifest


@query(
    "u AS (SELECT DISTINCT user_id AS u, user_id % 20 AS d FROM events), r AS (SELECT u, d, ([" + ", ".join(f"'{x}'" for x in _AMISS) + "])[d + 1] AS reason, [((u * 7 + s * 13) % 100) / 100.0::DOUBLE FOR s IN [3, 6, 9]] AS m FROM u) SELECT CASE WHEN d % 2 = 0 THEN 'gold_only' ELSE 'public4k' END AS arm, u AS seed, CASE WHEN reason = '' THEN 'complete' WHEN reason IN ('bad_score', 'duplicate_step', 'unexpected_step') THEN 'error' ELSE 'incomplete' END AS status, reason, CASE WHEN reason = '' THEN 3 * list_position(m, list_max(m)) END::BIGINT AS chosen_step, CASE WHEN reason = '' THEN round(list_max(m), 9) END AS chosen_score, CASE WHEN reason = '' THEN round(m[3], 9) END AS final_score FROM r"
)
def run_reconcile(v: Views):
    """Runs by the full protocol, with the first rule that each breaks."""
    log, manifest = protocol_runs(v)
    full = runs.reconcile(log, manifest, _HORIZON, _TRAIN_ROWS, _VAL_ROWS)
    return full.withColumns({c: F.round(c, 9) for c in ("chosen_score", "final_score")})


_BEST = "b AS (SELECT arm, seed, max(macro) AS best_macro, arg_max(macro, (step, ordinal)) AS last_macro FROM runlog WHERE event = 'validation' GROUP BY user_id, arm, seed), pr AS (SELECT seed, max(best_macro) FILTER (arm = 'public4k') - max(best_macro) FILTER (arm = 'gold_only') AS best_diff, max(last_macro) FILTER (arm = 'public4k') - max(last_macro) FILTER (arm = 'gold_only') AS last_diff FROM b GROUP BY seed HAVING count(*) FILTER (arm = 'public4k') = 1 AND count(*) FILTER (arm = 'gold_only') = 1)"


def _paired(v: Views):
    return runs.paired(runs.best_checkpoint(v.runlog(), *_KEYS), "gold_only", "public4k")


@query(f"{_BEST} SELECT seed, round(best_diff, 9) AS best_diff, round(last_diff, 9) AS last_diff FROM pr", "runlog")
def paired_runs(v: Views):
    return _paired(v).select("seed", F.round("best_diff", 9).alias("best_diff"), F.round("last_diff", 9).alias("last_diff"))


@query(f"{_BEST} SELECT count(*) AS n, CASE WHEN count(*) >= 2 THEN round(avg(best_diff), 9) END AS best_diff, CASE WHEN count(*) >= 2 THEN round(avg(last_diff), 9) END AS last_diff FROM pr", "runlog")
def paired_mean(v: Views):
    mean = lambda c: F.when(F.count("*") >= 2, F.round(F.avg(c), 9)).alias(c)
    return _paired(v).agg(F.count("*").alias("n"), mean("best_diff"), mean("last_diff"))


@query("SELECT arm, seed, count(*) AS n FROM (SELECT DISTINCT user_id, arm, seed // 2 AS seed FROM runlog) GROUP BY arm, seed HAVING count(*) > 1", "runlog")
def duplicate_runs(v: Views):
    """Arms and (here halved) seeds with more than one run."""
    r = v.runlog().select("user_id", "arm", F.expr("seed div 2").alias("seed")).distinct()
    return joins.duplicates(r, "arm", "seed")


@query(f"{_BEST} SELECT seed, abs(best_diff - last_diff) <= 1e-9 AS same FROM pr", "runlog")
def receipt_reconcile(v: Views):
    """Whether best and last differences agree within 1e-9."""
    return _paired(v).select("seed", (F.abs(F.col("best_diff") - F.col("last_diff")) <= 1e-9).alias("same"))


#: What is wrong with the receipts of the seeds that have a number modulo this many.
_FAULTS = ["", "difference", "final_difference", "a_chosen", "b_final", "b_chosen", "duplicate_pair"]


def _receipts(v: Views):
    """Run receipts from the log, and pair receipts of which most state something wrong."""
    log = v.runlog().filter("event = 'validation' and macro is not null").withColumn("macro", F.least("macro", F.lit(1.0)))
    points = log.groupBy("arm", "seed", "step").agg(F.max("macro").alias("macro"))
    at = lambda c: F.max(F.struct("macro", (-F.col("step")).alias("back")))[c]
    made = points.groupBy("arm", "seed").agg(F.collect_list(F.struct("step", "macro")).alias("curve"), (-at("back")).alias("chosen_step"), at("macro").alias("chosen_score"), F.max_by("macro", "step").alias("final_score"))
    made = cut(made.withColumn("status", F.lit("complete")))
    side = lambda arm, name: made.filter(F.col("arm") == arm).select("seed", F.struct("chosen_step", "chosen_score", "final_score").alias(name))
    both = side("gold_only", "a").join(side("public4k", "b"), "seed")
    kind = F.pmod("seed", F.lit(len(_FAULTS)))
    off = lambda c, k, x: (F.col(c) + F.when(kind == k, x).otherwise(0)).alias(c.split(".")[-1])
    said = both.select(
        "seed", (F.col("b.chosen_score") - F.col("a.chosen_score") + F.when(kind == 1, 1e-6).otherwise(0)).alias("difference"), (F.col("b.final_score") - F.col("a.final_score") + F.when(kind == 2, 0.5).otherwise(0)).alias("final_difference"),
        F.struct(off("a.chosen_step", 9, 0), off("a.chosen_score", 3, 0.1), off("a.final_score", 9, 0)).alias("a"), F.struct(off("b.chosen_step", 5, 1), off("b.chosen_score", 9, 0), off("b.final_score", 4, -0.2)).alias("b"),
    )
    return made, said.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(kind == 6, 2).otherwise(1)))).drop("copy")


@query(f"v AS (SELECT DISTINCT arm, seed FROM runlog WHERE event = 'validation' AND macro IS NOT NULL), p AS (SELECT a.seed FROM v a JOIN v b USING (seed) WHERE a.arm = 'gold_only' AND b.arm = 'public4k') SELECT seed, ({_FAULTS!r})[(seed % {len(_FAULTS)} + 1)::INT] AS rule FROM p, range(2) t(k) WHERE k = 0 OR seed % {len(_FAULTS)} = 6", "runlog")
def receipt_pairs(v: Views):
    """The first rule that each pair's receipt breaks, its differences worked out again."""
    made, said = _receipts(v)
    return receipts.check_pairs(said, receipts.check_runs(made), "gold_only", "public4k")


_W = lambda k: f"(((c + 1) * ({k} + 3)) % 17 - 8) / 10.0"
_V = lambda k: f"(((c + 2) * ({k} + 5)) % 13 - 6) / 10.0"
_BUCKET = f"(length(w) * 7 + unicode(w)) % {scoring.BUCKETS}"
_SIDE_SCORES = f"SELECT doc_id, c, coalesce(avg({_W('k')}), 0)::DOUBLE AS w, coalesce(avg({_V('k')}), 0)::DOUBLE AS v FROM (SELECT doc_id, c, {_BUCKET} AS k FROM (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents), range(4) t(c)) GROUP BY ALL"
_PARTNER = "CASE WHEN (a.doc_id // 12 + 1) * 12 <= (SELECT count(*) FROM documents) THEN a.doc_id // 12 * 12 + (5 * a.doc_id + 7) % 12 ELSE a.doc_id END"


@query(
    f"sd AS MATERIALIZED ({_SIDE_SCORES}), pa AS (SELECT a.doc_id AS pair_id, b.doc_id AS other, a.doc_id % 3 > 0 AS masked FROM documents a JOIN documents b ON b.doc_id = {_PARTNER}), "
    "z AS (SELECT pair_id, x.c AS c, x.w + y.v AS z1, y.w + x.v AS z2 FROM pa JOIN sd x ON x.doc_id = pair_id JOIN sd y ON y.doc_id = other AND y.c = x.c WHERE NOT (masked AND x.c = 0)), "
    "s AS (SELECT pair_id, c, exp(z1) / sum(exp(z1)) OVER (PARTITION BY pair_id) AS p1, exp(z2) / sum(exp(z2)) OVER (PARTITION BY pair_id) AS p2 FROM z) "
    "SELECT pair_id, " + ", ".join(f"round(coalesce(sum((p1 + p2) / 2) FILTER (c = {c}), 0), 9) AS p{c}" for c in range(4)) + " FROM s GROUP BY pair_id"
)
def score_pairs(v: Views):
    """A linear model over hashed words, stored in the shared folder and read by the workers,
    scores all pairs of documents in both orders."""
    path = scratch(v.spark, "model")
    c, k = np.arange(4)[:, None], np.arange(scoring.BUCKETS)[None, :]
    scoring.save_linear(v.spark, (((c + 1) * (k + 3)) % 17 - 8) / 10.0, (((c + 2) * (k + 5)) % 13 - 6) / 10.0, path)
    d = v.table("documents")
    n = d.count()
    other = F.expr(f"if((doc_id div 12 + 1) * 12 <= {n}, doc_id div 12 * 12 + (5 * doc_id + 7) % 12, doc_id)")
    both = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a"), other.alias("j")).join(d.select(F.col("doc_id").alias("j"), F.col("text").alias("b")), "j")
    scored = scoring.score_linear(both.select("pair_id", "a", "b", (F.col("pair_id") % 3 > 0).alias("masked")), path, "pair_id")
    return scored.select("pair_id", *[F.round(F.col("p")[i], 9).alias(f"p{i}") for i in range(4)])
