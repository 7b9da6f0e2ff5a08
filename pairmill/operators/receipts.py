"""Receipts of paired runs: every number that a receipt states is worked out again.

A run's receipt has its validation curve and the scores chosen from it; a pair's has both runs'
scores and their differences. A check gives each receipt the first rule that it breaks, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers agree within this.
TOLERANCE = 1e-9


def _apart(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > TOLERANCE, F.lit(True))


def _score(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & x.between(0, 1), F.lit(False))


def _first(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules], F.lit(""))


def check_runs(runs: DataFrame, horizon: int | None = None, steps: list[int] | None = None) -> DataFrame:
    """`runs` (arm, seed, status, chosen_step, chosen_score, final_score, curve of (step, macro))
    with `rule`. Without a horizon, a run's last step is its end."""
    copies = runs.groupBy(F.col("arm").alias("__a"), F.col("seed").alias("__s")).agg(F.count("*").alias("__n"))
    curve, chosen = F.col("curve"), F.col("chosen_step")
    end = F.array_max(F.transform(curve, lambda e: e["step"])) if horizon is None else F.lit(horizon)
    at = lambda step: F.get(F.filter(curve, lambda e: e["step"] == step), F.lit(0))["macro"]
    own = F.array_sort(F.transform(curve, lambda e: e["step"]))
    done = F.col("status") == "complete"
    rules = [
        ("duplicate_run", F.col("__n") > 1),
        ("status", ~F.coalesce(F.col("status").isin("complete", "incomplete"), F.lit(False))),
        ("no_curve", done & (F.coalesce(F.size(curve), F.lit(0)) <= 0)),
        ("bad_score", done & F.exists(curve, lambda e: ~_score(e["macro"]))),
        ("duplicate_step", done & (F.size(F.array_distinct(own)) < F.size(own))),
        *([("steps", done & (own != F.array(*[F.lit(s).cast("long") for s in sorted(steps)])))] if steps else []),
        ("chosen_step", done & at(chosen).isNull()),
        ("chosen_score", done & _apart(F.col("chosen_score"), at(chosen))),
        ("no_final", done & at(end).isNull()),
        ("final_score", done & _apart(F.col("final_score"), at(end))),
    ]
    full = runs.join(copies, F.col("arm").eqNullSafe(F.col("__a")) & F.col("seed").eqNullSafe(F.col("__s")))
    return full.withColumn("rule", _first(rules)).drop("__n", "__a", "__s")


def check_pairs(pairs: DataFrame, runs: DataFrame, a: str, b: str) -> DataFrame:
    """(seed, rule) for each pair receipt (seed, a, b, difference, final_difference), `a` and `b`
    structs (chosen_step, chosen_score, final_score), against sound runs of the two arms."""
    sound = runs.filter("status = 'complete' and rule = ''")
    side = lambda arm, name: sound.filter(F.col("arm") == arm).select("seed", F.struct("chosen_step", "chosen_score", "final_score").alias(name))
    copies = pairs.groupBy("seed").agg(F.count("*").alias("__n"))
    full = pairs.join(copies, "seed").join(side(a, "run_a"), "seed", "left").join(side(b, "run_b"), "seed", "left")
    rules: list[tuple[str, Column]] = [("duplicate_pair", F.col("__n") > 1)]
    for s in ("a", "b"):
        said, run = F.col(s), F.col(f"run_{s}")
        rules += [
            (f"{s}_incomplete", run.isNull()),
            (f"{s}_chosen", ~said["chosen_step"].eqNullSafe(run["chosen_step"]) | _apart(said["chosen_score"], run["chosen_score"])),
            (f"{s}_final", _apart(said["final_score"], run["final_score"])),
        ]
    rules += [
        ("difference", _apart(F.col("difference"), F.col("b.chosen_score") - F.col("a.chosen_score"))),
        ("final_difference", _apart(F.col("final_difference"), F.col("b.final_score") - F.col("a.final_score"))),
    ]
    return full.select("seed", _first(rules).alias("rule"))
