"""Exact quantiles, unranked pairs, hot bands, the bootstrap by splitting, receipts, recovery and the linear scorer."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairmill.functions.hashing import object_key
from pairmill.operators import metrics, quantiles, ranking, receipts, scoring, similarity, unrank
from pairmill.sources import recover

# ---- quantiles


@pytest.mark.parametrize("kind", ["few", "ties", "wide", "one"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "READ_OUT", 200)
    rng = np.random.default_rng(3)
    x = {"few": rng.normal(size=7), "ties": np.concatenate([np.full(20_000, 5.0), rng.normal(size=20_000) * 10]), "wide": np.exp(rng.normal(size=30_000) * 40), "one": np.array([3.0])}[kind]
    cuts = [0.0, 0.001, 0.25, 0.5, 0.731, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 3, "v double").repartition(4)
    assert quantiles.quantiles(df, "v", cuts) == pytest.approx(np.quantile(x, cuts).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


# ---- unranking


def test_members_of_numbers(spark):
    far = [2**40, 2**52 + 12345, 2**60 + 99]
    df = spark.range(5000).union(spark.createDataFrame([(m,) for m in far], "id long"))
    got = {r["id"]: (r["i"], r["j"]) for r in df.select("id", *unrank.members(F.col("id"))).collect()}
    want = {j * (j - 1) // 2 + i: (i, j) for j in range(101) for i in range(j)}
    assert all(got[m] == want[m] for m in range(5000))
    for m in far:
        i, j = got[m]
        assert 0 <= i < j and j * (j - 1) // 2 + i == m


@pytest.mark.parametrize("space", [1, 2, 3, 64, 100, 1000])
def test_permutation_is_one(spark, space):
    bits = sum(unrank.widths(space))
    got = sorted(r["m"] for r in spark.range(1 << bits).select(unrank.permuted(F.col("id"), space, "s").alias("m")).collect())
    assert got == list(range(1 << bits)) and space <= 1 << bits


def test_exhaustive_draw_gives_each_pair_once(spark):
    sizes = [2, 1, 5, 30, 3, 2]
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    groups = spark.createDataFrame(list(zip(firsts, sizes)), "first long, n long")
    want = {(f, i, j) for f, n in zip(firsts, sizes) for j in range(n) for i in range(j)}
    rows = unrank.draw(groups, len(want), "x").collect()
    assert Counter((r["first"], r["i"], r["j"]) for r in rows) == Counter(dict.fromkeys(want, 1))
    some = {(r["first"], r["i"], r["j"]) for r in unrank.draw(groups, 100, "x").collect()}
    assert some < want and 60 < len(some) < 150
    assert unrank.draw(groups.filter("n < 2"), 10, "x").count() == 0


def test_draws_are_uniform(spark):
    groups = spark.createDataFrame([(0, 4), (4, 3)], "first long, n long")
    seen = Counter()
    frames = [unrank.draw(groups, 2, f"seed {k}").filter("t < 2") for k in range(60)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    for r in out.collect():
        seen[r["first"], r["i"], r["j"]] += 1
    assert len(seen) == 9 and max(seen.values()) < 6 * min(seen.values())


def test_nested_subsets(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("c"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    rows = ranking.nested_subsets(df, "c", (5, 20), "h", "id").collect()
    small, large = ({r["id"] for r in rows if r["size"] == s} for s in (5, 20))
    assert small < large and len(small) == 15 and len(large) == 60
    assert sorted(r["rank"] for r in rows if r["size"] == 20) == list(range(1, 61))


# ---- hot bands


def _hex(x: int) -> str:
    return f"{x:064x}"


def test_a_band_value_of_many_is_banded_again(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT_PAIRS", 400)
    rng = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(220), n))  # noqa: E731  the first digits stay
    base = [0xABCDEF123 << 220 | rng.getrandbits(220) for _ in range(700)]
    near = [flip(x, rng.randint(1, 10)) for x in base[:200]]
    values = list(dict.fromkeys([*base, *near]))
    df = spark.createDataFrame([(_hex(v),) for v in values], "h string")
    want = {tuple(sorted((_hex(x), _hex(y)))) for i, x in enumerate(values) for y in values[i + 1 :] if (x ^ y).bit_count() <= 8}
    assert {(r["a"], r["b"]) for r in similarity.hamming_self(df, "h", 64, 8).collect()} == want and len(want) > 100
    left, right = df.limit(0).union(spark.createDataFrame([(_hex(v),) for v in base], "h string")), spark.createDataFrame([(_hex(v),) for v in near + base[:3]], "h string")
    cross = {(_hex(x), _hex(y)) for x in base for y in [*near, *base[:3]] if (x ^ y).bit_count() <= 8}
    assert {(r["a"], r["b"]) for r in similarity.hamming_cross(left, right, "h", 64, 8).collect()} == cross


# ---- receipts


def _runs(spark, rows):
    return spark.createDataFrame(rows, "arm string, seed long, status string, chosen_step long, chosen_score double, final_score double, curve array<struct<step:long,macro:double>>")


GOOD = [(2, 0.5), (4, 0.6), (6, 0.55)]


def test_run_receipts(spark):
    cases = {
        "": ("complete", 4, 0.6, 0.55, GOOD),
        "status": ("odd", 4, 0.6, 0.55, GOOD),
        "no_curve": ("complete", 4, 0.6, 0.55, []),
        "bad_score": ("complete", 4, 0.6, 0.55, [(2, 0.5), (4, 1.6), (6, 0.55)]),
        "duplicate_step": ("complete", 4, 0.6, 0.55, [(2, 0.5), (2, 0.6), (4, 0.6)]),
        "steps": ("complete", 4, 0.6, 0.55, [(2, 0.5), (4, 0.6), (5, 0.55)]),
        "chosen_step": ("complete", 3, 0.6, 0.55, GOOD),
        "chosen_score": ("complete", 4, 0.6 + 1e-6, 0.55, GOOD),
        "final_score": ("complete", 4, 0.6, None, GOOD),
    }
    rows = [("a", i, *case) for i, case in enumerate(cases.values())] + [("a", 90, *cases[""]), ("a", 90, *cases[""]), ("a", 91, "incomplete", None, None, None, None)]
    got = {r["seed"]: r["rule"] for r in receipts.check_runs(_runs(spark, rows), 6, [2, 4, 6]).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases) and got[90] == "duplicate_run" and got[91] == ""
    assert receipts.check_runs(_runs(spark, [("a", 1, "complete", 4, 0.6, 0.55, GOOD)]), 8).first()["rule"] == "no_final"


def test_pair_receipts(spark):
    runs = receipts.check_runs(_runs(spark, [(arm, s, "complete", 4, x, 0.55, [(2, 0.5), (4, x), (6, 0.55)]) for s in range(9) for arm, x in (("g", 0.6), ("p", 0.7)) if (arm, s) != ("p", 8)]))
    a, b = (4, 0.6, 0.55), (4, 0.7, 0.55)
    rows = [(0, a, b, 0.1, 0.0), (1, a, b, 0.2, 0.0), (2, a, b, 0.1, float("nan")), (3, (2, 0.6, 0.55), b, 0.1, 0.0), (4, a, (4, 0.7, 0.5), 0.1, 0.0), (5, a, b, 0.1, 0.0), (5, a, b, 0.1, 0.0), (6, a, b, None, 0.0), (7, a, b, 0.1 + 1e-12, 0.0), (8, a, b, 0.1, 0.0)]
    side = "struct<chosen_step:long,chosen_score:double,final_score:double>"
    got = {r["seed"]: r["rule"] for r in receipts.check_pairs(spark.createDataFrame(rows, f"seed long, a {side}, b {side}, difference double, final_difference double"), runs, "g", "p").collect()}
    assert got == {0: "", 1: "difference", 2: "final_difference", 3: "a_chosen", 4: "b_final", 5: "duplicate_pair", 6: "difference", 7: "", 8: "b_incomplete"}


# ---- recovery


def test_recovery_is_whole_or_an_error(spark):
    rows = [(1, "YQ=="), (2, "Yg=="), (3, "!!"), (4, "YQ=="), (5, "YQ=="), (5, "YQ==")]
    raw = spark.createDataFrame(rows, "id long, cell string").withColumn("md5", object_key(F.when(F.col("id") == 2, "b").otherwise("a")))
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert {r["id"]: bytes(r["bytes"]) for r in recover.recover(pick(1, 2, 4), raw, "id").collect()} == {1: b"a", 2: b"b", 4: b"a"}
    for ids, said in (((3,), "3: no base64"), ((5,), "5: more rows"), ((9,), "9: no such row")):
        with pytest.raises(Exception, match=said):
            recover.recover(pick(1, *ids), raw, "id").collect()
    with pytest.raises(Exception, match="2: bytes of another md5"):
        recover.recover(pick(2), raw.withColumn("md5", F.lit("0" * 32)), "id").collect()
    with pytest.raises(ValueError, match="1 is selected twice"):
        recover.recover(pick(1, 1), raw, "id")
    assert recover.recover(pick(), raw, "id").collect() == []


# ---- scorer


def test_linear_scorer_against_plain_python(spark, tmp_path):
    rng = np.random.default_rng(1)
    first, second = rng.normal(size=(4, scoring.BUCKETS)), rng.normal(size=(4, scoring.BUCKETS))
    scoring.save_linear(spark, first, second, f"{tmp_path}/m")
    texts = ["one two two", "", None, "é😀x  y", "word " * 500]
    rows = [(i * 5 + j, a, b, (i + j) % 2 == 0) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    got = {r["k"]: r["p"] for r in scoring.score_linear(spark.createDataFrame(rows, "k long, a string, b string, masked boolean"), f"{tmp_path}/m", "k").collect()}

    def mean(t, w):
        ks = [(len(x) * 7 + ord(x[0])) % scoring.BUCKETS for x in (t or "").split(" ") if x]
        return sum((w[:, k] for k in ks), np.zeros(4)) / max(1, len(ks))

    for k, a, b, masked in rows:
        p = np.zeros(4)
        for x, y in ((a, b), (b, a)):
            z = mean(x, first) + mean(y, second)
            e = np.exp(z - z.max())
            e[0] = 0 if masked else e[0]
            p += e / e.sum() / 2
        assert got[k] == pytest.approx(p.tolist(), abs=1e-12) and math.isclose(sum(got[k]), 1)
    assert scoring.word_means(pa.array([], pa.string()), first).shape == (0, 4)


# ---- bootstrap by splitting


def test_split_weights_have_the_law_of_draws_with_replacement():
    groups, draws, size = 37, 4000, 8
    w = np.concatenate([np.concatenate(list(metrics.block_weights("s", draws, groups, b, size))) for b in range(5)], axis=1)
    assert w.shape == (draws, groups) and (w.sum(1) == groups).all()
    assert np.abs(w.mean(0) - 1).max() < 0.08 and np.abs(w.var(0) - (1 - 1 / groups)).max() < 0.15
    c = np.cov(w.T)
    assert abs(c[~np.eye(groups, dtype=bool)].mean() + 1 / groups) < 0.002
    many = next(metrics.block_weights("s", 3, 1_000_000, 500))
    assert many.shape == (3, metrics.BLOCK) and abs(many.mean() - 1) < 0.1


def test_split_bootstrap_agrees_with_the_slots(spark):
    rng = np.random.default_rng(8)
    rows = [(m, f"g{g}", int(y), int(y if rng.random() < right else rng.integers(0, 4)), 1) for g in range(60) for y in rng.integers(0, 4, 3) for m, right in (("a", 0.5), ("b", 0.8))]
    cells = spark.createDataFrame(rows, "model string, group_id string, y long, p long, n long").groupBy("model", "group_id", "y", "p").agg(F.sum("n").alias("n"))
    one, two = (sorted(map(tuple, metrics.split_bootstrap(cells.repartition(k), 300).collect())) for k in (1, 6))
    assert one == two and len(one) == 600
    a, b = (metrics.interval(f(cells, 2000), "a", "b").first() for f in (metrics.split_bootstrap, metrics.cluster_bootstrap))
    assert all(abs(x - y) < 0.015 for x, y in zip(a, b))
