"""Operators against brute force, goldens and invariants."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.functions import hashing, imaging, probability, text
from pairmill.operators import expect, joins, metrics, pairs, ranking, runs, scoring, similarity, splits
from pairmill.operators.components import connected_components
from pairmill.sources import blobs, readers
from pairmill.streaming import incremental


def _union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 50)] + [(100, 101), (101, 102), (7, 7)],
    [],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {k: v for k, v in _union_find([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_random_graphs_and_nulls(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None), edges[0]], "src long, dst long")
    want = _union_find([e for e in edges if e[0] != e[1]])
    for parts in (1, 8):
        assert {r["node"]: r["component"] for r in connected_components(df.repartition(parts)).collect()} == want


def test_components_keep_size_estimates_small(spark, capsys):
    """A dozen rounds: the planner's estimates must not be the product of all rounds' estimates."""
    n = 3000
    df = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(df)
    got.explain("cost")
    powers = [int(x) for x in re.findall(r"sizeInBytes=[\d.]+E\+(\d+)", capsys.readouterr().out)]
    assert max(powers, default=0) < 100
    assert got.filter("component = 0").count() == n


@pytest.mark.parametrize("share", [1000, 4])
def test_join_hot_meets_hot_cold_and_null_keys(spark, monkeypatch, share):
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    keys = [1] * 500 + [2] * 300 + [*range(3, 60)] * 3 + [None] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k long").repartition(7)
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("k") * 10).alias("v")).filter("k <> 59")
    got = joins.join_hot(rows, per_key, "k", "n")
    assert got.columns == ["k", "id", "v"]
    assert sorted((r["id"], r["k"], r["v"]) for r in got.collect()) == [(i, k, k * 10) for i, k in enumerate(keys) if k not in (None, 59)]
    assert joins.join_hot(rows.limit(0), per_key.limit(0), "k", "n").count() == 0


def test_hamming_256_bits_radius_8(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(256) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(256), rng.randrange(1, 14))) for b in base]
    sigs = [f"{x:064x}" for x in base + near] + [None, f"{base[0]:064x}"]
    df = spark.createDataFrame([(s,) for s in sigs], "sig string")
    got = {(r["a"], r["b"]): r["distance"] for r in similarity.hamming_self(df, "sig", 64, 8).collect()}
    every = sorted({s for s in sigs if s})
    want = {(a, b): d for i, a in enumerate(every) for b in every[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 8}
    assert got == want and want


def test_greedy_matching_equals_the_sequential_scan(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    rows = [(p, q, f"{rng.getrandbits(64):016x}") for p, q in edges]
    used, want = set(), []
    for p, q, h in sorted(rows, key=lambda r: r[2]):
        if p not in used and q not in used:
            used |= {p, q}
            want.append((p, q))
    df = spark.createDataFrame(rows, "p long, q long, h string")
    assert [(r["p"], r["q"]) for r in splits.greedy_matching(df, 7).orderBy("h").collect()] == want[:7]


def test_budget_fill_counts_seeded_nodes(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(41)], "n string")
    chosen = splits.budget_fill(nodes, "n", nodes.filter("n = 'n5'"), "s").filter("chosen").collect()
    assert len(chosen) == 3 and "n5" in {r["n"] for r in chosen}


def _cells(spark, matrix):
    return spark.createDataFrame([(y, p, n) for y, row in enumerate(matrix) for p, n in enumerate(row)], "y long, p long, n long")


def test_macro_f1_golden(spark):
    m = _cells(spark, [[185, 5, 2, 2], [15, 117, 56, 12], [5, 32, 125, 40], [0, 4, 25, 169]])
    assert metrics.macro_f1(m).first()["macro_f1"] == pytest.approx(0.7483890086277655, abs=1e-12)
    f1 = [r["f1"] for r in metrics.class_f1(m).orderBy("label").collect()]
    assert f1 == pytest.approx([0.92732, 0.65363, 0.60976, 0.80285], abs=1e-5)


def test_macro_f1_counts_absent_classes(spark):
    m = metrics.macro_f1(_cells(spark, [[0, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 5]]).filter("n > 0")).first()
    assert (m["macro_f1"], m["active_macro_f1"]) == (0.75, 1.0)


def test_bootstrap_shares_draws_and_repeats(spark):
    rng = random.Random(2)
    rows = [(m, f"g{g}", rng.randrange(4), rng.randrange(4), rng.randrange(1, 4)) for m in "ab" for g in range(12) for _ in range(5)]
    cells = spark.createDataFrame(rows, "model string, group_id string, y int, p int, n long").groupBy("model", "group_id", "y", "p").agg(F.sum("n").alias("n"))
    same = cells.filter("model = 'a'").unionByName(cells.filter("model = 'a'").withColumn("model", F.lit("c")))
    draws = metrics.cluster_bootstrap(same, 30)
    assert draws.count() == 60
    i = metrics.interval(draws, "a", "c").first()
    assert (i["low"], i["high"]) == (0.0, 0.0)
    one, two = (sorted(map(tuple, metrics.cluster_bootstrap(cells.repartition(k), 20).collect())) for k in (1, 6))
    assert [x[:2] for x in one] == [x[:2] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two])


def test_bootstrap_shuffles_slots_once(spark, capsys):
    """Slots aren't counted per draw and group before they meet the groups' cells."""
    rows = [(m, f"g{g}", (g + len(m)) % 4, g % 3, 1 + g % 2) for m in ("a", "bb") for g in range(9)] + [("a", "g1", 3, 3, 5)]
    cells = spark.createDataFrame(rows, "model string, group_id string, y int, p int, n long")
    draws = metrics.cluster_bootstrap(cells, 7)
    draws.explain()
    assert not re.search(r"keys=\[draw#\d+L?, g#", capsys.readouterr().out)
    order = sorted({r[1] for r in rows}, key=lambda g: hashlib.md5(g.encode()).hexdigest())
    want = {}
    for d in range(7):
        slots = [order[int(hashlib.md5(f"bootstrap:{d}:{s}".encode()).hexdigest()[:12], 16) % 9] for s in range(9)]
        for m in ("a", "bb"):
            own = [(y, p, n * slots.count(g)) for model, g, y, p, n in rows if model == m]
            f1 = 0.0
            for k in range(4):
                size = sum(n for y, _, n in own if y == k) + sum(n for _, p, n in own if p == k)
                f1 += 2 * sum(n for y, p, n in own if y == p == k) / size / 4 if size else 0.0
            want[m, d] = f1
    got = {(r["model"], r["draw"]): r["macro_f1"] for r in draws.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_near_reject_shuffles_no_captions(spark, capsys):
    rows = [(0, "a" * 50, "p0", "0" * 64), (1, "a" * 50, "p1", "f" * 64), (2, "b", "p2", "0f" * 32), (3, None, "p2", None), (4, "c", None, "0" * 63 + "3")]
    figures = spark.createDataFrame(rows, "uuid long, cap_norm string, px_md5 string, dhash string")
    ids = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "uuid_a long, uuid_b long")
    got = pairs.reject_near(ids, figures)
    got.explain()
    assert "md5(cast(cap_norm" in capsys.readouterr().out
    assert sorted(map(tuple, got.collect())) == [(0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]


def test_argmax_ties_and_masks(spark):
    df = spark.createDataFrame([([0.25, 0.25, 0.25, 0.25],), ([0.0, 0.5, 0.5, 0.0],)], "p array<double>")
    assert [r[0] for r in df.select(probability.argmax_class(F.col("p"))).collect()] == [0, 1]
    z = spark.createDataFrame([(9.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    assert z.select(probability.masked_softmax(cols, F.lit(True))).first()[0] == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3])


@pytest.mark.parametrize("p, masked, fine", [
    ([0.25, 0.25, 0.25, 0.25], False, True), ([0.1, 0.3, 0.3, 0.3], True, False), ([float("nan"), 1.0, 0.0, 0.0], False, False),
    ([float("inf"), 0.0, 0.0, 0.0], False, False), ([-0.1, 0.5, 0.3, 0.3], False, False), ([0.5, 0.4, 0.0, 0.0], False, False), ([0.5, 0.5], False, False), (None, False, False),
])
def test_probability_rules(spark, p, masked, fine):
    df = spark.createDataFrame([(p,)], "p array<double>")
    assert df.select(probability.valid(F.col("p"), F.lit(masked))).first()[0] is fine


def test_assembly_truth_table(spark):
    of = lambda rows: spark.createDataFrame(rows, "id long, p array<double>")
    original, reverse = of([(3, [0.0, 0.6, 0.4, 0.0])]), of([(3, [0.0, 0.1, 0.9, 0.0])])
    mean = scoring.orientation_mean(original, reverse, "id")
    template = spark.createDataFrame([(3,), (1,)], "id long")
    got = {r["id"]: tuple(r)[1:] for r in scoring.assemble(template, [mean, of([(1, [1.0, 0.0, 0.0, 0.0])])], "id").collect()}
    assert got == {3: (0, 0, 1, 0), 1: (1, 0, 0, 0)}
    with pytest.raises(Exception, match="orientation"):
        scoring.orientation_mean(original, of([(4, [0.0, 1.0, 0.0, 0.0])]), "id").collect()
    with pytest.raises(Exception, match="without scores"):
        scoring.assemble(template, [mean], "id").collect()


def test_scorer_keeps_keys(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, x double").repartition(3)
    got = scoring.score(df, lambda f: np.stack([0 * f["x"], f["x"], -f["x"], 0 * f["x"]], axis=1), "id", masked=True)
    rows = {r["id"]: r["p"] for r in got.collect()}
    assert len(rows) == 9 and all(p[0] == 0 and abs(sum(p) - 1) < 1e-9 for p in rows.values()) and rows[8][1] > 0.99


@pytest.mark.parametrize("raw, want", [("  A\tB  C\x1cD ", "a b c d"), ("", ""), (None, None)])
def test_normalize_caption(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.normalize_caption(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    (" HTTPS://doi.org/10.1/A ", "10.1/a"), ("http://doi.org/10.1/x", "10.1/x"), ("doi.org/10.1/x", "10.1/x"), ("\u2003doi.org/ 10.1/x\x1c", "10.1/x"),
    ("doi:10.1/x", "doi:10.1/x"), ("http://dx.doi.org/10.1/x", "http://dx.doi.org/10.1/x"), ("10.1/doi.org/", "10.1/doi.org/"), ("doi.org/doi.org/1", "doi.org/1"), ("", ""), (None, None),
])
def test_normalize_doi(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.normalize_doi(F.col("x"))).first()[0] == want


def test_learning_rate_by_hand(spark):
    # 837 steps: 25 of warm-up; cosine over all steps with a floor of 5 %
    got = {r["id"]: r["lr"] for r in spark.range(838).select("id", probability.learning_rate(F.col("id"), 837, 1.0).alias("lr")).collect()}
    assert got[0] == pytest.approx(1 / 25) and got[400] == pytest.approx(0.557956, abs=1e-5) and got[837] == pytest.approx(0.05)
    assert got[24] == pytest.approx(0.99807, abs=1e-5)
    one = spark.range(1).select(probability.learning_rate(F.col("id"), 1, 2.0).alias("lr")).first()["lr"]
    assert one == pytest.approx(2.0)
    assert probability.validation_steps(837) == [279, 558, 837] and probability.validation_steps(10) == [10]


def test_prompts(spark):
    df = spark.createDataFrame([("x" * 2500, "B %s {a}"), (None, "b")], "a string, b string")
    cols = [text.render_prompt(k, F.col("a"), F.col("b")).alias(k) for k in ("cxi", "ixi", "cxc")]
    full, null = df.select(*cols).collect()
    assert full["cxi"] == "Caption A: " + "x" * 2400 + "\nQuestion: what is the relation of this figure to the caption?"
    assert full["cxc"] == "Caption A:\n" + "x" * 2400 + "\n\nCaption B:\nB %s {a}\n\nAre Caption A and Caption B from the same paper, related papers, or unrelated papers?"
    assert full["ixi"] == "Figure A:<image>Figure B:<image>Are Figure A and Figure B from the same paper, related papers, or unrelated papers?"
    assert null["cxi"] is None and null["ixi"] == full["ixi"]
    assert [r[0] for r in df.select(text.caption_valid(F.col("b"), ("%s", ""))).collect()] == [False, True]


def test_manifest_digest_is_that_of_the_joined_lines(spark):
    lines = sorted(f"{hashlib.md5(str(i).encode()).hexdigest()}:{i}" for i in range(500))
    df = spark.createDataFrame([(x,) for x in lines], "l string").repartition(7)
    row = blobs.ordered_digest(df, F.col("l"), F.col("l")).first()
    assert (row["sha256"], row["rows"]) == (hashlib.sha256("\n".join(lines).encode()).hexdigest(), 500)
    same = spark.createDataFrame([("k", str(i % 3)) for i in range(40)], "o string, l string").repartition(5)
    want = hashlib.sha256(("\n".join(sorted(str(i % 3) for i in range(40))) + "\n").encode()).hexdigest()
    assert blobs.ordered_digest(same, F.col("l"), F.col("o"), end="\n").first()["sha256"] == want
    assert tuple(blobs.ordered_digest(same.limit(0), F.col("l"), F.col("o"), end="\n").first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_manifest_reader_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"expected_horizon": 9,\n "runs": [{"arm": "a", "seed": 1}]}')
    schema = "expected_horizon long, runs array<struct<arm:string,seed:long>>"
    assert readers.read_manifest(spark, str(tmp_path / "m.json"), schema, "runs").first()["runs"][0]["seed"] == 1
    with pytest.raises(ValueError, match="^m.json: other is missing$"):
        readers.read_manifest(spark, str(tmp_path / "m.json"), "other string", "other")
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ValueError, match="^broken.json: not one JSON object"):
        readers.read_manifest(spark, str(tmp_path / "broken.json"), schema)
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("",), (None,)], "doi string")
    readers.write_lines(df, "doi", str(tmp_path / "lines"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b"]
    readers.write_csv_once(df.withColumn("n", F.lit(1)), str(tmp_path / "csv"))
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_csv_once(df.limit(1), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5
    assert readers.caption_column(["y", "cap_norm", "cap_text"], "cap_text", "cap_norm") == "cap_text"
    with pytest.raises(ValueError, match="none of"):
        readers.caption_column(["y"], "cap_text", "cap_norm")
    assert readers.without_labels(df) is df
    with pytest.raises(ValueError, match="target"):
        readers.without_labels(df.withColumn("target", F.lit(1)))


def test_task_binding():
    want = {"cxi": "c1", "ixi": "i1"}
    marks = {"ixi": "two images", "cxc": "two captions"}
    scoring.check_binding("ixi", "i1", want, list(text.LABELS), marks["ixi"], marks)
    scoring.check_binding("cxi", "c1", want, list(text.LABELS), None, marks)
    for args in (("cxc", "c1", want, list(text.LABELS), None), ("cxi", "i1", want, list(text.LABELS), None), ("cxi", "c1", want, list(text.LABELS[::-1]), None), ("cxi", "c1", want, list(text.LABELS), marks["ixi"]), ("ixi", "i1", want, list(text.LABELS), None)):
        with pytest.raises(ValueError):
            scoring.check_binding(*args, marks)


def test_reconcile_names_each_rule(spark, sf_dir):
    from pairmill.plans import evaluation
    from pairmill.plans.fixtures import Views

    log, manifest = evaluation.protocol_runs(Views(spark, sf_dir))
    got = {r["seed"]: r for r in runs.reconcile(log, manifest, 9, 2230, 794).collect()}
    assert got and all(r["reason"] == evaluation._AMISS[s % 20] for s, r in got.items())
    odd = spark.createDataFrame([(1, 0, "ready", None, 1), (1, 1, "validation", None, None)], "run long, ordinal int, event string, step long, x int")
    full = odd.select("run", "ordinal", "event", "step", F.lit(0.5).alias("macro"), F.lit(2.0).alias("best"), *[F.lit(v).cast("long").alias(c) for c, v in (("train_rows", 5), ("val_rows", 6), ("total_steps", 4))], F.lit(None).cast("boolean").alias("reload_verified"), F.expr("named_struct('seed', 1L, 'val_every', 4L, 'init_checkpoint', cast(null as string))").alias("config"))
    runs_of = spark.createDataFrame([(1, "gold_only", 1, 0), (2, "gold_only", 2, 0)], "run long, arm string, seed long, exitcode int")
    assert {r["seed"]: (r["status"], r["reason"]) for r in runs.reconcile(full, runs_of, 4, 5, 6).collect()} == {1: ("error", "validation_without_step"), 2: ("incomplete", "missing_ready")}


def test_gradient_hash_of_a_larger_image():
    # a ramp rises everywhere; its mirror nowhere; a wide step has one rise a row
    ramp = np.repeat(np.repeat(np.arange(0, 170, dtype=np.uint8)[None, :, None], 90, axis=0), 3, axis=2)
    assert imaging.gradient_hash(ramp) == "f" * 64 and imaging.gradient_hash(ramp[:, ::-1]) == "0" * 64
    weights = imaging._resample(170, 17)
    assert np.abs(weights.sum(1) - (1 << 22)).max() < 100 and (weights < 0).any()


def test_near_images_join_papers(spark):
    base = "a" * 64
    rows = [("d1", base), ("d2", "b" + base[1:]), ("d3", "0" * 64), ("d4", None), ("d5", base)]
    f = spark.createDataFrame(rows, "doi string, dhash string")
    near = similarity.hamming_self(f, "dhash", 64, 8)
    edges = splits.near_edges(f, "doi", "dhash", near).unionByName(splits.content_edges(f, "doi", ["dhash"]))
    got = {r["doi"]: r["component"] for r in splits.components(f, "doi", edges).collect()}
    assert got == {"d1": "d1", "d2": "d1", "d5": "d1", "d3": "d3", "d4": "d4"}


def test_drawing_fills_classes_or_fails(spark):
    figures = [(i, f"10.1/j{i % 2}/d{i // 4}", f"caption {i}", f"b{i}", f"p{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(80)]
    f = spark.createDataFrame(figures, "uuid long, doi string, cap_norm string, bytes_md5 string, px_md5 string, dhash string")
    doi = {i: d for i, d, *_ in figures}
    papers = sorted(set(doi.values()))
    cited = {tuple(sorted((papers[i], papers[i + 1]))) for i in range(0, 20, 2)} | {tuple(sorted((papers[i], papers[i + 2]))) for i in range(0, 16, 4)}
    e = spark.createDataFrame(sorted(cited), "src string, dst string")
    make = lambda parts: pairs.generate(pairs.Pool(f.repartition(parts), e, text.journal(F.col("doi"))), f, e, 20, "s")
    rows = make(3).collect()
    assert len(rows) == 80 and len({r["ident"] for r in rows}) == 80
    for r in rows:
        a, b = doi[r["uuid_a"]], doi[r["uuid_b"]]
        y = 0 if r["uuid_a"] == r["uuid_b"] else 1 if a == b else 2 if tuple(sorted((a, b))) in cited else 3
        assert y == r["y"]
        if r["mode"] == pairs.Pool.JOURNAL:
            assert a.split("/")[:2] == b.split("/")[:2]
    assert sorted((r["mode"] for r in rows if r["y"] == 3)).count(pairs.Pool.RANDOM) == 7
    assert sorted(map(tuple, make(8).collect())) == sorted(map(tuple, rows))
    with pytest.raises(ValueError, match="class 0"):
        pairs.generate(pairs.Pool(f.limit(5), e, text.journal(F.col("doi"))), f, e, 20, "s")


def test_range_rank_with_a_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = ranking.range_rank(df.repartition(6), "k", "id").collect()
    assert sorted(r["rank"] for r in got) == list(range(500))
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["k"], r["id"]) for r in got)


def test_md5_format_rejects_a_trailing_newline(spark):
    df = spark.createDataFrame([("0" * 32,), ("0" * 32 + "\n",), ("A" * 32,), (None,)], "x string")
    assert [r[0] for r in df.select(hashing.is_md5(F.col("x"))).collect()] == [True, False, False, False]


def test_global_rank(spark):
    df = spark.range(300).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    got = {r["id"]: r["rank"] for r in ranking.global_rank(df.repartition(5), "h", "id").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r["id"] for r in df.orderBy("h", "id").collect()]
    assert sorted(got.values()) == list(range(1, 301))


def test_joins_check_their_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(ValueError, match="partner"):
        joins.left_join_validated(a, b, "k")
    with pytest.raises(ValueError, match="unique"):
        joins.left_join_validated(a, b.union(b), "k")
    with pytest.raises(ValueError, match="missing"):
        joins.lookup(a, b, "k")
    assert joins.coverage(a, b, "k").first().asDict() == {"missing": 1, "extra": 0}


def test_null_and_empty_keys_never_match(spark):
    a = spark.createDataFrame([(1, None, ""), (2, "m", "c")], "i long, px string, cap string")
    b = spark.createDataFrame([(7, None, ""), (8, "m", "d")], "j long, px string, cap string")
    assert [tuple(r) for r in joins.match_any_key(a, b, "i", "j", ["px", "cap"]).collect()] == [(2, 8, "px")]


def test_first_source_wins(spark):
    of = lambda v: spark.createDataFrame([("k", v), (v, v)], "key string, v string")
    got = {r["key"]: r["v"] for r in joins.first_of_sources([of("a"), of("b")], "key").collect()}
    assert got == {"k": "a", "a": "a", "b": "b"}


def test_pair_sampling_invariants(spark):
    figures = [(i, f"d{i // 3}", f"caption {i % 17}", f"b{i}", f"p{i % 19}") for i in range(60)]
    f = spark.createDataFrame(figures, "uuid long, doi string, cap_norm string, bytes_md5 string, px_md5 string").withColumn("dhash", F.sha2(F.col("px_md5").cast("binary"), 256))
    e = spark.createDataFrame([("d0", "d1"), ("d2", "d7"), ("d10", "d3")], "src string, dst string")
    frames = [pairs.same_figure(f, "s"), pairs.same_paper(f, "s"), pairs.related(f, e, "s"), pairs.without_direct(pairs.shifted(f, "s", [1, 5]), e)]
    took = pairs.accept_in_order([pairs.with_identity(x, f) for x in frames], 10)
    rows = took.collect()
    assert len({r["ident"] for r in rows}) == len(rows) and all(sum(r["y"] == y for r in rows) <= 10 for y in range(4))
    doi = {i: d for i, d, *_ in figures}
    cited = {("d0", "d1"), ("d2", "d7"), ("d10", "d3")}
    for r in rows:
        a, b = doi[r["uuid_a"]], doi[r["uuid_b"]]
        y = 0 if r["uuid_a"] == r["uuid_b"] else 1 if a == b else 2 if (a, b) in cited or (b, a) in cited else 3
        assert y == r["y"]
    again = pairs.accept_in_order([pairs.with_identity(x.repartition(7), f) for x in frames], 10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert all(r["cap_a"] != r["cap_b"] for r in pairs.reject_near(frames[2], f).join(f.selectExpr("uuid as uuid_a", "cap_norm as cap_a"), "uuid_a").join(f.selectExpr("uuid as uuid_b", "cap_norm as cap_b"), "uuid_b").collect())


def _png(px: np.ndarray, palette: np.ndarray | None = None) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w, c = px.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, w * c)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    colours = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + colours + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _bmp(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    lines = b"".join(r[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for r in px[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(lines), 2835, 2835, 0, 0) + lines


def test_images_of_all_kinds_from_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    make = lambda c: rng.integers(0, 256, (90, 170, c), dtype=np.uint8)
    rgb, grey, both, alpha = make(3), make(1), make(2), make(4)
    palette, index = rng.integers(0, 256, (256, 3), dtype=np.uint8), make(1)
    ramp = np.repeat(np.repeat(np.arange(170, dtype=np.uint8)[None, :, None], 90, axis=0), 3, axis=2)
    files = {"rgb": _png(rgb), "grey": _png(grey), "greyalpha": _png(both), "alpha": _png(alpha), "palette": _png(index, palette), "bmp": _bmp(rgb), "ramp": _png(ramp), "cut": _png(rgb)[:200], "text": b"no image", "none": b""}
    assert blobs.put_files(spark.createDataFrame([(k, bytearray(x)) for k, x in files.items()], "name string, bytes binary"), f"{tmp_path}/é i") == len(files)
    got = {r["name"]: r for r in imaging.fingerprints(imaging.read_images(spark, f"{tmp_path}/é i")).collect()}
    want = {"rgb": rgb, "grey": np.repeat(grey, 3, 2), "greyalpha": np.repeat(both[:, :, :1], 3, 2), "alpha": alpha[:, :, :3], "palette": palette[index[:, :, 0]], "bmp": rgb, "ramp": ramp}
    for name, px in want.items():
        assert got[name]["px_md5"] == hashlib.md5(b"(90, 170, 3)" + np.ascontiguousarray(px).tobytes()).hexdigest(), name
        assert got[name]["dhash"] == imaging.gradient_hash(px)
    assert got["ramp"]["dhash"] == "f" * 64
    assert {n for n, r in got.items() if r["px_md5"] is None and r["dhash"] is None} == {"cut", "text"}  # Spark lists no empty files


def _log(spark, rows):
    return spark.createDataFrame(rows, "run long, ordinal long, event string, step long, macro double")


def test_best_checkpoint_ties_take_the_earliest(spark):
    log = _log(spark, [(1, 1, "validation", 10, 0.5), (1, 2, "validation", 20, 0.5), (1, 3, "validation", 30, 0.4)])
    r = runs.best_checkpoint(log, "run").first()
    assert (r["best_step"], r["best_macro"], r["last_step"], r["last_macro"]) == (10, 0.5, 30, 0.4)
    assert [x["step"] for x in runs.running_best(log, "run").collect()] == [10]


def test_run_status_names_the_first_failing_rule(spark):
    done = [("ready", 0, None), ("validation", 5, 0.3), ("checkpoint", 5, None), ("done", 5, None)]
    early = [done[0], done[3], done[1], done[2]]
    rows = [(run, i, e, s, m) for run, events in ((1, done), (2, early), (3, done), (4, done[:2])) for i, (e, s, m) in enumerate(events)]
    exits = spark.createDataFrame([(1, 0), (2, 0), (3, 9), (4, 0), (5, 0)], "run long, exitcode int")
    got = {r["run"]: r["reason"] for r in runs.status(_log(spark, rows), exits, 1, "run").collect()}
    assert got == {1: "", 2: "done_too_early", 3: "exit_code", 4: "missing_checkpoints", 5: "not_ready"}


def test_run_errors(spark):
    log = _log(spark, [(1, 1, "validation", 10, 0.5), (1, 2, "validation", 10, float("nan")), (2, 1, "validation", 1, None)])
    assert {(r["run"], r["rule"], r["n"]) for r in runs.errors(log, "run").collect()} == {(1, "duplicate_step", 2), (1, "bad_score", 1), (2, "bad_score", 1)}


def test_events_with_a_malformed_line(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"event": "ready"}\n\n{"event": "done", "step": 3}\n')
    assert readers.read_events(spark, str(tmp_path / "good.jsonl")).count() == 2
    (tmp_path / "secret.jsonl").write_text('{"event": "ready"}\n{"step": 1}\nnot json\n')
    with pytest.raises(ValueError, match="^secret.jsonl: malformed line$"):
        readers.read_events(spark, str(tmp_path / "secret.jsonl"))


def test_csv_with_large_cells_and_a_wrong_header(spark, tmp_path):
    cell = "x" * 300_000 + '"\n,y'
    quoted = '"' + cell.replace('"', '""') + '"'
    header = "id,obj_1,obj_2,same_figure,same_paper,related_papers,unrelated_papers"
    (tmp_path / "a.csv").write_text(f"{header}\n1,{quoted},b,1,0,0,0\n")
    assert readers.read_pairs(spark, str(tmp_path / "a.csv")).first()["obj_1"] == cell
    (tmp_path / "b.csv").write_text(f"{header.replace('obj_1', 'other')}\n1,a,b,1,0,0,0\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_pairs(spark, str(tmp_path / "b.csv")).collect()
    with pytest.raises(ValueError, match="neither"):
        readers.read_table(spark, "x.txt")


def test_blobs(spark, tmp_path):
    path = str(tmp_path / "blobs")
    b = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),), (None,)], "bytes binary")
    blobs.put(b, path)
    blobs.put(b, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    used = stored.select("md5").union(spark.createDataFrame([("0" * 32,)], "md5 string"))
    broken = stored.withColumn("bytes", F.when(F.col("bytes") == F.lit(b"b"), F.lit(b"c")).otherwise(F.col("bytes")))
    assert sorted(r["state"] for r in blobs.audit(used, broken).collect()) == ["corrupt", "missing"]
    assert blobs.get(spark, path, used).count() == 2


def test_manifest_and_shards(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    found = blobs.file_digests(spark, str(tmp_path))
    manifest = found.withColumn("bytes", F.col("bytes") + (F.col("name") == "b").cast("int")).union(spark.createDataFrame([("z", 1, "0")], "name string, bytes long, sha256 string"))
    assert {(r["name"], r["state"]) for r in blobs.verify_manifest(manifest, found).collect()} == {("b", "size"), ("z", "missing")}
    names = readers.list_names(spark, str(tmp_path))
    assert names == ["a", "b"]
    states = readers.shard_completeness(spark, ["train-00000-of-00002.parquet", "odd"], 2).collect()
    assert {(r["name"], r["state"]) for r in states} == {("train-00001-of-00002.parquet", "missing"), ("odd", "unexpected")}


def test_ordered_digest_depends_on_order_only(spark):
    df = spark.range(50).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    one, two = (blobs.ordered_digest(df.repartition(k), F.col("id").cast("string"), F.col("h")).first() for k in (1, 6))
    other = blobs.ordered_digest(df, F.col("id").cast("string"), F.reverse("h")).first()
    assert one == two and one["sha256"] != other["sha256"]


def test_incremental_index_takes_each_file_once(spark, tmp_path):
    base = str(tmp_path)
    df = spark.range(10)
    for k in range(3):
        df.filter(F.col("id") % 3 == k).write.mode("append").parquet(f"{base}/in")
        incremental.index_new(spark, f"{base}/in", df.schema, f"{base}/out", f"{base}/state", lambda s: s)
    incremental.index_new(spark, f"{base}/in", df.schema, f"{base}/out", f"{base}/state", lambda s: s)
    assert sorted(r["id"] for r in incremental.indexed(spark, f"{base}/out").collect()) == list(range(10))


def test_live_best_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("a", 1, "validation", 10, 0.5), ("a", 1, "validation", 5, 0.5), ("a", 1, "train", 1, 0.9)]
    df = spark.createDataFrame(rows, "arm string, seed long, event string, step long, macro double")
    df.write.parquet(path)
    q = incremental.live_best(spark.readStream.schema(df.schema).parquet(path)).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select best_macro, best_step from live").collect()] == [(0.5, 5)]


def test_expectations(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (None, 2.0)], "id long, x double")
    assert expect.violations(df, "range", F.col("x").between(0, 1), "id").count() == 2
    with pytest.raises(ValueError, match="range"):
        expect.expect(df, "range", F.col("x") < 1)
    with pytest.raises(ValueError, match="columns"):
        expect.expect_columns(df, ["x", "id"])
    assert expect.id_profile(df, "id").first().asDict() == {"rows": 3, "ids": 1, "null_ids": 1, "repeated": 1}
