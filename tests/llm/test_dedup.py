"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairmill.llm import embedding_dedup, simhash


def _components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(900))
    texts = [None, "", " \n", "one", "one two", "ONE TWO", "one two three", "É one", base, base]
    for k in range(25):  # near copies: a few words changed
        words = base.split()
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(5)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fp = [_fingerprint(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fp
    assert [got[i]["component_id"] for i in range(len(texts))] == _components(len(texts), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b for b in base}
    for b in base:
        for _ in range(4):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    place = {x: i for i, x in enumerate(signed)}
    edges = {(place[r["src"]], place[r["dst"]]) for r in got}
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in edges)
    want = _components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert _components(len(fps), lambda i, j: (i, j) in edges or (j, i) in edges) == want


def test_dedup_keeps_one_of_each_component(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "quite another text of its own", "c"), (None, text, "d"), (8, None, "e"), (7, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["root"]) for r in kept.collect()) == [(3, "b"), (7, "f"), (9, "c")]
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = x[rng.integers(0, n, n // 2)]
    return np.concatenate([x, near + rng.normal(size=near.shape) * rng.uniform(0.02, 0.3, (len(near), 1)), x[:10], 3 * x[10:20]]).astype(np.float32)


def test_embeddings_against_brute_force(spark):
    x = _vectors(1500, 64, 1)
    labels = [i % 3 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int").repartition(6)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(linked, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert len(got) == len(x) and all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x)))  # none below the threshold
    assert found >= 0.9 * linked.sum() > 500
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1),
        (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [-1.0, -0.0], 1), (14, [-1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()]
    by_id = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == (3, 1, True) and by_id[2] == (3, 1, False) and by_id[12] == (3, 1, False)
    assert by_id[13] == (1, 13, True) and by_id[14] == (1, 13, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert by_id[i] == (0, i, True)
    assert by_id[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [600, 2000, 6000])
def test_embedding_group_of_a_third_of_all_rows(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 48))
    x[: n // 3] = x[0] + 0.22 * rng.normal(size=(n // 3, 48))
    x[n // 3 : n // 3 + 40] = x[n // 3] + 0.2 * rng.normal(size=(40, 48))
    x[-1] = 2 * x[-2]
    labels = np.arange(n) % 2
    df = spark.createDataFrame([(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int").repartition(6)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert len(got) == n and all(got[i]["n_links"] <= want[i] for i in range(n))
    for part in (range(n // 3), range(n // 3, n // 3 + 40), range(n // 3 + 40, n)):
        assert sum(got[i]["n_links"] for i in part) >= 0.9 * want[list(part)].sum()
    assert {got[i]["component_id"] for i in range(n // 3) if want[i]} == {0, 1}


def test_embeddings_of_a_rare_length_link(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(2000)] + [(2000 + i, [1.0 + i / 100, 2.0, 3.0], 1) for i in range(3)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).filter("vec_id >= 2000").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(2, 2000)] * 3


def test_dedup_keeps_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(17)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (7, a), (5, b), (3, b), (5, c), (None, c), (None, d), (None, d), (9, None), (8, ""), (8, ""), (5, a)]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, h int, root string").repartition(4)
    got = simhash.dedup(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, a), (3, b), (5, c), (None, d), (8, "")], key=str)
    assert simhash.dedup(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_very_long_text_is_read_whole(spark):
    words = [f"w{i}" for i in range(200_000)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[::-1])]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in (0, 2)] == [_fingerprint(texts[i]) for i in (0, 2)]
    assert got[1]["component_id"] == 0


def test_equal_hashes_don_t_make_vectors_equal(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 3), 0.5], 1 + i // 9) for i in range(18)] + [(30, [1.0, -0.0, 0.5], 1), (31, [1.0, 0.0, 0.5], None)]
    df = spark.createDataFrame([(i, v, n, 3, "c") for i, v, n in rows], "vec_id long, embedding array<float>, label int, cid int, home string")
    want = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "vector_hash", lambda label, vector: F.lit(5).cast("long"))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert got == want and len(got) == 20
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim, topics", [(12, 0), (32, 0), (64, 12), (128, 0)])
def test_recall_close_to_the_threshold(spark, dim, topics):
    """Links of cosine 0.93 to 0.95 alone, among unlinked vectors of one label, also in topics
    whose vectors have a cosine of about 0.8 with each other."""
    rng = np.random.default_rng(dim)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(max(topics, 1), dim)))
    drawn = lambda n: centres[rng.integers(0, topics, n)] + 0.5 * unit(rng.normal(size=(n, dim))) if topics else rng.normal(size=(n, dim))
    base = drawn(600)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, size=(600, 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side, drawn(3000)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = embedding_dedup.near_duplicates(df).collect()
    v = unit(vectors)
    real = ((v @ v.T >= 0.93).sum() - len(v)) // 2
    found = sum(r["n_links"] for r in got) / 2
    print(dim, found, real)
    assert real >= 600 and found <= real and found >= 0.9 * real
