"""Language ID, language model and mixing: held-out accuracy, brute force, invariants."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pairmill.llm import language_id, mixing, ngram_lm


def test_automaton_accepts_exactly_the_substrings():
    rng = np.random.default_rng(3)
    text = rng.integers(3, 6, 60).astype(np.uint8)
    moves = {(s, c): t for s, c, t in language_id.suffix_automaton(text)}
    subs = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        w = tuple(rng.integers(3, 6, rng.integers(1, 9)))
        s = 0
        for c in w:
            s = moves.get((s, int(c)), -1) if s >= 0 else -1
        assert (s >= 0) == (w in subs)


def _plain_phrases(row, data):
    at = n = 0
    while at < len(row):
        size = 1
        while at + size < len(row) and bytes(row[at : at + size + 1]) in data and bytes(row[at : at + 1]) in data:
            size += 1
        at += size
        n += 1
    return n


@pytest.mark.parametrize("piece, in_step", [(256, 16_384), (5, 4), (1, 7), (16, 3)])
def test_phrases_against_a_plain_parse(monkeypatch, piece, in_step):
    monkeypatch.setattr(language_id, "PIECE", piece)
    monkeypatch.setattr(language_id, "IN_STEP", in_step)
    rng = np.random.default_rng(piece)
    samples = {"aa": ["the cat sat on the mat", "a dog ate the cat and the rest of it " * 3], "bb": ["le chat est sur la table", "ça va"], "cc": ["Ω漢字 ж"]}
    model = language_id.CrossParser(samples)
    lut = model._own()[0]
    trained = [bytes(language_id._fold(" ".join(samples[k]), lut)) for k in model.langs]
    words = "the dog sat le chat ça zzz x mat cat ate 漢字 字 ж table 1 2 a dog ate the cat and the rest of it".split()
    texts = ["the dog sat", "le chat ça", "zzz the", "x", "", "the cat sat on the mat a dog ate the cat", "1 2 3 la", samples["aa"][1], "x" + samples["aa"][1] * 4]
    texts += [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(20)]
    rows = [language_id._fold(t, lut) for t in texts]
    assert model.count(rows).tolist() == [[_plain_phrases(r, data) for data in trained] for r in rows]


def test_query_against_a_plain_parse(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    model = language_id.learn(docs)
    lut = model._own()[0]
    for r in language_id.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        row = language_id._fold(r["text"], lut)
        trained = [bytes(language_id._fold(t, lut)) for t in model.texts]
        need = [_plain_phrases(row, data) * b for data, b in zip(trained, model.bits)]
        assert r["lang_pred"] == (model.langs[int(np.argmin(need))] if any(map(str.isalpha, r["text"])) else "und")


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    model = language_id.learn(docs)
    got = language_id.identify(docs.drop("lang", "source"), model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 300 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)


def test_language_cases(spark):
    known = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    odd = [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !?\n", "en", "x"), (103, "the dog " * 30_000, None, "x"), (104, "漢字", None, "x"), (None, "the cat", "zz", "x"), (1, "le chien", "fr", "x")]
    df = spark.createDataFrame(known + odd, "doc_id long, text string, lang string, score string").repartition(4)
    model = language_id.learn(df)
    assert model.langs == ["en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] in ("en", "fr") and got[None]["lang_pred"] == "en"
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert kept.filter("doc_id = 103").first()["lang"] == "en"
    none = language_id.learn(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_languages_that_tie_go_by_code_point(spark):
    """Two languages learned from the same texts need the same phrases of any text."""
    rows = [(i, "one text for both of them", lang) for i, lang in enumerate(["zz", "aa"] * 30)]
    df = spark.createDataFrame([*rows, (99, "one text", None)], "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert model.langs == ["aa", "zz"]
    assert {r["lang_pred"] for r in language_id.identify(df, model).collect()} == {"aa"}


def _kneser_ney(texts, held):
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for i, t in texts.items()}
    one, two = Counter(), Counter()
    for i, w in tokens.items():
        if not held(i):
            one.update(w)
            two.update(zip(["\0", *w], w))
    total, types = sum(one.values()), len(one)
    context, followers, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), c in two.items():
        context[u] += c
        followers[u][min(c, 3) - 1] += 1
        before[w] += 1

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else y, 2 - 3 * y * n[3] / n[2] if n[2] else 2 * y, 3 - 4 * y * n[4] / n[3] if n[3] else 3 * y]
        return [0.0, *(min(max(x, 0.0), k) for k, x in enumerate(raw, 1))]

    d2, d1, n1 = discounts(two), discounts(before), Counter(before.values())
    out = {}
    for i, w in tokens.items():
        base = score = 0.0
        for u, x in zip(["\0", *w], w):
            base += math.log10((one[x] + 0.1) / (total + 0.1 * (types + 1)))
            q = 1 / (types + 1)
            if two:
                left = (d1[1] * n1[1] + d1[2] * n1[2] + d1[3] * (types - n1[1] - n1[2])) / len(two)
                q = max(before[x] - d1[min(before[x], 3)], 0) / len(two) + left / (types + 1)
            p = q
            if context[u]:
                c = two[u, x]
                p = max(c - d2[min(c, 3)], 0) / context[u] + sum(d2[k + 1] * followers[u][k] for k in range(3)) / context[u] * q
            score += math.log10(p)
        out[i] = (len(w), sum(one[x] > 0 for x in w), total, base, score)
    return out


def test_scores_against_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows |= {100_000: None, 100_001: "", 100_002: "  \n", 100_003: "Never SEEN words", 100_004: "the the the"}
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows.items()], "doc_id long, text string, score double").repartition(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = _kneser_ney(rows, held)
    got = {r["doc_id"]: r for r in ngram_lm.score_documents(df, ngram_lm.train(df)).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_in_small_parts_and_of_long_texts(spark, sf_dir, monkeypatch):
    """Texts beyond AT_ONCE and tasks beyond PRE_SUM give the scores of one large part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6, "one two three " * 9000)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fixed = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    monkeypatch.setattr(ngram_lm, "AT_ONCE", 3000)
    monkeypatch.setattr(ngram_lm, "PRE_SUM", 500)
    got = {r["doc_id"]: r for r in ngram_lm.score_documents(fixed, ngram_lm.train(fixed)).collect()}
    for i, (n, known, total, base, score) in _kneser_ney(rows, held).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)


def test_a_word_s_probabilities_sum_to_one(spark, tmp_path):
    """Over all known words, the end and the share of an unknown one, after each context."""
    texts = ["a b c a b", "b c c a", "a a d", "a b d c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    model = ngram_lm.train(df, path=str(tmp_path / "lm"))
    k = model.totals
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 7) for w in "abcd"] + [int(ngram_lm.END)], dtype=np.uint64)
    one, two = (ngram_lm._discounts(*(k[f"{x}_{i}"] for i in (1, 2, 3, 4))) for x in ("words", "bigrams"))
    n = model.look_up("word", hashes, hashes)[:, 1]
    kept = np.maximum(n - one[np.minimum(n, 3)], 0) / k["bigrams"]
    q = np.append(kept, 0) + (1 - kept.sum()) / (k["types"] + 1)
    assert k["types"] == 5 and q.sum() == pytest.approx(1)
    for u in [*hashes[:4], ngram_lm.BEGIN]:
        u = np.full(5, u, dtype=np.uint64)
        c, *followers = model.contexts(u[:1])[0]
        pairs = model.look_up("bigram", ngram_lm._by(u, hashes, model.wide), ngram_lm._mix(u, hashes))[:, 0]
        assert c > 0 and pairs.sum() == c
        p = np.append(np.maximum(pairs - two[np.minimum(pairs, 3)], 0) / c, 0) + (two[1:] @ followers) / c * q
        assert p.sum() == pytest.approx(1) and (p > 0).all()


@pytest.mark.parametrize("followers, most", [(1, 1000), (3, 2), (10**9, 1000)])
def test_spread_contexts_change_no_score(spark, monkeypatch, followers, most):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefghij"), rng.integers(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, u int").repartition(5)
    want = {r["doc_id"]: r["score"] for r in ngram_lm.score_documents(df, ngram_lm.train(df)).collect()}
    for name, value in (("WIDE_FOLLOWERS", followers), ("WIDE", most), ("SAMPLE", 1), ("MIN_SHARDS", 32)):
        monkeypatch.setattr(ngram_lm, name, value)
    model = ngram_lm.train(df)
    assert 1 <= len(model.wide) <= most
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score_documents(df, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_scores_without_training_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = ngram_lm.train(df)
    out = ngram_lm.score_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), model).collect()
    assert len(out) == 3 and all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in out)
    assert ngram_lm.score_documents(df, model).count() == 0


def _targets(sizes):
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    left = total
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), [None, "a", "b", "c", "Z", "é"][int(x)], 7) for i, x in enumerate(rng.choice(6, 900, p=[0.1, 0.4, 0.2, 0.1, 0.15, 0.05]))]
    rows += [(1000, None, "a", 7), (None, "null id here", "b", 7), (5, rows[5][1], rows[5][2], 7), (2000, " ".join(f"x{i}" for i in range(20_000)), "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes)
    plan = mixing.plan_mix(df).collect()
    assert len(plan) == len(rows)
    taken = defaultdict(int)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-3 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(math.floor(want[s] + 1e-6) - 1 <= taken[s] <= want[s] + 1e-3 for s in sizes)
    again = mixing.plan_mix(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["h"], r["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["text"]
    assert mixed.columns == df.columns and words == Counter({s: n for s, n in taken.items() if n})


def test_schedule_is_near_its_shares_everywhere(spark):
    goals = spark.createDataFrame([(0, 6400.0), (1, 12800.0), (2, 44800.0)], "src int, target double")
    rows = mixing._schedule(goals, 64).orderBy("slot").collect()
    assert len({r["slot"] for r in rows}) == 1000
    for src, share in enumerate((0.1, 0.2, 0.7)):
        mine = [r for r in rows if r["src"] == src]
        assert [r["rank"] for r in mine] == list(range(round(1000 * share)))
        for start in range(0, 900, 50):  # any stretch of 100 blocks is within a few of its share
            assert abs(sum(start <= r["slot"] < start + 100 for r in mine) - 100 * share) <= 4


def test_mixed_documents_come_in_slot_order_near_their_shares(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(20, 120))), "abc"[int(x)], 1, "k") for i, x in enumerate(rng.choice(3, 1500, p=[0.6, 0.2, 0.2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h int, key string")
    got = mixing.mix(df, slot_col="slot").collect()
    assert [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    words = np.array([len(r["text"].split()) for r in got])
    of = np.array([r["source"] for r in got])
    for s in "abc":
        share = words[of == s].sum() / words.sum()
        for k in range(1, 10):
            upto = len(got) * k // 10
            assert abs(words[:upto][of[:upto] == s].sum() / words[:upto].sum() - share) < 0.04


def test_equal_rows_share_their_words(spark):
    rows = [(i, f"text number {i} of some words", "b") for i in range(60)] + [(7, "one two three four", "a")] * 45 + [(None, "null id", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.plan_mix(df).collect()
    assert len(plan) == len(rows)
    mixed = mixing.mix(df).collect()
    for s in "ab":
        taken = sum(r["taken"] for r in plan if r["source"] == s)
        target = next(r["target"] for r in plan if r["source"] == s)
        assert abs(taken - target) < 1 and taken == sum(len(r["text"].split()) for r in mixed if r["source"] == s)
    assert all(r["taken"] <= 2 * r["size"] for r in plan)
    some = [r["taken"] for r in plan if r["doc_id"] == 7]
    assert sorted(some) == sorted(r["taken"] for r in mixing.plan_mix(df.repartition(2)).collect() if r["doc_id"] == 7)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(df).count() == 0 and mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix_report(blank).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(blank).count() == 0
