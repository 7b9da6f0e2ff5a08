"""The pipeline's stages against brute force, each on what its predecessor kept."""

import base64
import hashlib
import struct

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pairmill.llm import mixing, quality_rules, simhash


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        given, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = (before, docs.collect())
        if name == "language_id":
            lettered = {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
            assert {r["doc_id"] for r in rows[name][1]} == lettered
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.quality_report(given).filter("kept").collect()}
            assert {r["doc_id"] for r in rows[name][1]} == kept
        if name == "source_mixing":
            want = {r["source"]: r["target"] for r in mixing.plan_mix(given).select("source", F.floor("target").alias("target")).distinct().collect()}
            got = {}
            for r in rows[name][1]:
                got[r["source"]] = got.get(r["source"], 0) + len(r["text"].encode().split())
            assert got == {k: v for k, v in want.items() if v}
        if name != "bpe_codec":
            assert docs.columns == columns

    before, after = rows["simhash_dedup"]
    fps = sorted((r["doc_id"], simhash.fingerprint(r["text"]) % 2**64) for r in before)
    group = {i: i for i, _ in fps}
    for n, (i, x) in enumerate(fps):
        for j, y in fps[:n]:
            if (x ^ y).bit_count() <= 3 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = rows["bpe_codec"]
    digest = lambda ids: hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    want = sorted((r["doc_id"], digest(encoding.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before)
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want


def test_stages_take_odd_tables(spark, tmp_path):
    # no window of eight words comes twice
    prose = " ".join(f"The quiet river {i} runs past mill {i} and boat {i} lies there {i}." for i in range(12))
    other = " ".join(f"Des bateaux dorment pres du moulin {i} le long de la rive {i}." for i in range(12))
    rows = [(1, prose, "en", "a", 1, "x"), (1, prose, "en", "a", 2, "y"), (None, other, None, None, None, None), (2, None, "en", "b", 3, "z"), (3, "", None, "b", 4, None), (4, "12 !", "fr", None, 5, "w"), (5, other, "fr", "c", 6, "v")]
    schema = "doc_id long, text string, lang string, source string, h int, slot string"
    for name, data in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(data, schema)
        for stage, apply in corpus_pipeline.STAGES:
            apply(spark, docs, "").write.parquet(f"{tmp_path}/{name}-{stage}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "bpe_codec":
                assert docs.columns == before.columns
            if stage == "language_id" and data:  # null and letterless texts go, a missing label is filled in
                assert sorted(r["h"] or 0 for r in docs.collect()) == [0, 1, 2, 6] and docs.filter("lang is null").count() == 0
            if stage == "simhash_dedup" and data:  # one of each text, a null id last
                assert sorted((r["doc_id"], r["text"][:3]) for r in docs.collect()) == [(1, "The"), (5, "Des")]
        assert (docs.count() > 0) == bool(data)
