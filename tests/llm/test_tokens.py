"""Tokenizing operators against the libraries, and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairmill.llm import bpe_codec, token_counts, token_files, units

ODD = [None, "", " ", "\n\n", "a", "  two  spaces\n\n\nand lines \t\r\n end  ", "it's don't 'S we'll", "é€ñ ß x \n\ny", "x \n\ny", "😀 👩‍👩‍👧 \x1c\x85 z", "12345 678,90", "<|endoftext|> text"]


def _long_texts():
    rng = random.Random(6)
    letters = "abcdefghij .,\n'ñé0123"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    return [" ".join(words), "".join(words), "x" * 5000, "ab " * 3000 + "y" * 3000 + " z" * 2000, " " * 4000, "q " * 3000, ("word. " * 500 + "\n") * 4]


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_in_overlapping_chunks_equals_the_library(spark, encoding):
    texts = ODD + _long_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (4, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe_codec.encode_documents(df, bpe_codec.public_codec(), chunk=700, overlap=60).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = np.array(encoding.encode_ordinary(t), dtype="<u4").tobytes()
        assert r["ids"] == ids and r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe_codec.encode_documents(df.limit(0), bpe_codec.public_codec()).count() == 0


def test_units_of_random_texts(encoding):
    rng = random.Random(8)
    codec = bpe_codec.public_codec()
    alphabet = list("aB1 .,-'\n\t\r\x0b\x0c\u0301€²") + ["é", " ", " ", "\x1f", "\x85", "漢", "'s", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    ids, sizes = codec.encode(pa.array(texts))
    want = [encoding.encode_ordinary(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert codec.decode(ids)[0].tobytes() == "".join(texts).encode()


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ODD + _long_texts()[:3] + ["repeated", "repeated"]
    rows = [((i * 37) % 101, t, 1) for i, t in enumerate(texts)] + [(None, "first of all", 1), ((0 * 37) % 101, "second of an id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int").repartition(4)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, token_files.TokenizerFile.public(), path)
    got = sorted((tuple(r) for r in token_files.read_documents(spark, path).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want
    some = token_files.read_tokens(spark, path, [37]).collect()
    assert some[0]["tokens"][-1] == 0
    plan = token_files.read_tokens(spark, path, [37])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,37)]" in plan.split("PushedFilters:")[1]
    assert "tokens" not in token_files.read_starts(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:60].replace("n_tokens", "")


def test_rows_without_an_id_are_split_over_tasks(spark, tmp_path, monkeypatch):
    """A text beyond AT_ONCE is encoded whole, and rows of one id aren't one task."""
    from tokenizers import Tokenizer
    import public_tokenizers as P

    monkeypatch.setattr(units, "AT_ONCE", 20_000)
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [f"{i % 83} row {i} of many" for i in range(800)] + ["long words, " * 12_000]
    path, whole = str(tmp_path / "t"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(whole, "false")
    try:
        token_files.write_tokens(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3), token_files.TokenizerFile.public(), path)
    finally:
        spark.conf.unset(whole)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(spark, path).collect())
    at = 0
    for (start, n, crc), t in zip(got, sorted(texts), strict=True):
        ids = own.encode(t, add_special_tokens=False).ids + [0]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += n
    assert spark.read.parquet(path).select("block").distinct().count() > 1


def test_token_file_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some text number"), "id").alias("text"))
    token_files.write_tokens(df, token_files.TokenizerFile.public(), path)
    meta = pq.ParquetFile(sorted(glob.glob(f"{path}/*.parquet"))[0]).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_row_groups_and_pages_are_bounded(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "ROW_GROUP", 64 << 10)
    monkeypatch.setattr(token_files, "PAGE_BYTES", 8 << 10)
    path = str(tmp_path / "tokens")
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.xxhash64("id", i).cast("string"))).alias("text"))
    token_files.write_tokens(df.repartition(1), token_files.TokenizerFile.public(), path)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    assert sum(m.num_row_groups for m in files) > len(files)
    assert sum(m.num_rows for m in files) == 4000


def test_empty_token_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(df, token_files.TokenizerFile.public(), str(tmp_path / "t"))
    assert token_files.read_documents(spark, str(tmp_path / "t")).count() == 0


def _library(model):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in model.pieces)), *model.pieces], 0, False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[ \\t-\\r]+"), "removed"), pre_tokenizers.Metaspace("▁", "always", False)])
    return t


def test_counts_equal_the_library(spark, sf_dir):
    model = token_counts.public_unigram()
    own = _library(model)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD + ["漢字😀😀 x漢y", "▁ mark", "w" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, model).collect()}
    assert got == {i: len(own.encode(t or "").ids) for i, t in enumerate(texts)}
    assert token_counts.token_counts(df.limit(0), model).count() == 0


def test_ties_follow_the_library():
    rng = random.Random(11)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(8)}
        model = token_counts.Unigram(sorted(pieces.items()))
        own = _library(model)
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            assert model.count_word("▁" + word) == len(own.encode(word).ids), (pieces, word)


def test_joined_units_equal_the_library_on_whole_texts():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from pairmill.llm.token_files import TokenizerFile

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = ["a", "é", "日本", "!", "\u0301", "9.", "x,", "(", "\x01", "\x00x", "<|endoftext|>", " ", "  ", "\n", "\t", "'s", "12", " ", "\r\n", "😀", "word"]
    texts = ["", " ", "\n\n", *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(600))]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    for part in (pa.array(texts), pa.array(["x", *texts])[1:]):  # a slice's offsets don't begin at 0
        ids, sizes = TokenizerFile.public().encode(part)
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_small_parts_and_a_small_table_give_the_same_ids(encoding, monkeypatch):
    from pairmill.llm import units

    rng = random.Random(12)
    codec = bpe_codec.public_codec()
    texts = [" ".join(rng.choice(["word", "é", "x" * 60, "1 2", "\u00a0", "\n\n"]) + str(rng.randrange(90)) for _ in range(rng.randrange(200))) for _ in range(30)]
    want = [encoding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(units, "UNITS_AT_ONCE", 7)
    monkeypatch.setattr(units.UnitEncoder, "KEEP", 20)
    monkeypatch.setattr(units, "AT_ONCE", 100)
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    got = [codec.encode(part.column(1)) for part in units.slices(batch, 1)]
    assert sum((s.tolist() for _, s in got), []) == [len(x) for x in want]
    assert sum((i.tolist() for i, _ in got), []) == sum(want, [])


def test_another_pattern_encodes_uncut():
    import tiktoken

    pattern = r"[a-z]+\s*|\s+|."
    codec = bpe_codec.public_codec()
    other = bpe_codec.Codec(codec.ranks, pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, codec.ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["the cat  sat", " the", "", "a b\n c"]
    ids, _ = other.encode(pa.array(texts))
    assert ids.tolist() == sum((library.encode_ordinary(t) for t in texts), [])
