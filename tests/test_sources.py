"""CSV in blocks, resumable export, index receipts, streamed digests and the live log."""

import csv
import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.operators import export
from pairmill.sources import blobs, csv_split
from pairmill.streaming import incremental

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
CELLS = ["x", "", 'q"q', '"', '""\n""', "line\nline\n\nline", "a,b", ",", "\r\n in it", "é€\n", " sp ", "big " * 3000 + '\n"end"', "t\n" * 40]


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, small_blocks, end):
    rng = random.Random(len(end))
    rows = sorted((i, rng.choice(CELLS), rng.choice(CELLS)) for i in range(250))
    with open(tmp_path / "f.csv", "w", newline="", encoding="utf8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(SCHEMA.names)
        w.writerows(rows)
    path = str(tmp_path / "f.csv")
    assert csv_split._lines(spark, path).rdd.getNumPartitions() > 50
    assert sorted((r["id"], r["a"] or "", r["b"] or "") for r in csv_split.read_csv(spark, path, SCHEMA).collect()) == rows
    if end == "\n":  # Spark's serial reader changes CRLF in cells
        serial = spark.read.csv(path, schema=SCHEMA, header=True, multiLine=True, maxCharsPerColumn=-1, quote='"', escape='"', mode="FAILFAST")
        assert sorted(map(str, serial.collect())) == sorted(map(str, csv_split.read_csv(spark, path, SCHEMA).collect()))


def test_csv_folder_and_its_errors(spark, tmp_path, small_blocks):
    ok = tmp_path / "ok"
    ok.mkdir()
    (ok / "a.csv").write_text('id,a,b\n1,"x\n\ny",z\n\n\n2,,\n')
    (ok / "b.csv").write_text("id,a,b\r\n3,p,q")
    (ok / "c.csv").write_text("")
    (ok / "d.csv").write_text("id,a,b\n")
    got = sorted(map(tuple, csv_split.read_csv(spark, str(ok), SCHEMA).collect()))
    assert got == [(1, "x\n\ny", "z"), (2, None, None), (3, "p", "q")]
    for name, text, said in (("h", "id,b,a\n1,2,3\n", "header"), ("o", 'id,a,b\n1,"open,3\n', "inside a quoted cell"), ("t", "id,a,b\nno number,2,3\n", "(?i)malformed")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception, match=said):
            csv_split.read_csv(spark, str(tmp_path / f"{name}.csv"), SCHEMA).collect()


def _rows(spark, n):
    return spark.range(n).select(F.col("id").alias("rank"), (F.col("id") * 3 % 101).alias("key"))


def _export(spark, path, rows, size=10, calls=None, **facts):
    def make(r):
        return r.select("part", "rank", "key", (F.col("key") * 2).alias("twice"))

    got = export.export(rows, "key", make, F.concat_ws(":", "key", "twice"), path, size, {"v": 1, **facts})
    return {r["part"][7:12] + r["part"][20:]: r for r in got.collect()}


def test_export_resumes(spark, tmp_path):
    path, rows = str(tmp_path / "e"), _rows(spark, 35)
    first = _export(spark, path, rows)
    assert {k: (r["rows"], r["state"]) for k, r in first.items()} == {f"0000{0}00010"[0:5] + "00010": (10, "written"), "0001000020": (10, "written"), "0002000030": (10, "written"), "0003000040": (5, "written")}
    want = hashlib.sha256("\n".join(hashlib.sha256(f"{k * 3 % 101}:{k * 3 % 101 * 2}".encode()).hexdigest() for k in range(30, 35)).encode()).hexdigest()
    assert first["0003000040"]["sha256"] == want
    again = _export(spark, path, rows)
    assert {r["state"] for r in again.values()} == {"reused"} and {k: r["sha256"] for k, r in again.items()} == {k: r["sha256"] for k, r in first.items()}
    parts = sorted((tmp_path / "e" / "parts").glob("part=*"))
    for f in parts[0].glob("*.parquet"):
        f.write_bytes(b"damaged")
    for f in parts[0].glob(".*.crc"):
        f.unlink()
    shutil.rmtree(parts[1])
    third = _export(spark, path, rows)
    assert [r["state"] for _, r in sorted(third.items())] == ["written", "written", "reused", "reused"]
    like = rows.withColumn("part", F.lit("")).select("part", "rank", "key", (F.col("key") * 2).alias("twice"))
    assert sorted(map(tuple, export.merge(spark, path, like).collect())) == [(i, i * 3 % 101, i * 6 % 202) for i in range(35)]
    assert export.provenance_row(spark, path).first()["rows"] == 35
    with pytest.raises(ValueError, match="provenance"):
        _export(spark, path, rows, other=2)
    with pytest.raises(ValueError, match="left over"):
        _export(spark, path, _rows(spark, 20))


def test_export_of_no_rows_and_of_other_ids(spark, tmp_path):
    assert _export(spark, str(tmp_path / "none"), _rows(spark, 0)) == {}
    path = str(tmp_path / "ids")
    _export(spark, path, _rows(spark, 20))
    changed = _rows(spark, 20).withColumn("key", F.when(F.col("rank") == 15, 999).otherwise(F.col("key")))
    assert [r["state"] for _, r in sorted(_export(spark, path, changed).items())] == ["reused", "written"]


def test_index_receipts_and_replays(spark, tmp_path):
    base, df = str(tmp_path), spark.range(20).withColumn("x", F.when(F.col("id") != 7, F.col("id")))
    for k in range(2):
        df.filter(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
        incremental.index_new(spark, f"{base}/in", df.schema, f"{base}/out", f"{base}/state", lambda s: s, F.col("x").isNull())
    said = sorted(map(tuple, incremental.receipts(spark, f"{base}/out").collect()))
    assert sorted((r[1], r[2]) for r in said) == [(10, 0), (10, 1)]
    for r in incremental.receipts(spark, f"{base}/out").collect():
        with open(r["file"].removeprefix("file:").replace("///", "/"), "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r["source_sha256"]
    named = spark.read.schema(df.schema).parquet(said[0][0]).withColumn("__file", F.col("_metadata.file_path"))
    number = 0 if named.filter("id % 2 = 0").count() else 1
    incremental.index_batch(named, number, f"{base}/out", lambda s: s, F.col("x").isNull())
    assert sorted(map(tuple, incremental.receipts(spark, f"{base}/out").collect())) == said
    assert sorted(r["id"] for r in incremental.indexed(spark, f"{base}/out").collect()) == list(range(20))
    assert incremental.verify_receipts(spark, f"{base}/out").collect() == []
    spark.read.parquet(f"{base}/out/rows/batch=1").withColumn("x", F.lit(5).cast("long")).write.parquet(f"{base}/other")
    shutil.rmtree(f"{base}/out/rows/batch=1")
    shutil.move(f"{base}/other", f"{base}/out/rows/batch=1")
    assert [r["state"] for r in incremental.verify_receipts(spark, f"{base}/out").collect()] == ["digest"]


def test_digests_are_streamed(spark, tmp_path, monkeypatch):
    big = b"0123456789abcdef" * 400_000
    (tmp_path / "big name é.bin").write_bytes(big)
    (tmp_path / "empty").write_bytes(b"")
    found = {r["name"]: (r["bytes"], r["sha256"]) for r in blobs.file_digests(spark, str(tmp_path)).collect()}
    assert found == {"big name é.bin": (len(big), hashlib.sha256(big).hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest())}
    monkeypatch.setattr(blobs, "READ_BLOCK", 1000)
    assert {r["sha256"] for r in blobs.file_digests(spark, str(tmp_path)).collect()} == {v[1] for v in found.values()}


def test_manifest_rules(spark, tmp_path):
    for n in ("a", "processor_x"):
        (tmp_path / n).write_text(n)
    found = blobs.file_digests(spark, str(tmp_path))
    states = lambda m, **k: {(r["name"], r["state"]) for r in blobs.verify_manifest(m, found, **k).collect()}
    assert states(found, required=("a",), needs_prefix="processor_") == set()
    part = found.filter("name = 'a'").union(spark.createDataFrame([("../a", 1, "0"), ("/etc/x", 1, "0")], "name string, bytes long, sha256 string"))
    assert states(part, required=("a", "config"), needs_prefix="processor_") == {("../a", "unsafe"), ("/etc/x", "unsafe"), ("config", "unlisted"), ("processor_*", "unlisted")}


def test_live_running_best_takes_events_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    events, want = [], []
    for run in range(6):
        best = None
        for o in range(1, 30):
            kind, macro = rng.choice(["validation", "validation", "train"]), rng.choice([None, *[x / 10 for x in range(10)]])
            events.append((run, o, kind, o * 10, macro))
            if kind == "validation" and macro is not None and (best is None or macro > best):
                best = macro
                want.append((run, o, o * 10, macro))
    rng.shuffle(events)
    schema = "run long, ordinal long, event string, step long, macro double"
    path = str(tmp_path)
    for part in (events[:50], events[50:120], events[100:]):  # some are given twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = incremental.live_running_best(stream, "run").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").collect())) == want


def test_live_running_best_keeps_runs_together(spark, tmp_path):
    """A call of Python and a state are for many runs, not for one; a run without a key too."""
    path, keys = str(tmp_path), [None, -65, -1, 0, *range(1, 300)]
    schema = "run long, ordinal long, event string, step long, macro double"
    for odd in (1, 0):  # the second event of each comes first
        rows = [(k, 1 + odd, "validation", odd, 1.0 + odd) for k in keys]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = incremental.live_running_best(stream, "run").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{path}/out").collect()
    assert {tuple(r) for r in got} == {(k, 1 + odd, odd, 1.0 + odd) for k in keys for odd in (0, 1)} and len(got) == 2 * len(keys)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 10


def test_shards_of_the_index_are_files_of_bounded_size(spark, tmp_path):
    """A shard is written where its rows lie, not gathered in one task."""
    from pairmill.plans import fixtures, tables

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    v = fixtures.Views(spark, str(tmp_path))
    at = tables._indexed(v)
    got = incremental.receipts(spark, at)
    assert got.count() > 4 and got.agg(F.sum("rows")).first()[0] == 64
    assert incremental.verify_receipts(spark, at).isEmpty()
