"""Queries of scans, sinks, projections, set operations and digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairmill.functions import hashing, imaging, probability, text
from pairmill.operators import expect, export, joins, quantiles, ranking, splits
from pairmill.plans.fixtures import Views
from pairmill.plans.registry import query
from pairmill.session import cut, scratch
from pairmill.sources import blobs, readers, recover
from pairmill.streaming import incremental


@query("SELECT * FROM orders")
def scan_parquet(v: Views):
    return v.table("orders")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def scan_projected(v: Views):
    """Two columns and a filter, both in the scan."""
    return readers.read_table(v.spark, f"{v.dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"]).filter("l_shipdate < timestamp '1996-01-01'").select("l_orderkey", "l_quantity")


@query("SELECT r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def scan_glob(v: Views):
    """Files of a folder by pattern."""
    both = v.spark.read.option("mergeSchema", "true").parquet(f"{v.dir}/{{region,nation}}.parquet")
    return both.select(F.coalesce("r_regionkey", "n_nationkey").alias("key"), F.coalesce("r_name", "n_name").alias("name"))


@query("SELECT doc_id AS id, md5(text) AS key_1, md5('\"' || text || '\",') AS key_2, (doc_id % 4 = 0)::INT AS same_figure, (doc_id % 4 = 1)::INT AS same_paper, (doc_id % 4 = 2)::INT AS related_papers, (doc_id % 4 = 3)::INT AS unrelated_papers FROM documents")
def scan_csv_pairs(v: Views):
    """Written as CSV with whole texts in cells, and read back with the explicit schema."""
    d = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("obj_1"), F.concat(F.lit('"'), "text", F.lit('",')).alias("obj_2"), *[(F.col("doc_id") % 4 == i).cast("int").alias(n) for i, n in enumerate(text.LABELS)])
    path = scratch(v.spark, "csv-pairs")
    d.write.csv(path, header=True, quote='"', escape='"')
    return readers.read_pairs(v.spark, path).select("id", hashing.object_key(F.col("obj_1")).alias("key_1"), hashing.object_key(F.col("obj_2")).alias("key_2"), *text.LABELS)


@query("SELECT user_id, ordinal, event, step, macro FROM runlog", "runlog")
def log_events(v: Views):
    """The run log as JSON lines, parsed back; malformed lines would be marked."""
    log = v.runlog()
    lines = log.select("user_id", "ordinal", F.to_json(F.struct("event", "step", "macro")).alias("value"))
    parsed = readers.parse_events(lines).filter(~F.col("malformed"))
    return parsed.select("user_id", "ordinal", "e.event", "e.step", "e.macro")


_SHARDS = 5


@query(
    f"SELECT printf('train-%05d-of-%05d.parquet', i, {_SHARDS}) AS name, CASE WHEN i = 3 THEN 'missing' ELSE 'there' END AS state, CASE WHEN i = 3 THEN 0 ELSE (SELECT count(*) FROM documents WHERE doc_id % {_SHARDS} = i) END AS rows FROM range({_SHARDS}) t(i) UNION ALL SELECT 'odd.parquet', 'unexpected', count(*) FROM documents WHERE doc_id % {_SHARDS} = 3"
)
def shard_completeness(v: Views):
    """Shards of the documents, one under another name: which are there, missing or not expected,
    and the rows of those that are there."""
    d, base = v.table("documents").select("doc_id"), scratch(v.spark, "shards")
    name = lambda i: "odd.parquet" if i == 3 else f"train-{i:05d}-of-{_SHARDS:05d}.parquet"
    for i in range(_SHARDS):
        d.filter(F.col("doc_id") % _SHARDS == i).write.parquet(f"{base}/{name(i)}")
    wrong = readers.shard_completeness(v.spark, readers.list_names(v.spark, base), _SHARDS)
    at = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+[.]parquet)/[^/]+$", 1)
    rows = v.spark.read.parquet(f"{base}/*.parquet").groupBy(at.alias("name")).agg(F.count("*").alias("rows"))
    return rows.join(wrong, "name", "full_outer").select("name", F.coalesce("state", F.lit("there")).alias("state"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def _indexed(v: Views) -> str:
    """Two calls over a growing folder of four shards, each of as many files as the table has
    splits; the last batch is run a second time."""
    base = scratch(v.spark, "index")
    d = v.table("documents").select("doc_id", "text", (F.col("doc_id") % 4).alias("shard"))
    index = lambda s: s.select("__file", "doc_id", hashing.object_key(F.when(F.col("doc_id") % 7 > 0, F.col("text"))).alias("bytes_md5"))
    failed = F.col("bytes_md5").isNull()
    for half in ((0, 2), (1, 3)):
        new = d.filter(F.col("shard").isin(*half))
        new.write.mode("append").partitionBy("shard").parquet(f"{base}/in")
        incremental.index_new(v.spark, f"{base}/in", d.drop("shard").schema, f"{base}/out", f"{base}/state", index, failed)
    again = v.spark.read.schema(d.drop("shard").schema).option("recursiveFileLookup", "true").parquet(*[f"{base}/in/shard={i}" for i in half])
    incremental.index_batch(again.withColumn("__file", F.col("_metadata.file_path")), 1, f"{base}/out", index, failed)
    return f"{base}/out"


@query("SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN md5(text) END AS bytes_md5 FROM documents")
def incremental_index(v: Views):
    """Each file is indexed once, though its batch is given twice."""
    return incremental.indexed(v.spark, _indexed(v))


@query("SELECT doc_id % 4 AS shard, count(*) AS rows, count(*) FILTER (doc_id % 7 = 0) AS errors, 0::BIGINT AS wrong FROM documents GROUP BY 1")
def index_receipts(v: Views):
    """A receipt for each file, added up per shard, and the files that don't agree with theirs."""
    at = _indexed(v)
    shard = F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long").alias("shard")
    wrong = incremental.verify_receipts(v.spark, at).groupBy(shard).agg(F.count("*").alias("wrong"))
    sums = incremental.receipts(v.spark, at).groupBy(shard).agg(F.sum("rows").alias("rows"), F.sum("errors").alias("errors"))
    return sums.join(wrong, "shard", "left").withColumn("wrong", F.coalesce("wrong", F.lit(0)).cast("long"))


#: Rows of a part of the export.
PART_ROWS = 250
_EXPORT = f"r AS (SELECT doc_id, md5(text) AS key, row_number() OVER (ORDER BY sha256('export' || chr(0) || doc_id), doc_id) - 1 AS rank FROM documents), p AS (SELECT *, rank // {PART_ROWS} AS k FROM r), s AS (SELECT k, count(*) AS rows, arg_min(doc_id, rank)::VARCHAR AS first_id, arg_max(doc_id, rank)::VARCHAR AS last_id, sha256(string_agg(sha256(doc_id || ':' || key), chr(10) ORDER BY rank)) AS sha256 FROM p GROUP BY k)"


def _exported(v: Views):
    """An export; then one part is damaged, one cut off and one loses its receipt; and a rerun."""
    d = v.table("documents").select("doc_id", "text", hashing.seeded("export", F.col("doc_id")).alias("h"))
    rows = ranking.global_rank(d, "h", "doc_id").select("doc_id", "text", (F.col("rank") - 1).alias("rank"))
    path = scratch(v.spark, "export")
    make = lambda r: r.select("part", "rank", "doc_id", hashing.object_key(F.col("text")).alias("key"))
    run = lambda: export.export(rows, "doc_id", make, F.concat_ws(":", "doc_id", "key"), path, PART_ROWS, {"table": "documents"})
    run()
    first, second, third = (f"part={i * PART_ROWS:012d}-{(i + 1) * PART_ROWS:012d}" for i in range(3))
    stored = v.spark.read.parquet(f"{path}/parts/{first}")
    cut(stored.withColumn("key", F.lit("damaged"))).write.mode("overwrite").parquet(f"{path}/parts/{first}")
    v.spark.createDataFrame([("no parquet file",)], "value string").write.mode("overwrite").text(f"{path}/parts/{second}")
    cut(v.spark.read.parquet(f"{path}/receipts/{third}").limit(0)).write.mode("overwrite").parquet(f"{path}/receipts/{third}")
    return run(), path, make(rows.withColumn("part", F.lit("")))


@query(f"{_EXPORT} SELECT printf('%012d-%012d', k * {PART_ROWS}, (k + 1) * {PART_ROWS}) AS part, rows, first_id, last_id, sha256, CASE WHEN k < 3 THEN 'written' ELSE 'reused' END AS state FROM s")
def resumable_export(v: Views):
    """The receipts of a rerun after damage: damaged parts are made again, the others are kept."""
    return _exported(v)[0].drop("ids_sha256")


@query(f"{_EXPORT} SELECT doc_id, rank, key FROM r")
def export_merged(v: Views):
    _, path, like = _exported(v)
    return export.merge(v.spark, path, like).select("doc_id", "rank", "key")


@query(f"{_EXPORT} SELECT '{{\"size\": {PART_ROWS}, \"table\": \"documents\"}}' AS provenance, sum(rows)::BIGINT AS rows, sha256(string_agg(sha256, chr(10) ORDER BY k)) AS sha256 FROM s")
def export_provenance(v: Views):
    _, path, _ = _exported(v)
    return export.provenance_row(v.spark, path)


@query("SELECT (rank - 1) // 100 AS chunk, min(rank) AS first, max(rank) AS last, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY sha256('chunks' || chr(0) || doc_id), doc_id) AS rank FROM documents) GROUP BY 1")
def chunk_plan(v: Views):
    h = v.table("documents").select("doc_id", hashing.seeded("chunks", F.col("doc_id")).alias("h"))
    return blobs.chunk_plan(ranking.global_rank(h, "h", "doc_id"), "rank", 100)


@query("SELECT DISTINCT md5(html) AS md5, strlen(html)::INT AS size FROM pages")
def blob_store(v: Views):
    """Put twice, keep once: (md5, size)."""
    path = scratch(v.spark, "blobs")
    b = v.table("pages").select(F.col("html").cast("binary").alias("bytes"))
    blobs.put(b, path)
    blobs.put(b, path)
    return v.spark.read.parquet(path).select("md5", F.length("bytes").alias("size"))


@query("SELECT DISTINCT bytes_md5 AS md5, strlen(cap_text)::INT AS size FROM figures", "figures")
def blob_verify(v: Views):
    path = scratch(v.spark, "blobs")
    b = v.table("documents").select(F.col("text").cast("binary").alias("bytes"))
    blobs.put(b, path)
    return blobs.get(v.spark, path, v.figures().select(F.col("bytes_md5").alias("md5"))).select("md5", F.length("bytes").alias("size"))


@query("SELECT DISTINCT md5(text) AS md5, 'missing' AS state FROM documents WHERE md5(text) NOT IN (SELECT obj_key FROM held) UNION SELECT obj_key, 'corrupt' FROM held WHERE obj_key < '8'", "held")
def blob_audit(v: Views):
    """All documents' blobs against a store that has the held ones, some with other bytes."""
    used = v.table("documents").select(hashing.object_key(F.col("text")).alias("md5"))
    stored = v.held_figures().select(F.col("bytes_md5").alias("md5"), F.when(F.col("bytes_md5") < "8", F.lit("other")).otherwise(F.col("cap_text")).cast("binary").alias("bytes")).dropDuplicates(["md5"])
    return blobs.audit(used, stored)


@query("SELECT sha256(string_agg('{\"doc_id\":' || doc_id || ',\"key\":\"' || md5(text) || '\",\"source\":\"' || source || '\"}', chr(10) ORDER BY sha256('fingerprint' || chr(0) || doc_id)) || chr(10)) AS sha256, count(*) AS rows FROM documents")
def input_fingerprint(v: Views):
    """Digest over JSON lines, keys sorted, in a seeded order, a line feed behind each."""
    d = v.table("documents").select("doc_id", "source", hashing.object_key(F.col("text")).alias("key"))
    return blobs.ordered_digest(d, hashing.sorted_json(*d.columns), hashing.seeded("fingerprint", F.col("doc_id")), end="\n")


@query("per AS (SELECT DISTINCT md5(text) AS h, strlen(text) AS n FROM documents) SELECT sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS sha256, count(*) AS rows FROM per")
def manifest_digest(v: Views):
    """sha256 of the sorted lines "md5:size", joined by line feeds."""
    d = v.table("documents").select(hashing.object_key(F.col("text")).alias("h"), F.octet_length("text").alias("n")).distinct()
    return blobs.ordered_digest(d, F.concat_ws(":", "h", "n"), F.col("h"))


@query(None)
def file_digest(v: Views):
    """The files of a large table and of two small ones, streamed in blocks."""
    return blobs.file_digests(v.spark, *(f"{v.dir}/{t}.parquet" for t in ("documents", "region", "nation")))


@query(None)
def manifest_verify(v: Views):
    """All files against a manifest with a wrong digest, an unknown file and one outside the
    folder, which lacks a required name and any name of a wanted kind."""
    found = file_digest(v)
    wrong = found.withColumn("sha256", F.when(F.col("name") == "nation.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")))
    region = found.filter("name = 'region.parquet'")
    absent = region.withColumn("name", F.explode(F.array(F.lit("absent.parquet"), F.lit("../outside.parquet"))))
    return blobs.verify_manifest(wrong.unionByName(absent), found, ("config.json",), "processor_")


#: Pixels of a page's image, row by row: hex digits of its md5, as grey levels.
_PIXELS = "px AS (SELECT page_id, left(repeat(md5(html), 9), 272) AS s FROM pages)"


def page_images(v: Views):
    """Fingerprints by page of image files: a grey PNG of 17 x 16 pixels for each page, of which
    every fifth is cut off in the middle, written to the shared folder and read from there."""

    @F.pandas_udf("binary")
    def drawn(pixels: pd.Series) -> pd.Series:
        return pd.Series([imaging.encode_png(np.repeat(np.frombuffer(x.encode(), np.uint8).reshape(16, 17, 1), 3, axis=2)) for x in pixels], dtype=object)

    p = v.table("pages").select("page_id", F.substring(F.repeat(hashing.object_key(F.col("html")), 9), 1, 272).alias("s"))
    png = p.select("page_id", drawn("s").alias("png"))
    files = png.select(F.format_string("%d.img", "page_id").alias("name"), F.when(F.col("page_id") % 5 == 4, F.expr("substring(png, 1, 50)")).otherwise(F.col("png")).alias("bytes"))
    folder = scratch(v.spark, "images")
    blobs.put_files(files, folder)
    return imaging.fingerprints(imaging.read_images(v.spark, folder)).withColumn("page_id", F.regexp_extract("name", "^[0-9]+", 0).cast("long"))


@query(f"{_PIXELS} SELECT page_id, CASE WHEN page_id % 5 < 4 THEN md5('(16, 17, 3)' || array_to_string([c || c || c FOR c IN string_split(s, '')], '')) END AS px_md5 FROM px")
def px_md5(v: Views):
    """Digests of decoded pixels; undecodable files have null keys."""
    return page_images(v).select("page_id", "px_md5")


@query(
    f"{_PIXELS}, b AS (SELECT page_id, [(ascii(s[1 + k + k // 16 + 1]) > ascii(s[1 + k + k // 16]))::INT FOR k IN range(256)] AS b FROM px) SELECT page_id, CASE WHEN page_id % 5 < 4 THEN array_to_string([printf('%x', 8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4]) FOR k IN range(64)], '') END AS dhash FROM b"
)
def dhash(v: Views):
    """Gradient hashes of images of just the hash's size."""
    return page_images(v).select("page_id", "dhash")


@query("SELECT pair_id AS id, (p = 0)::INT AS same_figure, (p = 1)::INT AS same_paper, (p = 2)::INT AS related_papers, (p = 3)::INT AS unrelated_papers FROM pred_a", "pred_a")
def submission_csv(v: Views):
    """Predictions written as CSV, once: a second write of the path is refused; read back."""
    hot = probability.one_hot(F.col("p"))
    rows = v.predictions(1).select(F.col("pair_id").alias("id"), *[c.alias(n) for c, n in zip(hot, text.LABELS)])
    path = scratch(v.spark, "submission")
    readers.write_csv_once(rows, path)
    return v.spark.read.csv(path, schema="id long, " + ", ".join(f"{n} int" for n in text.LABELS), header=True)


@query("SELECT DISTINCT doi FROM figures", "figures")
def text_list(v: Views):
    """A column's distinct values as sorted lines of text, read back."""
    path = scratch(v.spark, "lines")
    readers.write_lines(v.figures(), "doi", path)
    return v.spark.read.text(path).withColumnRenamed("value", "doi")


@query("SELECT 'nation.parquet' AS name, count(*) AS rows, count(*) FILTER (n_name IS NULL) AS errors FROM nation UNION ALL SELECT 'region.parquet', count(*), count(*) FILTER (r_name IS NULL) FROM region")
def file_sums(v: Views):
    """Rows and rows without a name, per file."""
    both = v.spark.read.option("mergeSchema", "true").parquet(f"{v.dir}/{{region,nation}}.parquet")
    # a file of a folder counts for the table the folder is
    name = F.regexp_extract(F.input_file_name(), "((?:region|nation)\\.parquet)", 1)
    return both.groupBy(name.alias("name")).agg(F.count("*").alias("rows"), F.count_if(F.coalesce("r_name", "n_name").isNull()).alias("errors"))


@query("SELECT pair_id, key_1, key_2 FROM pairs", "pairs")
def allowlist_projection(v: Views):
    return v.pairs().select("pair_id", "key_1", "key_2")


@query("SELECT pair_id, key_2 AS key_1, key_1 AS key_2 FROM pairs", "pairs")
def orientation_swap(v: Views):
    return v.pairs().select("pair_id", F.col("key_2").alias("key_1"), F.col("key_1").alias("key_2"))


@query(
    "SELECT pair_type, count(*) AS n FROM (SELECT CASE WHEN a.modality <> b.modality THEN 'cxi' WHEN a.modality = 'image' THEN 'ixi' ELSE 'cxc' END AS pair_type FROM mixed_pairs JOIN objects a ON a.obj_key = key_1 JOIN objects b ON b.obj_key = key_2) GROUP BY 1", "objects", "mixed_pairs"
)
def pair_slices(v: Views):
    from pairmill.plans.scalars import pair_type

    typed = pair_type(v)
    slices = [typed.filter(F.col("pair_type") == t) for t in ("cxi", "ixi", "cxc")]
    return slices[0].unionByName(slices[1]).unionByName(slices[2]).groupBy("pair_type").agg(F.count("*").alias("n"))


@query("SELECT pair_id, CASE fold WHEN 0 THEN 'audit' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM pairs", "pairs")
def fold_split(v: Views):
    return v.pairs().select("pair_id", splits.fold_split(F.col("fold")).alias("split"))


@query("SELECT p.pair_id, p.key_1 FROM pairs p WHERE p.pair_id IN (SELECT doc_id FROM labels)", "pairs")
def semi_allow(v: Views):
    return v.pairs().select("pair_id", "key_1").join(v.table("labels").select(F.col("doc_id").alias("pair_id")), "pair_id", "left_semi")


@query("SELECT page_id, CASE WHEN starts_with(url, '/') THEN url WHEN regexp_matches(url, '^[a-z]+://') THEN 'imgcache/' || md5(html) || '.img' ELSE 'data/' || url END AS path FROM pages")
def image_ref(v: Views):
    """Absolute paths stay, relative ones go below the data folder, else the cache by md5."""
    u = F.col("url")
    path = F.when(u.startswith("/"), u).when(u.rlike("^[a-z]+://"), F.concat(F.lit("imgcache/"), hashing.object_key(F.col("html")), F.lit(".img"))).otherwise(F.concat(F.lit("data/"), u))
    return v.table("pages").select("page_id", path.alias("path"))


@query(
    "SELECT pair_id, CASE WHEN a.modality = 'image' AND b.modality = 'caption' THEN key_2 ELSE key_1 END AS first_key, CASE WHEN a.modality = 'image' AND b.modality = 'caption' THEN key_1 ELSE key_2 END AS second_key, least(a.modality, b.modality) AS first_modality FROM mixed_pairs JOIN objects a ON a.obj_key = key_1 JOIN objects b ON b.obj_key = key_2", "objects", "mixed_pairs"
)
def pair_object_join(v: Views):
    """Both objects of a pair, the caption first."""
    o = v.objects().select("obj_key", "modality")
    both = v.mixed_pairs().join(o.toDF("key_1", "m1"), "key_1").join(o.toDF("key_2", "m2"), "key_2")
    swap = (F.col("m1") == "image") & (F.col("m2") == "caption")
    return both.select("pair_id", F.when(swap, F.col("key_2")).otherwise(F.col("key_1")).alias("first_key"), F.when(swap, F.col("key_1")).otherwise(F.col("key_2")).alias("second_key"), F.least("m1", "m2").alias("first_modality"))


@query("SELECT fold, count(*) AS pairs, count(DISTINCT group_id) AS groups FROM pairs GROUP BY fold", "pairs")
def fold_lookup(v: Views):
    """Fold and group by id; an id without them would be an error."""
    p = v.pairs()
    full = joins.lookup(p.select("pair_id", "key_1"), p.select("pair_id", "fold", "group_id"), "pair_id")
    return full.groupBy("fold").agg(F.count("*").alias("pairs"), F.countDistinct("group_id").alias("groups"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey IS NOT NULL UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def left_join_validated(v: Views):
    c = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.left_join_validated(v.table("orders").select("o_orderkey", "o_custkey"), c, "o_custkey", check=False)


@query("SELECT obj_key, min(src) AS source FROM (SELECT md5(text) AS obj_key, 0 AS src FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT md5(text), 1 FROM documents UNION ALL SELECT md5(html), 2 FROM pages) GROUP BY 1")
def exposure_union(v: Views):
    d = v.table("documents")
    labelled = d.join(v.table("labels").select("doc_id"), "doc_id", "left_semi")
    of = lambda df, c, i: df.select(hashing.object_key(F.col(c)).alias("obj_key"), F.lit(i).alias("source"))
    return joins.first_of_sources([of(labelled, "text", 0), of(d, "text", 1), of(v.table("pages"), "html", 2)], "obj_key")


@query("(SELECT DISTINCT md5(text) AS obj_key FROM documents EXCEPT SELECT key_1 FROM pairs WHERE fold >= 2) UNION SELECT obj_key FROM held".join(["SELECT * FROM (", ")"]), "pairs", "held")
def forbidden_objects(v: Views):
    """All objects less those of training pairs, and the held ones."""
    everything = v.table("documents").select(hashing.object_key(F.col("text")).alias("obj_key"))
    train = v.pairs().filter("fold >= 2").select(F.col("key_1").alias("obj_key"))
    return everything.subtract(train).union(v.held().select("obj_key")).distinct()


@query("SELECT count(*) AS shared FROM (SELECT key_1 FROM pairs WHERE fold = 0 INTERSECT SELECT key_1 FROM pairs WHERE fold = 1)", "pairs")
def overlap_check(v: Views):
    p = v.pairs()
    return expect.overlap(p.filter("fold = 0"), p.filter("fold = 1"), "key_1")


@query("SELECT count(*) AS shared FROM (SELECT cap_norm FROM figures INTERSECT SELECT cap_norm FROM held)", "figures", "held")
def content_overlap(v: Views):
    return expect.overlap(v.figures(), v.held(), "cap_norm")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra")
def coverage_check(v: Views):
    return joins.coverage(v.table("documents"), v.table("labels"), "doc_id")


_FIRST = "trim(string_split_regex(benchmark.text, '[.!?\\n]')[1])"


@query(f"SELECT doc_id, item_id FROM documents JOIN benchmark ON {_FIRST} <> '' AND list_contains([trim(x) FOR x IN string_split_regex(documents.text, '[.!?\\n]')], {_FIRST})")
def expected_present(v: Views):
    """Expected items whose first sentence is one of a document: an equi-join on exploded sentences."""
    sentences = lambda c: F.transform(F.split(c, "[.!?\\n]"), lambda x: F.trim(x))
    own = v.table("documents").select("doc_id", F.explode(F.array_distinct(sentences("text"))).alias("s"))
    return own.join(v.table("benchmark").select("item_id", sentences("text")[0].alias("s")).filter("s <> ''"), "s").select("doc_id", "item_id")


@query("SELECT page_id AS id, md5(html) AS md5, strlen(html)::INT AS size FROM pages WHERE page_id IN (SELECT doc_id FROM documents)")
def selected_recovery(v: Views):
    """Selected ids only, joined before decoding; what isn't there or doesn't fit is an error."""
    raw = v.table("pages").select(F.col("page_id").alias("id"), F.base64(F.col("html").cast("binary")).alias("cell"), hashing.object_key(F.col("html")).alias("md5"))
    selected = v.table("documents").select(F.col("doc_id").alias("id")).join(v.table("pages").select(F.col("page_id").alias("id")), "id", "left_semi")
    return recover.recover(selected, raw, "id").select("id", "md5", F.length("bytes").alias("size"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def class_counts(v: Views):
    return v.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT quantile_cont(n, 0.0) AS q0, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, quantile_cont(n, 1.0) AS q100, count(*) FILTER (n > 2400) AS truncated FROM (SELECT length(text)::DOUBLE AS n FROM documents)")
def length_quantiles(v: Views):
    d = v.table("documents").select(F.length("text").cast("double").alias("n"))
    cuts = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = quantiles.quantiles(d, "n", list(cuts))
    return d.agg(*[F.lit(x).cast("double").alias(f"q{round(100 * q)}") for q, x in zip(cuts, found)], F.count_if(F.col("n") > text.CAPTION_LIMIT).alias("truncated"))


@query("SELECT q, round(x, 6) AS x FROM (SELECT unnest([0.001, 0.05, 0.5, 0.95, 0.999]::DOUBLE[]) AS q, unnest(quantile_cont(l_extendedprice::DOUBLE, [0.001, 0.05, 0.5, 0.95, 0.999])) AS x FROM lineitem)")
def price_quantiles(v: Views):
    """Exact quantiles of a column of very many different values."""
    cuts = [0.001, 0.05, 0.5, 0.95, 0.999]
    found = quantiles.quantiles(v.table("lineitem"), "l_extendedprice", cuts)
    return v.spark.createDataFrame([(q, round(x, 6)) for q, x in zip(cuts, found)], "q double, x double")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('order' || chr(0) || doc_id), doc_id) AS rank FROM documents")
def hash_order(v: Views):
    h = v.table("documents").select("doc_id", hashing.seeded("order", F.col("doc_id")).alias("h"))
    return ranking.global_rank(h, "h", "doc_id").select("doc_id", "rank")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('top' || chr(0) || doc_id), doc_id) AS k FROM documents) WHERE k <= 20")
def topn_per_class(v: Views):
    h = v.table("documents").select("doc_id", "source", hashing.seeded("top", F.col("doc_id")).alias("h"))
    return ranking.top_per_class(h, "source", 20, "h", "doc_id").select("doc_id", "source")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_ordered(v: Views):
    """A top-k report: each task keeps its own 100."""
    return v.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


#: Rows of each class in the smaller and the larger subset.
SUBSETS = (10, 20)


@query(
    f"k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('top' || chr(0) || doc_id), doc_id) AS k FROM documents) SELECT size, doc_id, source, row_number() OVER (PARTITION BY size ORDER BY sha256('shuffle' || chr(0) || doc_id), doc_id) AS rank FROM k, (VALUES ({SUBSETS[0]}), ({SUBSETS[1]})) s(size) WHERE k <= size"
)
def nested_subsets(v: Views):
    """Two subsets of the first rows of each class, each shuffled; the smaller lies in the larger."""
    h = v.table("documents").select("doc_id", "source", hashing.seeded("top", F.col("doc_id")).alias("h"))
    return ranking.nested_subsets(h, "source", SUBSETS, "h", "doc_id").select("size", "doc_id", "source", "rank")
