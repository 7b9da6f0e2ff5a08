"""Queries of the scalar functions and row-level checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions import hashing, probability, text
from pairmill.operators import expect
from pairmill.plans.fixtures import NIBBLES, RADIUS, Views
from pairmill.plans.registry import query


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS cap_norm FROM documents")
def normalize_caption(v: Views):
    return v.table("documents").select("doc_id", text.normalize_caption(F.col("text")).alias("cap_norm"))


@query("SELECT page_id, lower('10.1/' || url) AS doi FROM pages")
def normalize_doi(v: Views):
    """DOIs in five spellings, by turns."""
    forms = F.array(*[F.concat(F.lit(p), F.col("url"), F.lit(e)) for p, e in (("10.1/", ""), (" HTTPS://doi.org/10.1/", "\t"), ("http://doi.org/ 10.1/", ""), ("doi.org/10.1/", " "), ("DOI.ORG/10.1/", "\u2003"))])
    return v.table("pages").select("page_id", text.normalize_doi(F.get(forms, (F.col("page_id") % 5).cast("int"))).alias("doi"))


@query("SELECT doc_id, md5(text) AS obj_key FROM documents")
def object_key(v: Views):
    return v.table("documents").select("doc_id", hashing.object_key(F.col("text")).alias("obj_key"))


@query("SELECT uuid, 'public_' || sha256(bytes_md5 || chr(0) || cap_norm) AS pair_id FROM figures", "figures")
def pair_id_hash(v: Views):
    return v.figures().select("uuid", hashing.public_pair_id(F.col("bytes_md5"), F.col("cap_text")).alias("pair_id"))


@query("SELECT doc_id, md5(text) AS decoded_md5, false AS bad FROM documents")
def b64_decode(v: Views):
    """Strictly decoded bytes, and null where the text isn't base64."""
    raw = v.table("documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("b64"))
    return raw.select("doc_id", F.md5(F.to_binary("b64", F.lit("base64"))).alias("decoded_md5"), F.try_to_binary("b64", F.lit("base64")).isNull().alias("bad"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(('0x' || a.sig)::BIGINT, ('0x' || b.sig)::BIGINT))::INT AS distance FROM signatures a JOIN signatures b ON b.vec_id = a.vec_id + 1", "signatures")
def hamming_distance(v: Views):
    s = v.signatures().withColumn("w", hashing.hex_words(F.col("sig"), NIBBLES))
    pairs = s.select(F.col("vec_id").alias("a"), F.col("w").alias("wa"), (F.col("vec_id") + 1).alias("b")).join(s.select(F.col("vec_id").alias("b"), F.col("w").alias("wb")), "b")
    return pairs.select("a", "b", hashing.hamming(F.col("wa"), F.col("wb"), 1).cast("int").alias("distance"))


@query(f"SELECT doc_id, left(text, {text.CAPTION_LIMIT}) AS caption, length(text) > {text.CAPTION_LIMIT} AS truncated FROM documents")
def truncate_caption(v: Views):
    return v.table("documents").select("doc_id", text.truncate_caption(F.col("text")).alias("caption"), (F.length("text") > text.CAPTION_LIMIT).alias("truncated"))


@query("SELECT kind, count(*) FILTER (regexp_full_match(x, '[0-9a-f]{32}')) AS valid, count(*) AS n FROM (SELECT 'md5' AS kind, md5(text) AS x FROM documents UNION ALL SELECT 'upper', upper(md5(text)) FROM documents UNION ALL SELECT 'text', text FROM documents) GROUP BY kind")
def md5_format(v: Views):
    d = v.table("documents")
    key = hashing.object_key(F.col("text"))
    kinds = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("x")) for k, c in (("md5", key), ("upper", F.upper(key)), ("text", F.col("text")))])).alias("s")).select("s.*")
    return kinds.groupBy("kind").agg(F.count_if(hashing.is_md5(F.col("x"))).alias("valid"), F.count("*").alias("n"))


@query("SELECT pair_id, task, round(p[1], 9) AS p0, round(p[2], 9) AS p1, round(p[3], 9) AS p2, round(p[4], 9) AS p3 FROM probs_a", "probs_a")
def masked_softmax(v: Views):
    return v.probs(1).select("pair_id", "task", *[F.round(F.col("p")[i], 9).alias(f"p{i}") for i in range(4)])


@query("SELECT pair_id, (list_position(p, list_max(p)) - 1)::INT AS p FROM probs_a", "probs_a")
def argmax_class(v: Views):
    return v.probs(1).select("pair_id", probability.argmax_class(F.col("p")).alias("p"))


@query("SELECT pair_id, (p = 0)::INT AS same_figure, (p = 1)::INT AS same_paper, (p = 2)::INT AS related_papers, (p = 3)::INT AS unrelated_papers FROM pred_a", "pred_a")
def onehot_encode(v: Views):
    hot = probability.one_hot(F.col("p"))
    return v.predictions(1).select("pair_id", *[c.alias(n) for c, n in zip(hot, text.LABELS)])


@query("SELECT pair_id, y::INT AS y, CASE WHEN (y = 0)::INT + (y = 1)::INT + (y = 2)::INT + (y = 3)::INT = 1 THEN y END::INT AS decoded FROM gold", "gold")
def onehot_decode(v: Views):
    """Labels back from one-hot columns; null unless exactly one is set."""
    hot = F.array(*probability.one_hot(F.col("y")))
    one = F.aggregate(hot, F.lit(0), lambda a, x: a + x) == 1
    return v.gold().select("pair_id", "y", F.when(one, F.array_position(hot, 1).cast("int") - 1).alias("decoded"))


@query("SELECT pair_id, (['same_figure', 'same_paper', 'related_papers', 'unrelated_papers'])[y + 1] AS label, y::INT AS y FROM gold", "gold")
def label_index(v: Views):
    named = v.gold().select("pair_id", text.label_name(F.col("y")).alias("label"))
    return named.withColumn("y", text.label_index(F.col("label")))


_SIDES = f"SELECT a.pair_id, left(x.text, {text.CAPTION_LIMIT}) AS a, left(z.text, {text.CAPTION_LIMIT}) AS b FROM pairs a JOIN documents x ON x.doc_id = a.pair_id JOIN documents z ON z.doc_id = (31 * a.pair_id + 7) % (SELECT count(*) FROM documents)"


@query(
    f"s AS ({_SIDES}) SELECT pair_id, 'cxc' AS kind, 'Caption A:' || chr(10) || a || chr(10) || chr(10) || 'Caption B:' || chr(10) || b || chr(10) || chr(10) || 'Are Caption A and Caption B from the same paper, related papers, or unrelated papers?' AS prompt FROM s WHERE pair_id % 3 = 0 UNION ALL SELECT pair_id, 'cxi', 'Caption A: ' || a || chr(10) || 'Question: what is the relation of this figure to the caption?' FROM s WHERE pair_id % 3 = 1 UNION ALL SELECT pair_id, 'ixi', 'Figure A:<image>Figure B:<image>Are Figure A and Figure B from the same paper, related papers, or unrelated papers?' FROM s WHERE pair_id % 3 = 2", "pairs"
)
def render_prompt(v: Views):
    """The prompt of each pair type; the pairs take the types by turns."""
    d = v.table("documents")
    n = d.count()
    a = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("ta"), ((31 * F.col("doc_id") + 7) % n).alias("j"))
    both = a.join(d.select(F.col("doc_id").alias("j"), F.col("text").alias("tb")), "j")
    kinds = ("cxc", "cxi", "ixi")
    pick = lambda values: F.get(F.array(*values), (F.col("pair_id") % 3).cast("int"))
    return both.select("pair_id", pick(map(F.lit, kinds)).alias("kind"), pick([text.render_prompt(k, F.col("ta"), F.col("tb")) for k in kinds]).alias("prompt"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND NOT contains(text, '<|im_start|>') AND NOT contains(text, '<|im_end|>') AND NOT contains(text, '<|image_pad|>') AS valid FROM documents")
def caption_valid(v: Views):
    return v.table("documents").select("doc_id", text.caption_valid(F.col("text")).alias("valid"))


@query(
    "SELECT pair_id, task, len(p) = 4 AND len([x FOR x IN p IF isnan(x) OR x < 0 OR x > 1]) = 0 AND abs(list_sum(p) - 1) <= 1e-5 AND (task = 'cxi' OR p[1] = 0) AS valid FROM probs_a", "probs_a"
)
def prob_validate(v: Views):
    return v.probs(1).select("pair_id", "task", probability.valid(F.col("p"), F.col("task").isin(*probability.MASKED_TASKS)).alias("valid"))


@query(
    "h AS (SELECT task, least(ceil(count(*) / 8.0)::BIGINT * 3, 837) AS n FROM gold GROUP BY task), t AS (SELECT task, n, unnest(range(n)) AS step, greatest(1, least(50, 3 * n // 100))::DOUBLE AS warm FROM h) SELECT task, step, round(1e-4 * least(1.0::DOUBLE, (step + 1) / warm) * (0.05 + 0.95 * 0.5 * (1 + cos(pi() * step / n::DOUBLE))), 12) AS lr FROM t", "gold"
)
def lr_schedule(v: Views):
    """The learning rate at each step of each task's horizon, which follows from its rows."""
    steps = train_horizon(v).select("task", "steps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)).alias("step"))
    return steps.select("task", "step", F.round(probability.learning_rate(F.col("step"), F.col("steps"), 1e-4), 12).alias("lr"))


@query("SELECT task, count(*) AS rows, least(ceil(count(*) / 8.0)::BIGINT * 3, 837) AS steps FROM gold GROUP BY task", "gold")
def train_horizon(v: Views):
    per = v.gold().groupBy("task").agg(F.count("*").alias("rows"))
    return per.select("task", "rows", probability.horizon(F.col("rows"), 4, 2, 3, 837).cast("long").alias("steps"))


@query("SELECT obj_key, modality, CASE WHEN starts_with(raw, 'iVBORw0KGgo') THEN 'image' ELSE 'caption' END AS by_prefix FROM objects", "objects")
def modality_classify(v: Views):
    return v.objects().select("obj_key", "modality", text.modality(F.col("raw")).alias("by_prefix"))


@query(
    "SELECT pair_id, CASE WHEN a.modality <> b.modality THEN 'cxi' WHEN a.modality = 'image' THEN 'ixi' ELSE 'cxc' END AS pair_type FROM mixed_pairs JOIN objects a ON a.obj_key = key_1 JOIN objects b ON b.obj_key = key_2", "objects", "mixed_pairs"
)
def pair_type(v: Views):
    o = v.objects().select("obj_key", "modality")
    both = v.mixed_pairs().join(o.toDF("key_1", "m1"), "key_1").join(o.toDF("key_2", "m2"), "key_2")
    return both.select("pair_id", text.pair_type(F.col("m1"), F.col("m2")).alias("pair_type"))


@query("SELECT 'nulls' AS rule, count(*) FILTER (doc_id IS NULL) AS n FROM documents UNION ALL SELECT 'repeated', count(*) - count(DISTINCT doc_id) FROM documents")
def expect_ids(v: Views):
    p = expect.id_profile(v.table("documents"), "doc_id")
    return p.selectExpr("stack(2, 'nulls', null_ids, 'repeated', repeated) as (rule, n)")


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS ids FROM lineitem")
def id_uniqueness(v: Views):
    return expect.id_profile(v.table("lineitem"), "l_orderkey").select("rows", "ids")


@query("SELECT 'doc_id' AS \"column\", count(*) FILTER (doc_id IS NULL) AS nulls FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS NULL) FROM documents")
def null_profile(v: Views):
    return expect.null_profile(v.table("documents"))


@query("SELECT pair_id, y::INT AS y FROM gold WHERE y NOT IN (1, 2, 3) AND task <> 'cxi'", "gold")
def label_domain(v: Views):
    """Labels outside the domain of masked tasks."""
    masked = v.gold().filter(F.col("task").isin(*probability.MASKED_TASKS))
    return expect.violations(masked, "label_domain", F.col("y").isin(1, 2, 3), "pair_id", "y").drop("expectation")


@query("SELECT 'documents' AS name, count(*) AS rows, count(*) >= 200 AS holds FROM documents UNION ALL SELECT 'gold', count(*), count(*) = (SELECT count(*) FROM embeddings) FROM gold", "gold")
def row_count_expect(v: Views):
    n = v.table("embeddings").count()
    docs = v.table("documents").agg(F.count("*").alias("rows")).select(F.lit("documents").alias("name"), "rows", (F.col("rows") >= 200).alias("holds"))
    return docs.unionByName(v.gold().agg(F.count("*").alias("rows")).select(F.lit("gold").alias("name"), "rows", (F.col("rows") == n).alias("holds")))


@query("SELECT * FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) t(position, name, type)")
def expect_schema(v: Views):
    """Column names in order, one row each."""
    d = expect.expect_columns(v.table("documents"), ["doc_id", "text", "lang", "source", "n_chars"])
    return v.spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(d.dtypes)], "position int, name string, type string")
