"""The engine's logical inputs as views over the driver tables, in Spark and in SQL.

Held objects are the texts of the documents that `labels` calls toxic; all views use all rows of
their tables. Partners of pairs stand within their twelve ids, so components of pairs, groups and
papers stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions import probability
from pairmill.functions.hashing import object_key
from pairmill.functions.text import normalize_caption

N_EVENTS = {"signup": "ready", "view": "train", "click": "validation", "purchase": "checkpoint", "error": "done"}
#: Hex digits of a signature, and of an image hash; bits within which two are near.
NIBBLES, HASH_NIBBLES, RADIUS = 8, 64, 8


class Views:
    """Lazy views for one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def doi(g):
        return F.concat(F.lit("10."), (g % 7).cast("string"), F.lit("/j"), (g % 23).cast("string"), F.lit("/"), g.cast("string"))

    def all_figures(self) -> DataFrame:
        g = F.expr("doc_id div 4")
        cap = normalize_caption(F.col("text"))
        d = self.table("documents").select(F.col("doc_id").alias("uuid"), self.doi(g).alias("doi"), F.col("text").alias("cap_text"), cap.alias("cap_norm"))
        md5 = lambda c: F.md5(c.cast("binary"))
        # an image hash of 256 bits that differs by 9 bits at most where texts begin alike
        head, n = F.substring("cap_norm", 1, 40), F.length("cap_norm")
        tail = [(F.shiftright(n, k) % 8).cast("string") for k in (0, 3, 6)]
        dhash = F.concat(md5(head), F.substring(md5(F.concat(F.lit("x"), head)), 1, 29), *tail)
        return d.withColumns({"bytes_md5": md5(F.col("cap_text")), "px_md5": md5(F.col("cap_norm")), "dhash": dhash})

    def figures(self) -> DataFrame:
        return self.all_figures()

    def held_figures(self) -> DataFrame:
        return self.all_figures().join(self.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("uuid")), "uuid", "left_semi")

    def held(self) -> DataFrame:
        return self.held_figures().select(F.col("bytes_md5").alias("obj_key"), "cap_norm", "bytes_md5", "px_md5", "dhash").distinct()

    def papers(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id div 4 as g").distinct().select("g", self.doi(F.col("g")).alias("doi"))

    def reference_lists(self) -> DataFrame:
        """(doi, cited, citing): the two lists of DOIs of a paper."""
        p = self.papers()
        n = p.agg(F.max("g")).first()[0] + 1
        return p.select("doi", F.array(self.doi((7 * F.col("g") + 3) % n)).alias("cited"), F.array(self.doi((13 * F.col("g") + 5) % n)).alias("citing"))

    def edges(self) -> DataFrame:
        from pairmill.operators.splits import citation_edges

        e = citation_edges(self.reference_lists(), "doi", "cited", "citing")
        known = self.papers().select("doi")
        return e.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst")

    def objects(self) -> DataFrame:
        docs = self.table("documents").select(F.col("text").alias("raw"), F.lit("caption").alias("modality"))
        pages = self.table("pages").select(F.col("html").alias("raw"), F.lit("image").alias("modality"))
        return docs.unionByName(pages).withColumn("obj_key", object_key(F.col("raw"))).groupBy("obj_key").agg(F.min("modality").alias("modality"), F.min("raw").alias("raw"))

    def pairs(self) -> DataFrame:
        d = self.table("documents").select("doc_id", object_key(F.col("text")).alias("k"))
        n = d.count()
        a = d.select(F.col("doc_id").alias("pair_id"), F.col("k").alias("key_1"), F.expr(f"if((doc_id div 12 + 1) * 12 <= {n}, doc_id div 12 * 12 + (5 * doc_id + 7) % 12, doc_id)").alias("j"))
        b = d.select(F.col("doc_id").alias("j"), F.col("k").alias("key_2"))
        return a.join(b, "j").select("pair_id", "key_1", "key_2", (F.col("pair_id") % 5).alias("fold"), F.expr("concat('g', pair_id div 3)").alias("group_id"))

    def mixed_pairs(self) -> DataFrame:
        """Pairs of a document with a document or a page, so all pair types occur."""
        d = self.table("documents").select("doc_id", object_key(F.col("text")).alias("k"))
        p = self.table("pages").select("page_id", object_key(F.col("html")).alias("k"))
        n = p.count()
        left = d.select(F.col("doc_id").alias("pair_id"), F.col("k").alias("dk"), (F.col("doc_id") % n).alias("page_id"), ((F.col("doc_id") + 1) % n).alias("other"))
        both = left.join(p.toDF("page_id", "pk"), "page_id").join(p.toDF("other", "ok"), "other")
        kind = F.col("pair_id") % 3
        return both.select("pair_id", F.when(kind == 1, F.col("pk")).otherwise(F.col("dk")).alias("key_1"), F.when(kind == 0, F.col("dk")).when(kind == 1, F.col("ok")).otherwise(F.col("pk")).alias("key_2"))

    def gold(self) -> DataFrame:
        task = F.element_at(F.array(F.lit("cxi"), F.lit("ixi"), F.lit("cxc")), (F.col("vec_id") % 3 + 1).cast("int"))
        return self.table("embeddings").select(F.col("vec_id").alias("pair_id"), (F.col("label") % 4).alias("y"), F.expr("concat('g', vec_id div 5)").alias("group_id"), task.alias("task"))

    def probs(self, first: int, masked: bool = True) -> DataFrame:
        """(pair_id, task, p): softmax of four dims from `first` (1-based)."""
        e = self.table("embeddings").join(self.gold().select(F.col("pair_id").alias("vec_id"), "task"), "vec_id")
        z = [F.col("embedding")[first - 1 + i].cast("double") for i in range(4)]
        m = F.col("task").isin(*probability.MASKED_TASKS) if masked else F.lit(False)
        return e.select(F.col("vec_id").alias("pair_id"), "task", probability.masked_softmax(z, m).alias("p"))

    def predictions(self, first: int) -> DataFrame:
        p = self.probs(first).select("pair_id", probability.argmax_class(F.col("p")).alias("p"))
        return self.gold().join(p, "pair_id")

    def signatures(self) -> DataFrame:
        bits = [F.when(F.col("embedding")[i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)]
        return self.table("embeddings").select("vec_id", "label", F.lower(F.lpad(F.hex(sum(bits[1:], bits[0])), 8, "0")).alias("sig"))

    def runlog(self) -> DataFrame:
        from pyspark.sql import Window

        e = self.table("events")
        names = F.create_map(*[F.lit(x) for kv in N_EVENTS.items() for x in kv])
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(
            "user_id", F.when(F.col("user_id") % 2 == 0, "gold_only").otherwise("public4k").alias("arm"), F.expr("user_id div 2").alias("seed"), F.row_number().over(order).cast("long").alias("ordinal"),
            names[F.col("event_type")].alias("event"), F.get_json_object("props", "$.k").cast("long").alias("step"), F.round(F.col("value") / 500, 6).alias("macro"),
        )


_NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_DOI = "'10.' || ({g} % 7) || '/j' || ({g} % 23) || '/' || ({g})"


def _softmax(first: int, masked: bool = True) -> str:
    z = [f"embedding[{first + i}]::DOUBLE" for i in range(4)]
    m = "task IN ('ixi', 'cxc')" if masked else "false"
    return (
        f"SELECT pair_id, task, [x / s FOR x IN e] AS p FROM (SELECT pair_id, task, e, e[1] + e[2] + e[3] + e[4] AS s FROM (SELECT pair_id, task, [CASE WHEN {m} THEN 0.0::DOUBLE ELSE exp(z[1] - t) END, exp(z[2] - t), exp(z[3] - t), exp(z[4] - t)] AS e "
        f"FROM (SELECT pair_id, task, z, CASE WHEN {m} THEN greatest(z[2], z[3], z[4]) ELSE greatest(z[1], z[2], z[3], z[4]) END AS t FROM (SELECT g.pair_id, g.task, [{', '.join(z)}] AS z FROM embeddings JOIN gold g ON g.pair_id = vec_id))))"
    )


#: The same views in SQL; a view may use those before it.
SQL_VIEWS = {
    "all_figures": f"SELECT *, md5(left(cap_norm, 40)) || left(md5('x' || left(cap_norm, 40)), 29) || (length(cap_norm) % 8) || (length(cap_norm) // 8 % 8) || (length(cap_norm) // 64 % 8) AS dhash FROM (SELECT doc_id AS uuid, {_DOI.format(g='doc_id // 4')} AS doi, text AS cap_text, {_NORM} AS cap_norm, md5(text) AS bytes_md5, md5({_NORM}) AS px_md5 FROM documents)",
    "figures": "SELECT * FROM all_figures",
    "held": "SELECT DISTINCT bytes_md5 AS obj_key, cap_norm, bytes_md5, px_md5, dhash FROM all_figures WHERE uuid IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "papers": f"SELECT g, {_DOI.format(g='g')} AS doi FROM (SELECT DISTINCT doc_id // 4 AS g FROM documents)",
    "edges": "SELECT DISTINCT least(a.doi, b.doi) AS src, greatest(a.doi, b.doi) AS dst FROM papers a, (SELECT max(g) + 1 AS n FROM papers) m, papers b WHERE (b.g = (7 * a.g + 3) % n OR b.g = (13 * a.g + 5) % n) AND a.g <> b.g",
    "objects": "SELECT md5(raw) AS obj_key, min(modality) AS modality, min(raw) AS raw FROM (SELECT text AS raw, 'caption' AS modality FROM documents UNION ALL SELECT html, 'image' FROM pages) GROUP BY 1",
    "pairs": "SELECT a.doc_id AS pair_id, md5(a.text) AS key_1, md5(b.text) AS key_2, a.doc_id % 5 AS fold, 'g' || (a.doc_id // 3) AS group_id FROM documents a JOIN documents b ON b.doc_id = CASE WHEN (a.doc_id // 12 + 1) * 12 <= (SELECT count(*) FROM documents) THEN a.doc_id // 12 * 12 + (5 * a.doc_id + 7) % 12 ELSE a.doc_id END",
    "mixed_pairs": "SELECT d.doc_id AS pair_id, md5(CASE WHEN d.doc_id % 3 = 1 THEN p.html ELSE d.text END) AS key_1, md5(CASE d.doc_id % 3 WHEN 0 THEN d.text WHEN 1 THEN o.html ELSE p.html END) AS key_2 FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages) JOIN pages o ON o.page_id = (d.doc_id + 1) % (SELECT count(*) FROM pages)",
    "gold": "SELECT vec_id AS pair_id, label % 4 AS y, 'g' || (vec_id // 5) AS group_id, ['cxi', 'ixi', 'cxc'][vec_id % 3 + 1] AS task FROM embeddings",
    "probs_a": _softmax(1),
    "probs_b": _softmax(5),
    "probs_rev": _softmax(9),
    "pred_a": "SELECT g.*, list_position(p, list_max(p)) - 1 AS p FROM gold g JOIN probs_a USING (pair_id)",
    "pred_b": "SELECT g.*, list_position(p, list_max(p)) - 1 AS p FROM gold g JOIN probs_b USING (pair_id)",
    "signatures": "SELECT vec_id, label, printf('%08x', " + " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32)) + ") AS sig FROM embeddings",
    "runlog": "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'gold_only' ELSE 'public4k' END AS arm, user_id // 2 AS seed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N_EVENTS.items())
    + " END AS event, (props::JSON->>'k')::BIGINT AS step, round(value / 500, 6) AS macro FROM events",
}
#: Which views each uses.
_USES = {"figures": ["all_figures"], "held": ["all_figures"], "edges": ["papers"], "probs_a": ["gold"], "probs_b": ["gold"], "probs_rev": ["gold"], "pred_a": ["gold", "probs_a"], "pred_b": ["gold", "probs_b"]}


def near_sql(a: str, b: str, radius: int = RADIUS) -> str:
    """Whether two columns of 64 hex digits are within `radius` bits."""
    words = [f"bit_count(xor(('0x' || substr({a}, {i}, 16))::UBIGINT::HUGEINT, ('0x' || substr({b}, {i}, 16))::UBIGINT::HUGEINT))::INT" for i in range(1, HASH_NIBBLES, 16)]
    return f"{' + '.join(words)} <= {radius}"


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """`body` with the views it names, and those they use, as common table expressions.
    A body may begin with own expressions: "name AS (...), ... SELECT"."""
    need: list[str] = []

    def add(v: str) -> None:
        for u in _USES.get(v, []):
            add(u)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    own = body.lstrip().lower().startswith("select")
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in need)
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not need:
        return body if own else head + body
    return f"{head}{ctes}{'' if own else ','}\n{body}"
