"""Queries of components, closures, exposure and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text
from pairmill.functions.hashing import seeded
from pairmill.operators import joins, similarity, splits
from pairmill.plans.fixtures import HASH_NIBBLES, NIBBLES, RADIUS, Views, near_sql
from pairmill.plans.registry import query
from pairmill.session import cut

_KEYS = ["cap_norm", "bytes_md5", "px_md5"]
_HASHES = [*_KEYS, "dhash"]
#: Radius for the short signatures of embeddings' signs.
SIGN_RADIUS = 6
#: Components of papers that share content, in SQL: labels spread along shared values.
_COMPONENTS = """
k AS (SELECT DISTINCT doi, 'c' || cap_norm AS v FROM figures WHERE cap_norm <> '' UNION SELECT DISTINCT doi, 'b' || bytes_md5 FROM figures UNION SELECT DISTINCT doi, 'p' || px_md5 FROM figures UNION SELECT DISTINCT doi, 'd' || dhash FROM figures),
h AS (SELECT v, min(doi) AS hub FROM k GROUP BY v), dh AS (SELECT DISTINCT dhash AS d FROM figures),
nr AS (SELECT x.d AS x, y.d AS y FROM dh x JOIN dh y ON x.d < y.d AND """ + near_sql("x.d", "y.d") + """),
e AS (SELECT DISTINCT doi AS a, hub AS b FROM k JOIN h USING (v) WHERE doi <> hub UNION SELECT hx.hub, hy.hub FROM nr JOIN h hx ON hx.v = 'd' || x JOIN h hy ON hy.v = 'd' || y WHERE hx.hub <> hy.hub), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT DISTINCT doi, doi FROM figures UNION SELECT r.a, s.b FROM reach r JOIN s ON s.a = r.b),
comp AS (SELECT a AS doi, min(b) AS component FROM reach GROUP BY a)"""
#: Image hashes of figures near a held one, in SQL.
_HELD_NEAR = f"hn AS (SELECT DISTINCT x.dhash FROM (SELECT DISTINCT dhash FROM figures) x JOIN (SELECT DISTINCT dhash FROM held) y ON {near_sql('x.dhash', 'y.dhash')})"
_FORBIDDEN = _COMPONENTS + f",\n{_HELD_NEAR}" + """,
hit AS (SELECT DISTINCT f.doi FROM figures f WHERE f.cap_norm IN (SELECT cap_norm FROM held) OR f.bytes_md5 IN (SELECT bytes_md5 FROM held) OR f.px_md5 IN (SELECT px_md5 FROM held) OR f.dhash IN (FROM hn)),
bad AS (SELECT doi FROM comp WHERE component IN (SELECT component FROM comp JOIN hit USING (doi)))"""
_ELIGIBLE = _FORBIDDEN + ",\nok AS (SELECT * FROM figures WHERE doi NOT IN (SELECT doi FROM bad) AND length(cap_norm) >= 40)"
_COMP_EDGES = _COMPONENTS + ",\nce AS (SELECT DISTINCT least(x.component, y.component) AS p, greatest(x.component, y.component) AS q FROM edges JOIN comp x ON x.doi = src JOIN comp y ON y.doi = dst WHERE x.component <> y.component)"


def keyed_figures(v: Views) -> DataFrame:
    """Figures with the keys that joins need, captions as digests: made once and kept."""
    digest = F.when(F.col("cap_norm") != "", F.md5(F.col("cap_norm").cast("binary")))
    return cut(v.figures().select("uuid", "doi", digest.alias("cap_norm"), "bytes_md5", "px_md5", "dhash", F.length("cap_norm").alias("cap_length")))


def keyed_held(v: Views) -> DataFrame:
    return cut(v.held().withColumn("cap_norm", F.when(F.col("cap_norm") != "", F.md5(F.col("cap_norm").cast("binary")))))


def components_of(f: DataFrame) -> DataFrame:
    """(doi, component): papers that share a caption, image, pixels or image hash, or have
    image hashes within the radius."""
    near = similarity.hamming_self(f, "dhash", HASH_NIBBLES, RADIUS)
    edges = splits.content_edges(f, "doi", _HASHES).unionByName(splits.near_edges(f, "doi", "dhash", near))
    return cut(splits.components(f, "doi", edges))


def paper_components(v: Views) -> DataFrame:
    return components_of(keyed_figures(v))


def exposed(f: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct uuids of figures that share a key with a held object or are near one."""
    near = similarity.hamming_cross(f, held, "dhash", HASH_NIBBLES, RADIUS).select(F.col("a").alias("dhash")).distinct()
    by_image = f.join(near, "dhash", "left_semi").select("uuid")
    return joins.with_any_key(f, held, "uuid", "obj_key", _KEYS).union(by_image).distinct()


def forbidden_of(f: DataFrame, held: DataFrame) -> DataFrame:
    return splits.blocked(components_of(f), "doi", f.join(exposed(f, held), "uuid", "left_semi"))


def eligible(v: Views) -> DataFrame:
    """Figures with content keys and a caption of 40 characters, in papers that aren't blocked."""
    f = keyed_figures(v)
    fit = F.col("bytes_md5").isNotNull() & F.col("dhash").isNotNull() & (F.col("doi") != "") & (F.col("cap_length") >= 40)
    return f.filter(fit).join(forbidden_of(f, keyed_held(v)).select("doi"), "doi", "left_anti")


@query(f"{_ELIGIBLE} SELECT uuid, doi FROM ok", "figures", "held", recursive=True)
def eligible_figures(v: Views):
    return eligible(v).select("uuid", "doi")


@query("SELECT src, dst FROM edges", "edges")
def citation_edges(v: Views):
    return v.edges()


@query(f"{_COMPONENTS} SELECT * FROM comp", "figures", recursive=True)
def dup_components(v: Views):
    return paper_components(v)


_CONTENT = _COMPONENTS.replace("nr AS", "no AS").replace(" UNION SELECT hx.hub, hy.hub FROM nr JOIN", " UNION SELECT hx.hub, hy.hub FROM (SELECT * FROM no LIMIT 0) nr JOIN")


@query(
    f"{_COMPONENTS} SELECT (SELECT count(DISTINCT component) FROM (WITH RECURSIVE {_CONTENT} SELECT * FROM comp)) - (SELECT count(DISTINCT component) FROM comp) AS near_unions, (SELECT count(DISTINCT component) FROM comp) AS components", "figures", recursive=True
)
def near_unions(v: Views):
    """How many unions of components near image hashes make beyond shared contents."""
    f = keyed_figures(v)
    content = splits.components(f, "doi", splits.content_edges(f, "doi", _HASHES))
    count = lambda c: c.select("component").distinct().count()
    apart, joined = count(content), count(components_of(f))
    return v.spark.createDataFrame([(apart - joined, joined)], "near_unions long, components long")


@query(
    """d AS (SELECT DISTINCT sig FROM signatures), w AS (SELECT sig, ('0x' || sig)::BIGINT AS w FROM d),
    near AS (SELECT a.sig AS a, b.sig AS b FROM w a JOIN w b ON a.sig < b.sig AND bit_count(xor(a.w, b.w)) <= 6), s AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
    reach(a, b) AS (SELECT sig, sig FROM d UNION SELECT r.a, s.b FROM reach r JOIN s ON s.a = r.b)
    SELECT a AS sig, min(b) AS component FROM reach GROUP BY a""", "signatures", recursive=True
)
def near_components(v: Views):
    """Components of fingerprints within the radius."""
    s = v.signatures()
    near = similarity.hamming_self(s, "sig", NIBBLES, SIGN_RADIUS)
    return splits.components(s, "sig", near.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query(f"d AS (SELECT DISTINCT dhash AS d FROM all_figures) SELECT x.d AS a, y.d AS b, ({near_sql('x.d', 'y.d').removesuffix(f' <= {RADIUS}')})::INT AS distance FROM d x JOIN d y ON x.d < y.d AND {near_sql('x.d', 'y.d')}", "all_figures")
def hamming_self(v: Views):
    """Pairs of image hashes of 256 bits within 8 bits, by nine bands."""
    return similarity.hamming_self(v.all_figures(), "dhash", HASH_NIBBLES, RADIUS)


@query(f"d AS (SELECT DISTINCT dhash AS d FROM held), f AS (SELECT DISTINCT dhash AS d FROM figures) SELECT x.d AS a, y.d AS b, ({near_sql('x.d', 'y.d').removesuffix(f' <= {RADIUS}')})::INT AS distance FROM d x JOIN f y ON {near_sql('x.d', 'y.d')}", "figures", "held")
def hamming_cross(v: Views):
    return similarity.hamming_cross(v.held(), v.figures(), "dhash", HASH_NIBBLES, RADIUS)


@query(
    "SELECT kind, count(*) AS hits, count(DISTINCT uuid) AS figures, count(DISTINCT obj_key) AS objects FROM (SELECT 'cap_norm' AS kind, uuid, obj_key FROM figures JOIN held USING (cap_norm) WHERE cap_norm <> '' UNION SELECT 'bytes_md5', uuid, obj_key FROM figures JOIN held USING (bytes_md5) UNION SELECT 'px_md5', uuid, obj_key FROM figures JOIN held USING (px_md5)) GROUP BY kind", "figures", "held"
)
def exposure_exact(v: Views):
    """Per key: pairs of figure and object that share its value, and how many of each."""
    shared = joins.shared_values(v.figures(), v.held(), "uuid", "obj_key", _KEYS)
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    return shared.groupBy("kind").agg(total(F.col("n_left") * F.col("n_right"), "hits"), total("n_left", "figures"), total("n_right", "objects"))


@query(f"{_FORBIDDEN} SELECT doi FROM bad", "figures", "held", recursive=True)
def forbidden_closure(v: Views):
    return forbidden_of(keyed_figures(v), keyed_held(v)).select("doi")


@query("SELECT src, dst FROM edges WHERE src IN (SELECT doi FROM figures) AND dst IN (SELECT doi FROM figures)", "figures", "edges")
def edges_within(v: Views):
    return splits.edges_within(v.edges(), v.figures(), "doi")


@query(f"{_COMP_EDGES} SELECT p, q FROM ce", "figures", "edges", recursive=True)
def component_edges(v: Views):
    return splits.component_edges(v.edges(), paper_components(v), "doi")


@query(
    "s AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) SELECT DISTINCT a.dst AS p, b.dst AS q FROM s a JOIN s b ON a.src = b.src AND a.dst < b.dst WHERE (a.dst, b.dst) NOT IN (SELECT (src, dst) FROM edges)", "edges"
)
def two_hop(v: Views):
    return splits.two_hop(v.edges())


@query(
    "j AS (SELECT doi, string_split(doi, '/')[1] || '/' || string_split(doi, '/')[2] AS journal, sha256('journal' || chr(0) || doi) AS h FROM papers), n AS (SELECT doi, journal, coalesce(lead(doi) OVER (PARTITION BY journal ORDER BY h, doi), first_value(doi) OVER (PARTITION BY journal ORDER BY h, doi)) AS other FROM j) SELECT doi, other, journal FROM n WHERE doi <> other", "papers"
)
def same_journal(v: Views):
    p = v.papers().withColumn("journal", text.journal(F.col("doi")))
    return splits.journal_neighbours(p, "doi", "journal", "journal")


#: Components of objects that share a normalised text, in SQL.
_OBJECTS = "o AS (SELECT DISTINCT md5(text) AS k, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS c FROM documents), oc AS (SELECT k, min(k) OVER (PARTITION BY c) AS component FROM o)"


def object_parts(v: Views) -> DataFrame:
    o = v.all_figures().select(F.col("bytes_md5").alias("obj_key"), "cap_norm").distinct()
    return splits.components(o, "obj_key", splits.content_edges(o, "obj_key", ["cap_norm"]))


@query(f"{_OBJECTS} SELECT k AS obj_key, component FROM oc", "papers")
def object_components(v: Views):
    return object_parts(v)


_CLEAN = _OBJECTS + """,
f AS (SELECT p.*, a.component AS c1, b.component AS c2, CASE fold WHEN 0 THEN 'audit' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM pairs p JOIN oc a ON a.k = key_1 JOIN oc b ON b.k = key_2),
au AS (SELECT c1 AS c FROM f WHERE split = 'audit' UNION SELECT c2 FROM f WHERE split = 'audit'), de AS (SELECT c1 AS c FROM f WHERE split = 'dev' UNION SELECT c2 FROM f WHERE split = 'dev'),
l AS (SELECT * FROM f WHERE split = 'audit' OR (c1 NOT IN (FROM au) AND c2 NOT IN (FROM au) AND (split = 'dev' OR (c1 NOT IN (FROM de) AND c2 NOT IN (FROM de))))),
br AS (SELECT DISTINCT split, group_id FROM f WHERE pair_id NOT IN (SELECT pair_id FROM l)),
cl AS (SELECT l.* FROM l LEFT JOIN br USING (split, group_id) WHERE br.group_id IS NULL)"""


@query(f"{_CLEAN} SELECT pair_id, split FROM cl", "pairs")
def clean_splits(v: Views):
    return splits.clean_splits(v.pairs(), object_parts(v)).select("pair_id", "split")


@query("f AS (SELECT *, CASE fold WHEN 0 THEN 'audit' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM pairs), l AS (SELECT * FROM f WHERE key_1 >= '4'), br AS (SELECT DISTINCT split, group_id FROM f WHERE key_1 < '4') SELECT pair_id, split, group_id FROM l LEFT JOIN br USING (split, group_id) WHERE br.group_id IS NULL", "pairs")
def group_expand_prune(v: Views):
    """Pairs whose first key starts below 4 go, and with them their groups of the split."""
    p = v.pairs().withColumn("split", splits.fold_split(F.col("fold")))
    return splits.drop_broken_groups(p, p.filter("key_1 >= '4'")).select("pair_id", "split", "group_id")


@query(f"{_CLEAN} SELECT count(*) AS shared FROM (SELECT c1 AS c FROM cl WHERE split = 'dev' UNION SELECT c2 FROM cl WHERE split = 'dev') WHERE c IN (SELECT c1 FROM cl WHERE split = 'train' UNION SELECT c2 FROM cl WHERE split = 'train')", "pairs")
def split_disjoint(v: Views):
    """Components on both sides of the cleaned splits: none."""
    clean = splits.clean_splits(v.pairs(), object_parts(v))
    ends = lambda s: clean.filter(F.col("split") == s).select(F.explode(F.array("component_1", "component_2")).alias("c"))
    return ends("dev").intersect(ends("train")).agg(F.count("*").alias("shared"))


_CLOSURE = """
g AS (SELECT 'group:' || group_id AS a, 'obj:' || key_1 AS b FROM pairs UNION SELECT 'group:' || group_id, 'obj:' || key_2 FROM pairs UNION SELECT DISTINCT 'public:' || doi, 'obj:' || bytes_md5 FROM all_figures),
s AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach(n) AS (SELECT 'obj:' || obj_key FROM held UNION SELECT s.b FROM reach JOIN s ON s.a = n)"""


@query(f"{_CLOSURE} SELECT pair_id FROM pairs WHERE 'group:' || group_id NOT IN (FROM reach)", "all_figures", "held", "pairs", recursive=True)
def closure_prune(v: Views):
    """Pairs whose group isn't connected, through objects and papers, to a held object."""
    return _pruned(v).select("pair_id")


def _pruned(v: Views) -> DataFrame:
    p = v.pairs()
    group = F.concat(F.lit("group:"), F.col("group_id"))
    obj = lambda c: F.concat(F.lit("obj:"), F.col(c))
    edges = p.select(group.alias("src"), obj("key_1").alias("dst")).unionByName(p.select(group.alias("src"), obj("key_2").alias("dst")))
    edges = edges.unionByName(v.all_figures().select(F.concat(F.lit("public:"), F.col("doi")).alias("src"), obj("bytes_md5").alias("dst"))).distinct()
    members = splits.components(edges.select(F.explode(F.array("src", "dst")).alias("node")), "node", edges)
    bad = splits.blocked(members, "node", v.held().select(obj("obj_key").alias("node")))
    return p.withColumn("node", group).join(bad.select("node"), "node", "left_anti").drop("node")


@query(f"{_CLOSURE}, l AS (SELECT fold, group_id FROM pairs WHERE 'group:' || group_id NOT IN (FROM reach)) SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM l) AS kept, (SELECT count(DISTINCT group_id) FROM l) AS groups", "all_figures", "held", "pairs", recursive=True)
def closure_receipt(v: Views):
    """Counts only: pairs before and after, groups left."""
    n = v.pairs().count()
    return _pruned(v).agg(F.lit(n).cast("long").alias("pairs"), F.count("*").alias("kept"), F.countDistinct("group_id").alias("groups"))


@query(f"{_ELIGIBLE} SELECT count(*) AS leaks FROM ok WHERE cap_norm IN (SELECT cap_norm FROM held) OR bytes_md5 IN (SELECT bytes_md5 FROM held) OR px_md5 IN (SELECT px_md5 FROM held) OR dhash IN (FROM hn)", "figures", "held", recursive=True)
def leak_audit(v: Views):
    """Eligible figures that share a key with a held object or are near one: none."""
    return exposed(cut(eligible(v)), keyed_held(v)).agg(F.count("*").alias("leaks"))


def _seed_edges(v: Views, members: DataFrame) -> DataFrame:
    e = splits.component_edges(v.edges(), members, "doi").withColumn("h", seeded("seed", F.col("p"), F.col("q")))
    n = members.select("component").distinct().count()
    return splits.greedy_matching(e, min(32, max(1, n // 40)))


_GREEDY = f"""{_COMP_EDGES},
go AS MATERIALIZED (SELECT p, q, row_number() OVER (ORDER BY sha256('seed' || chr(0) || p || chr(0) || q)) AS r FROM ce),
gl AS (SELECT least(32, greatest(1, count(DISTINCT component) // 40)) AS most FROM comp),
gr(r, used, p, q, took, n) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, false, 0::BIGINT UNION ALL
  SELECT r, CASE WHEN took THEN list_concat(used, [p, q]) ELSE used END, p, q, took, n + took::BIGINT FROM
  (SELECT go.r, gr.used, go.p, go.q, NOT list_contains(gr.used, go.p) AND NOT list_contains(gr.used, go.q) AS took, gr.n FROM gr JOIN go ON go.r = gr.r + 1 WHERE gr.n < (SELECT most FROM gl)))"""


@query(f"{_GREEDY} SELECT p, q FROM gr WHERE took", "figures", "edges", recursive=True)
def greedy_edge_seed(v: Views):
    """The first edges of a greedy matching of component edges in hash order."""
    return _seed_edges(v, paper_components(v)).select("p", "q")


@query(
    f"{_COMPONENTS}, c AS (SELECT DISTINCT component, sha256('fill' || component) AS h FROM comp) SELECT component, row_number() OVER (ORDER BY h, component) <= ceil((SELECT count(*) FROM c) / 20.0) AS chosen FROM c", "figures", recursive=True
)
def dev_fill(v: Views):
    """A twentieth of the components, in hash order."""
    c = paper_components(v).select("component").distinct()
    return splits.budget_fill(c, "component", c.limit(0), "fill")


@query(
    f"{_COMPONENTS}, c AS (SELECT DISTINCT component, sha256('fill' || component) AS h FROM comp), d AS (SELECT component, row_number() OVER (ORDER BY h, component) <= ceil((SELECT count(*) FROM c) / 20.0) AS chosen FROM c) SELECT doi, CASE WHEN chosen THEN 'validation' ELSE 'train' END AS split FROM comp JOIN d USING (component)", "figures", recursive=True
)
def component_split(v: Views):
    """Split of each paper from its component, so no component is on both sides."""
    members = paper_components(v)
    c = members.select("component").distinct()
    chosen = splits.budget_fill(c, "component", c.limit(0), "fill")
    return members.join(chosen, "component").select("doi", F.when(F.col("chosen"), "validation").otherwise("train").alias("split"))
