"""Queries of pair generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions import text
from pairmill.operators import pairs, unrank
from pairmill.plans.fixtures import Views, near_sql
from pairmill.plans.registry import query
from pairmill.session import cut

#: Pairs wanted of each class: this share of the figures, one at least.
SHARE = 10
_QUOTA = f"quo AS (SELECT least(greatest(1, (SELECT count(*) FROM figures) // {SHARE}), count(*))::BIGINT AS quota FROM (SELECT DISTINCT bytes_md5, cap_norm FROM figures))"
SHIFTS = [1, 7]


def _u(*parts: str) -> str:
    joined = " || chr(0) || ".join(parts)
    return f"((('0x' || left(sha256({joined}), 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def _key(seed: str, weight: str, *ids: str) -> str:
    return f"-ln({_u(repr(seed), *ids)}) / ({weight})"


_SAME_FIGURE = f"SELECT doi AS doi_a, uuid AS uuid_a, doi AS doi_b, uuid AS uuid_b, {_key('same_figure', '1.0', 'uuid')} AS key FROM figures"
_SAME_PAPER = f"SELECT a.doi AS doi_a, a.uuid AS uuid_a, b.doi AS doi_b, b.uuid AS uuid_b, {_key('same_paper', '1.0 / (n * (n - 1))', 'a.uuid', 'b.uuid')} AS key FROM figures a JOIN figures b ON a.doi = b.doi AND a.uuid <> b.uuid JOIN (SELECT doi, count(*) AS n FROM figures GROUP BY doi) s ON s.doi = a.doi"
_ORIENTED = "SELECT CASE WHEN left(sha256('related' || chr(0) || 'orientation' || chr(0) || src || chr(0) || dst), 1) < '8' THEN src ELSE dst END AS doi_a, CASE WHEN left(sha256('related' || chr(0) || 'orientation' || chr(0) || src || chr(0) || dst), 1) < '8' THEN dst ELSE src END AS doi_b FROM edges"
_RELATED = f"SELECT o.doi_a, a.uuid AS uuid_a, o.doi_b, b.uuid AS uuid_b, {_key('related', '1.0 / (na.n * nb.n)', 'a.uuid', 'b.uuid')} AS key FROM ({_ORIENTED}) o JOIN figures a ON a.doi = doi_a JOIN figures b ON b.doi = doi_b JOIN (SELECT doi, count(*) AS n FROM figures GROUP BY doi) na ON na.doi = doi_a JOIN (SELECT doi, count(*) AS n FROM figures GROUP BY doi) nb ON nb.doi = doi_b"
_RANKED = "SELECT doi, uuid, row_number() OVER (ORDER BY sha256('random' || chr(0) || uuid), uuid) - 1 AS r, (SELECT count(*) FROM figures) AS n FROM figures"
_SHIFTED = f"SELECT a.doi AS doi_a, a.uuid AS uuid_a, b.doi AS doi_b, b.uuid AS uuid_b, {_key('random', '1.0', 'a.uuid', 'b.uuid')} AS key FROM ({_RANKED}) a, (VALUES (1), (7)) s(k), ({_RANKED}) b WHERE b.r = (a.r + k) % a.n"
_UNRELATED = f"SELECT * FROM ({_SHIFTED}) WHERE doi_a <> doi_b AND (least(doi_a, doi_b), greatest(doi_a, doi_b)) NOT IN (SELECT (src, dst) FROM edges)"


@query(f"{_QUOTA} SELECT quota FROM quo", "figures")
def class_quota(v: Views):
    """The wanted share of the figures, or the number of distinct contents where that is less."""
    per = v.figures().groupBy("bytes_md5", F.md5(F.col("cap_norm").cast("binary")).alias("cap")).agg(F.count("*").alias("c"))
    n = per.agg(F.count("*").alias("n"), F.sum("c").alias("all"))
    return n.select(F.least(F.greatest(F.lit(1), F.expr(f"all div {SHARE}")), "n").cast("long").alias("quota"))


#: Attempts per wanted pair in SQL: more than the tables' classes need, so that they are filled there
#: by the same first attempts as in Spark.
SQL_ATTEMPTS = 48
#: The pool of a drawing, ranked, in SQL.
_POOL = """
fig AS (SELECT doi, uuid, row_number() OVER (ORDER BY doi, uuid) - 1 AS r FROM figures),
pap AS (SELECT doi, min(r) AS f, count(*) AS n, row_number() OVER (ORDER BY doi) - 1 AS p FROM fig GROUP BY doi),
sp AS (SELECT f, n, row_number() OVER (ORDER BY doi) - 1 AS p FROM pap WHERE n > 1),
rel AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS i FROM edges WHERE src IN (SELECT doi FROM pap) AND dst IN (SELECT doi FROM pap)),
adj AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS i FROM (SELECT src AS a, dst AS b FROM rel UNION ALL SELECT dst, src FROM rel)),
nod AS (SELECT a, min(i) AS f, count(*) AS n, row_number() OVER (ORDER BY a) - 1 AS p FROM adj GROUP BY a),
jn AS (SELECT doi, string_split(doi, '/')[1] || '/' || string_split(doi, '/')[2] AS j FROM pap),
jp AS (SELECT doi, j, row_number() OVER (ORDER BY j, doi) - 1 AS i FROM jn WHERE j IN (SELECT j FROM jn GROUP BY j HAVING count(*) > 1)),
jo AS (SELECT j, min(i) AS f, count(*) AS n, row_number() OVER (ORDER BY j) - 1 AS p FROM jp GROUP BY j)"""


def _hash(seed: str, what: str, n: str) -> str:
    return f"(('0x' || left(sha256('{seed}' || chr(0) || '{what}' || chr(0) || t), 12))::BIGINT % {n})"


def _pick(seed: str, table: str, what: str = "group") -> str:
    return _hash(seed, what, f"(SELECT count(*) FROM {table})")


def _two(seed: str, rows: str) -> str:
    """Ranks of two members of a drawn group (t, f, n)."""
    i = _hash(seed, "first", "n")
    return f"SELECT t, f + {i} AS i, f + ({i} + 1 + {_hash(seed, 'second', '(n - 1)')}) % n AS j FROM ({rows})"


def _of_papers(seed: str, rows: str) -> str:
    x, y = (_hash(seed, f"figure {c}", f"{c}.n") for c in "pq")
    return f"SELECT t, a.uuid AS uuid_a, a.doi AS doi_a, b.uuid AS uuid_b, b.doi AS doi_b FROM ({rows}) d JOIN pap p ON p.doi = d.p JOIN pap q ON q.doi = d.q JOIN fig a ON a.r = p.f + {x} JOIN fig b ON b.r = q.f + {y}"


def _drawn(y: int, seed: str, mode: str = "") -> str:
    t = f"(SELECT unnest(range({SQL_ATTEMPTS} * quota)) AS t FROM quo) t"
    if y == 0:
        return f"SELECT t, uuid AS uuid_a, doi AS doi_a, uuid AS uuid_b, doi AS doi_b FROM (SELECT t, {_pick(seed, 'fig')} AS r FROM {t}) JOIN fig USING (r)"
    if y == 1:
        ij = _two(seed, f"SELECT t, f, n FROM (SELECT t, {_pick(seed, 'sp')} AS p FROM {t}) JOIN sp USING (p)")
        return f"SELECT t, a.uuid AS uuid_a, a.doi AS doi_a, b.uuid AS uuid_b, b.doi AS doi_b FROM ({ij}) d JOIN fig a ON a.r = d.i JOIN fig b ON b.r = d.j"
    if y == 2:
        e = f"SELECT t, src, dst, {_hash(seed, 'flip', '2')} AS flip FROM (SELECT t, {_pick(seed, 'rel')} AS i FROM {t}) JOIN rel USING (i)"
        return _of_papers(seed, f"SELECT t, CASE flip WHEN 1 THEN dst ELSE src END AS p, CASE flip WHEN 1 THEN src ELSE dst END AS q FROM ({e})")
    if mode == pairs.Pool.RANDOM:
        ij = _two(seed, f"SELECT t, 0 AS f, (SELECT count(*) FROM pap) AS n FROM {t}")
        return _of_papers(seed, f"SELECT t, x.doi AS p, y.doi AS q FROM ({ij}) d JOIN pap x ON x.p = d.i JOIN pap y ON y.p = d.j")
    if mode == pairs.Pool.JOURNAL:
        ij = _two(seed, f"SELECT t, f, n FROM (SELECT t, {_pick(seed, 'jo')} AS p FROM {t} WHERE (SELECT count(*) FROM jo) > 0) JOIN jo USING (p)")
        return _of_papers(seed, f"SELECT t, x.doi AS p, y.doi AS q FROM ({ij}) d JOIN jp x ON x.i = d.i JOIN jp y ON y.i = d.j")
    start = f"SELECT t, a AS p, f + {_hash(seed, 'hop 1', 'n')} AS i FROM (SELECT t, {_pick(seed, 'nod')} AS p FROM {t}) JOIN nod USING (p)"
    last = f"SELECT t, s.p, n.f + {_hash(seed, 'hop 2', 'n.n')} AS i FROM ({start}) s JOIN adj ON adj.i = s.i JOIN nod n ON n.a = adj.b"
    return _of_papers(seed, f"SELECT t, l.p, adj.b AS q FROM ({last}) l JOIN adj USING (i)")


_APART = "(least(doi_a, doi_b), greatest(doi_a, doi_b)) NOT IN (SELECT (src, dst) FROM edges) AND doi_a <> doi_b"
_UNLIKE = f"a.cap_norm <> b.cap_norm AND a.px_md5 <> b.px_md5 AND NOT {near_sql('a.dhash', 'b.dhash')}"


def _generated() -> str:
    """The classes and modes in order, each without the identities taken before."""
    hop, journal = pairs.Pool.TWO_HOP, pairs.Pool.JOURNAL
    modes = [(3, pairs.Pool.RANDOM, 0), (3, journal, 1), (3, hop, 2)]
    steps = [(0, "same_figure", "0", "quota"), (1, "same_paper", "1", "quota"), (2, "citation_edge", "2", "quota")] + [(y, m, f"3{k}", f"(quota - {k} + 2) // 3") for y, m, k in modes]
    parts = []
    for k, (y, mode, salt, want) in enumerate(steps):
        seed = f"pairs {salt}"
        rows = _drawn(y, seed, mode)
        name = f"'{mode}'"
        if mode == journal:  # two-hop where no journal has two papers
            rows = f"SELECT * FROM ({rows}) UNION ALL SELECT * FROM ({_drawn(3, seed, hop)}) WHERE (SELECT count(*) FROM jo) = 0"
            name = f"CASE WHEN (SELECT count(*) FROM jo) = 0 THEN '{hop}' ELSE '{mode}' END"
        keep = " AND ".join(["true", *([_UNLIKE] if y else []), *([_APART] if y == 3 else [])])
        ident = f"SELECT t, uuid_a, uuid_b, md5(a.bytes_md5 || chr(0) || b.cap_norm) AS ident FROM ({rows}) JOIN figures a ON a.uuid = uuid_a JOIN figures b ON b.uuid = uuid_b WHERE {keep}"
        before = "".join(f" AND ident NOT IN (SELECT ident FROM g{i})" for i in range(k))
        first = f"SELECT * FROM ({ident}) WHERE true{before} QUALIFY row_number() OVER (PARTITION BY ident ORDER BY t) = 1"
        parts.append(f"g{k} AS MATERIALIZED (SELECT {y} AS y, {name} AS mode, t, uuid_a, uuid_b, ident FROM ({first}) QUALIFY row_number() OVER (ORDER BY t) <= (SELECT {want} FROM quo))")
    union = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(parts)))
    return f"{_QUOTA}, {_POOL}, {', '.join(parts)}, out AS ({union})"


def _pairs(v: Views, last: int = 3):
    f, e = v.figures(), cut(v.edges())
    return pairs.generate(pairs.Pool(f, e, text.journal(F.col("doi"))), f, e, class_quota(v).first()["quota"], "pairs", last)


def _class(y: int, v: Views):
    return _pairs(v, y).filter(F.col("y") == y).select("mode", "uuid_a", "uuid_b")


_OF_CLASS = "SELECT mode, uuid_a, uuid_b FROM out WHERE y = "


@query(f"{_generated()} {_OF_CLASS}0", "figures", "edges")
def pairs_same_figure(v: Views):
    return _class(0, v)


@query(f"{_generated()} {_OF_CLASS}1", "figures", "edges")
def pairs_same_paper(v: Views):
    return _class(1, v)


@query(f"{_generated()} {_OF_CLASS}2", "figures", "edges")
def pairs_related(v: Views):
    return _class(2, v)


@query(f"{_generated()} {_OF_CLASS}3", "figures", "edges")
def pairs_unrelated(v: Views):
    """The three modes in turn: each gives its third of the quota."""
    return _class(3, v)


@query(f"{_generated()} SELECT y, uuid_a, uuid_b, ident FROM out", "figures", "edges")
def pair_dedup(v: Views):
    """All four classes in order, no identity twice."""
    return _pairs(v).select("y", "uuid_a", "uuid_b", "ident")


@query("SELECT a.doi, a.uuid AS uuid_a, b.uuid AS uuid_b FROM figures a JOIN figures b ON a.doi = b.doi AND a.uuid <> b.uuid", "figures")
def same_paper(v: Views):
    """All ordered pairs of a paper's figures."""
    return pairs.same_paper(v.figures(), "same_paper").select(F.col("doi_a").alias("doi"), "uuid_a", "uuid_b")


@query(f"SELECT doi_a, uuid_a, doi_b, uuid_b FROM ({_RELATED})", "figures", "edges")
def related_pairs(v: Views):
    return pairs.related(v.figures(), v.edges(), "related").select("doi_a", "uuid_a", "doi_b", "uuid_b")


@query(f"SELECT doi_a, uuid_a, doi_b, uuid_b FROM ({_UNRELATED})", "figures", "edges")
def unrelated_pairs(v: Views):
    random = pairs.shifted(v.figures(), "random", SHIFTS)
    return pairs.without_direct(random, v.edges()).select("doi_a", "uuid_a", "doi_b", "uuid_b")


@query(f"SELECT r.uuid_a, r.uuid_b FROM ({_RELATED}) r JOIN figures a ON a.uuid = r.uuid_a JOIN figures b ON b.uuid = r.uuid_b WHERE {_UNLIKE}", "figures", "edges")
def near_reject(v: Views):
    return pairs.reject_near(pairs.related(v.figures(), v.edges(), "related"), v.figures()).select("uuid_a", "uuid_b")


@query(f"SELECT y, count(*) AS n FROM (SELECT CASE WHEN uuid_a = uuid_b THEN 0 WHEN doi_a = doi_b THEN 1 WHEN (least(doi_a, doi_b), greatest(doi_a, doi_b)) IN (SELECT (src, dst) FROM edges) THEN 2 ELSE 3 END AS y FROM (SELECT doi_a, uuid_a, doi_b, uuid_b FROM ({_SAME_FIGURE}) UNION ALL SELECT doi_a, uuid_a, doi_b, uuid_b FROM ({_SAME_PAPER}) UNION ALL SELECT doi_a, uuid_a, doi_b, uuid_b FROM ({_RELATED}) UNION ALL SELECT doi_a, uuid_a, doi_b, uuid_b FROM ({_UNRELATED}))) GROUP BY y", "figures", "edges")
def relation_label(v: Views):
    """Labels derived anew for all candidates of all classes."""
    f, e = v.figures(), v.edges()
    cols = ["doi_a", "uuid_a", "doi_b", "uuid_b"]
    frames = [pairs.same_figure(f, "s"), pairs.same_paper(f, "s"), pairs.related(f, e, "related"), pairs.without_direct(pairs.shifted(f, "random", SHIFTS), e)]
    everything = frames[0].select(*cols)
    for x in frames[1:]:
        everything = everything.unionByName(x.select(*cols))
    return pairs.relation(everything, e).groupBy("y").agg(F.count("*").alias("n"))


#: Pairs drawn from whole spaces, per group in it.
PER_GROUP = 2


def _unranked(seed: str, groups: str) -> str:
    """(t, first, i, j) of the drawn pairs of groups (first, n), in SQL."""
    numbers = unrank.permuted_sql("SELECT unnest(range(least(1::BIGINT << (a + b), ((wanted::HUGEINT * (1::BIGINT << (a + b)) + space - 1) // space)::BIGINT))) AS t FROM par", seed)
    sizes = "WITH RECURSIVE jj AS (SELECT 1::BIGINT AS j UNION ALL SELECT j + 1 FROM jj WHERE j < (SELECT max(n) FROM gr))"
    return (
        f"gr AS ({groups}), spa AS (SELECT first, n, n * (n - 1) // 2 AS pairs, (sum(n * (n - 1) // 2) OVER (ORDER BY first) - n * (n - 1) // 2)::BIGINT AS start FROM gr WHERE n > 1), "
        f"tot AS (SELECT sum(pairs)::BIGINT AS space, {PER_GROUP} * count(*) AS wanted FROM spa), bit AS (SELECT *, greatest(2, CASE WHEN space > 1 THEN length(ltrim(bin(space - 1), '0')) ELSE 0 END)::INT AS bits FROM tot), par AS (SELECT space, wanted, bits - bits // 2 AS a, bits // 2 AS b FROM bit), "
        f"num AS ({numbers}), drawn AS ({sizes} SELECT t, first, m - start - j * (j - 1) // 2 AS i, j FROM num JOIN spa ON m >= start AND m < start + pairs JOIN jj ON m - start >= j * (j - 1) // 2 AND m - start < j * (j + 1) // 2)"
    )


def _draw(groups, seed: str):
    return unrank.draw(groups, PER_GROUP * groups.filter("n > 1").count(), seed)


@query(f"{_POOL}, {_unranked('paper pairs', 'SELECT f AS first, n FROM pap')} SELECT t, a.uuid AS uuid_a, b.uuid AS uuid_b FROM drawn JOIN fig a ON a.r = first + i JOIN fig b ON b.r = first + j", "figures", "edges")
def same_paper_drawn(v: Views):
    """Distinct pairs of figures of one paper, drawn from all such pairs of all papers."""
    pool = pairs.Pool(v.figures(), v.edges(), text.journal(F.col("doi")))
    at = lambda c, u: pool.figures.select(F.col("r").alias(c), F.col("uuid").alias(u))
    drawn = _draw(pool.papers, "paper pairs").select("t", (F.col("first") + F.col("i")).alias("x"), (F.col("first") + F.col("j")).alias("y"))
    return drawn.join(at("x", "uuid_a"), "x").join(at("y", "uuid_b"), "y").select("t", "uuid_a", "uuid_b")


@query(f"{_POOL}, {_unranked('journal pairs', 'SELECT f AS first, n FROM jo')} SELECT t, a.doi AS doi_a, b.doi AS doi_b FROM drawn JOIN jp a ON a.i = first + drawn.i JOIN jp b ON b.i = first + drawn.j", "figures", "edges")
def same_journal_drawn(v: Views):
    """Distinct pairs of papers of one journal, drawn from all such pairs of all journals."""
    pool = pairs.Pool(v.figures(), v.edges(), text.journal(F.col("doi")))
    at = lambda c, d: pool.journal_papers.select(F.col("i").alias(c), F.col("doi").alias(d))
    drawn = _draw(pool.journals, "journal pairs").select("t", (F.col("first") + F.col("i")).alias("x"), (F.col("first") + F.col("j")).alias("y"))
    return drawn.join(at("x", "doi_a"), "x").join(at("y", "doi_b"), "y").select("t", "doi_a", "doi_b")


_ALL_PAPERS = "SELECT 0::BIGINT AS first, count(*) AS n FROM pap"


@query(f"{_POOL}, {_unranked('paper space', _ALL_PAPERS).replace(f'{PER_GROUP} * count(*)', f'{PER_GROUP} * max(n)')} SELECT t, a.doi AS doi_a, b.doi AS doi_b FROM drawn JOIN pap a ON a.p = i JOIN pap b ON b.p = j WHERE (a.doi, b.doi) NOT IN (SELECT (src, dst) FROM edges)", "figures", "edges")
def non_edges_drawn(v: Views):
    """Distinct pairs of papers without an edge, drawn from all pairs of papers."""
    pool = pairs.Pool(v.figures(), v.edges(), text.journal(F.col("doi")))
    n = pool.count("papers")
    everything = v.spark.range(1).select(F.lit(0).cast("long").alias("first"), F.lit(n).cast("long").alias("n"))
    at = lambda c, d: pool.papers.select(F.col("p").alias(c), F.col("doi").alias(d))
    drawn = unrank.draw(everything, PER_GROUP * n, "paper space").select("t", F.col("i").alias("x"), F.col("j").alias("y"))
    return pairs.without_direct(drawn.join(at("x", "doi_a"), "x").join(at("y", "doi_b"), "y"), v.edges()).select("t", "doi_a", "doi_b")
