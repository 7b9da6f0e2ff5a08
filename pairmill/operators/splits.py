"""Closures and leakage-free splits.

Everything hangs on component labels: a component that holds a forbidden node is blocked
as a whole, and pairs are dropped by anti-joins on their endpoints' components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.hashing import seeded
from pairmill.operators.components import connected_components
from pairmill.operators.joins import unpivot_keys
from pairmill.session import cut


def content_edges(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Star edges (src, dst) between nodes that share a key's value: each node to the least
    node of the value, never all pairs."""
    held = unpivot_keys(rows.filter(F.col(node).isNotNull() & (F.col(node) != "")), node, keys).distinct()
    hub = held.groupBy("kind", "value").agg(F.min("id").alias("src"))
    return held.join(hub, ["kind", "value"]).filter("id <> src").select("src", F.col("id").alias("dst")).distinct()


def near_edges(rows: DataFrame, node: str, signature: str, near: DataFrame) -> DataFrame:
    """Edges (src, dst) between the least nodes of two fingerprints of `near` (a, b)."""
    hub = rows.filter(F.col(signature).isNotNull() & F.col(node).isNotNull() & (F.col(node) != "")).groupBy(F.col(signature).alias("s")).agg(F.min(node).alias("hub"))
    at = lambda c, end: hub.select(F.col("s").alias(c), F.col("hub").alias(end))
    return near.select("a", "b").join(at("a", "src"), "a").join(at("b", "dst"), "b").filter("src <> dst").select("src", "dst").distinct()


def components(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes; a node without edges is its own component."""
    linked = connected_components(edges).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(linked, node, "left").select(node, F.coalesce("component", node).alias("component"))


def blocked(members: DataFrame, node: str, seeds: DataFrame) -> DataFrame:
    """Members of every component that holds a seed."""
    roots = members.join(seeds.select(node).distinct(), node, "left_semi").select("component").distinct()
    return members.join(roots, "component", "left_semi")


def fold_split(fold):
    return F.when(fold == 0, "audit").when(fold == 1, "dev").otherwise("train")


def drop_touching(pairs: DataFrame, bad: DataFrame, *keys: str) -> DataFrame:
    """Pairs none of whose keys is in the one column of `bad`."""
    out = pairs
    for k in keys:
        out = out.join(bad.toDF(k).distinct(), k, "left_anti")
    return out


def clean_splits(pairs: DataFrame, key_components: DataFrame) -> DataFrame:
    """Pairs with split, without dev pairs that touch a component of audit, and train pairs
    that touch one of audit or of dev as it was before; then, within a split, whole groups
    of which a pair was dropped. Needs pair_id, fold, group_id, key_1, key_2."""
    comp = lambda i: key_components.toDF(f"key_{i}", f"component_{i}")
    full = cut(pairs.join(comp(1), "key_1").join(comp(2), "key_2").withColumn("split", fold_split(F.col("fold"))))
    ends = lambda *s: full.filter(F.col("split").isin(*s)).select(F.explode(F.array("component_1", "component_2")).alias("c")).distinct()
    dev = drop_touching(full.filter("split = 'dev'"), ends("audit"), "component_1", "component_2")
    train = drop_touching(full.filter("split = 'train'"), ends("audit", "dev"), "component_1", "component_2")
    left = full.filter("split = 'audit'").unionByName(dev).unionByName(train)
    return drop_broken_groups(full, left)


def drop_broken_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` without the groups of a split that lost a pair."""
    broken = before.join(after.select("pair_id"), "pair_id", "left_anti").select("split", "group_id").distinct()
    return after.join(broken, ["split", "group_id"], "left_anti")


def greedy_matching(edges: DataFrame, limit: int) -> DataFrame:
    """The matching a sequential scan in `h` order gives, cut to its first `limit` edges.

    An edge that comes first at both ends is in that matching whatever comes before, so
    rounds of such edges give it whole; each round at least halves the edges that remain in
    expectation. Needs p, q, h. Only the count per round reaches the driver.
    """
    left = cut(edges.select("p", "q", "h"))
    chosen = left.limit(0)
    while not left.isEmpty():
        ends = left.select("h", F.explode(F.array("p", "q")).alias("node"))
        first = ends.groupBy("node").agg(F.min("h").alias("first"))
        at = lambda c: first.toDF(c, f"first_{c}")
        now = left.join(at("p"), "p").join(at("q"), "q").filter("h = first_p and h = first_q").select("p", "q", "h")
        chosen = cut(chosen.unionByName(now))
        used = chosen.select(F.explode(F.array("p", "q")).alias("n")).distinct()
        left = cut(drop_touching(left, used, "p", "q").select("p", "q", "h"))
    return chosen.orderBy("h").limit(limit)


def budget_fill(nodes: DataFrame, node: str, seeded_nodes: DataFrame, seed: str, share: int = 20) -> DataFrame:
    """(node, chosen): all seeded nodes and, in hash order of seed and node, others up to
    one in `share` of all (rounded up)."""
    marked = nodes.select(node).distinct().join(seeded_nodes.toDF(node).distinct().withColumn("seeded", F.lit(True)), node, "left")
    marked = marked.withColumn("seeded", F.coalesce("seeded", F.lit(False))).withColumn("h", seeded(seed, F.col(node), separator=False))
    row = marked.agg(F.count("*").alias("n"), F.count_if("seeded").alias("s")).first()
    more = max(0, max(row["s"], -(-row["n"] // share)) - row["s"])
    fill = marked.filter(~F.col("seeded")).orderBy("h", node).limit(more).select(F.col(node), F.lit(True).alias("fill"))
    return marked.join(fill, node, "left").select(node, (F.col("seeded") | F.coalesce("fill", F.lit(False))).alias("chosen"))


def component_edges(edges: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """Distinct undirected edges (p, q) between the components of edges' ends."""
    m = lambda end, c: members.select(F.col(node).alias(end), F.col("component").alias(c))
    both = edges.join(m("src", "cs"), "src").join(m("dst", "cd"), "dst").filter("cs <> cd")
    return both.select(F.least("cs", "cd").alias("p"), F.greatest("cs", "cd").alias("q")).distinct()


def edges_within(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges both of whose ends are in `nodes`."""
    keep = nodes.select(node).distinct()
    return edges.join(keep.toDF("src"), "src", "left_semi").join(keep.toDF("dst"), "dst", "left_semi").select("src", "dst")


def citation_edges(papers: DataFrame, doi: str, *lists: str) -> DataFrame:
    """Undirected (src, dst), src < dst, from lists of DOIs; no self-loops, no empty ends."""
    ends = papers.select(F.col(doi).alias("a"), F.explode(F.concat(*[F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists])).alias("b"))
    real = ends.filter("a <> '' and b <> '' and a <> b")
    return real.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def two_hop(edges: DataFrame) -> DataFrame:
    """(p, q), p < q: nodes with a common neighbour that are not neighbours themselves."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = both.toDF("r", "p").join(both.toDF("r", "q"), "r").filter("p < q").select("p", "q").distinct()
    return ends.join(edges.toDF("p", "q"), ["p", "q"], "left_anti")


def journal_neighbours(papers: DataFrame, doi: str, journal: str, seed: str) -> DataFrame:
    """(doi, other): for each paper the next of its journal in hash order, the last one
    wrapping to the first: a uniform draw among the journal's others in linear work.
    Journals with one paper give none."""
    h = papers.select(doi, journal).distinct().withColumn("h", seeded(seed, F.col(doi)))
    w = Window.partitionBy(journal).orderBy("h", doi)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = h.withColumn("other", F.coalesce(F.lead(doi).over(w), F.first(doi).over(whole)))
    return nxt.filter(F.col(doi) != F.col("other")).select(doi, "other", journal)
