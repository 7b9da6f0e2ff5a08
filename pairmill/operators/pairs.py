"""Relation-labelled figure pairs by deterministic weighted sampling.

A candidate's key is -ln(u) / w with u from sha256 of seed and ids: taking the smallest
keys is weighted sampling without replacement that any partitioning repeats. Candidate
frames are joins along papers and edges; random pairs come from shifting a hash order, so
no frame is a cross join.

`Pool` draws instead: attempt t picks numbers by hash (a figure, a paper and two of its
figures, an edge, a journal and two of its papers, a node, its neighbour and that one's
neighbour), and equi-joins on ranks turn them into figures. All candidates can be drawn,
with the weights of uniform choices in turn, and an attempt costs the same whatever the
size of a paper, a journal or a node's neighbourhood.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions.hashing import seeded, uniform
from pairmill.operators.ranking import global_rank, range_rank
from pairmill.operators.similarity import within
from pairmill.session import cut


def sampling_key(seed: str, weight: Column, *ids: Column) -> Column:
    return -F.log(uniform(seeded(seed, *ids))) / weight


def _side(figures: DataFrame, i: str) -> DataFrame:
    return figures.select(F.col("doi").alias(f"doi_{i}"), F.col("uuid").alias(f"uuid_{i}"))


def _sizes(figures: DataFrame, i: str) -> DataFrame:
    return figures.groupBy(F.col("doi").alias(f"doi_{i}")).agg(F.count("*").alias(f"n_{i}"))


def same_figure(figures: DataFrame, seed: str) -> DataFrame:
    f = figures.select(F.col("doi").alias("doi_a"), F.col("uuid").alias("uuid_a"), F.col("doi").alias("doi_b"), F.col("uuid").alias("uuid_b"))
    return f.withColumn("key", sampling_key(seed, F.lit(1.0), F.col("uuid_a")))


def same_paper(figures: DataFrame, seed: str) -> DataFrame:
    """Ordered pairs of different figures of a paper; papers weigh alike."""
    pairs = figures.select(F.col("doi").alias("doi_a"), F.col("uuid").alias("uuid_a")).join(figures.select(F.col("doi").alias("doi_a"), F.col("uuid").alias("uuid_b")), "doi_a")
    pairs = pairs.filter("uuid_a <> uuid_b").join(_sizes(figures, "a"), "doi_a")
    w = 1.0 / (F.col("n_a") * (F.col("n_a") - 1))
    return pairs.select("doi_a", "uuid_a", F.col("doi_a").alias("doi_b"), "uuid_b", sampling_key(seed, w, F.col("uuid_a"), F.col("uuid_b")).alias("key"))


def between(figures: DataFrame, paper_pairs: DataFrame, seed: str, weight: str = "1.0D") -> DataFrame:
    """Figure pairs of paper pairs (doi_a, doi_b); figures of a paper weigh alike."""
    pairs = paper_pairs.join(_side(figures, "a"), "doi_a").join(_side(figures, "b"), "doi_b").join(_sizes(figures, "a"), "doi_a").join(_sizes(figures, "b"), "doi_b")
    w = F.expr(weight) / (F.col("n_a") * F.col("n_b"))
    return pairs.select("doi_a", "uuid_a", "doi_b", "uuid_b", sampling_key(seed, w, F.col("uuid_a"), F.col("uuid_b")).alias("key"))


def related(figures: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """Figure pairs of papers joined by an edge, in an orientation drawn per edge."""
    flip = F.substring(seeded(seed, F.lit("orientation"), F.col("src"), F.col("dst")), 1, 1) < "8"
    oriented = edges.select(F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("doi_a"), F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("doi_b"))
    return between(figures, oriented, seed)


def shifted(figures: DataFrame, seed: str, shifts: list[int]) -> DataFrame:
    """Each figure with those `shifts` places further in hash order, round the end: random pairs."""
    ranked = global_rank(figures.withColumn("h", seeded(seed, F.col("uuid"))), "h", "uuid", "rank").select("doi", "uuid", (F.col("rank") - 1).alias("rank"))
    n = figures.count()
    a = ranked.select(F.col("doi").alias("doi_a"), F.col("uuid").alias("uuid_a"), F.explode(F.array(*[(F.col("rank") + s) % max(1, n) for s in shifts])).alias("rank"))
    pairs = a.join(ranked.select(F.col("doi").alias("doi_b"), F.col("uuid").alias("uuid_b"), "rank"), "rank")
    return pairs.select("doi_a", "uuid_a", "doi_b", "uuid_b", sampling_key(seed, F.lit(1.0), F.col("uuid_a"), F.col("uuid_b")).alias("key"))


def without_direct(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of different papers without an edge between them."""
    canon = pairs.withColumn("src", F.least("doi_a", "doi_b")).withColumn("dst", F.greatest("doi_a", "doi_b"))
    return canon.filter("doi_a <> doi_b").join(edges, ["src", "dst"], "left_anti").drop("src", "dst")


def relation(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds y, derived anew from ids and edges: 0 same figure, 1 same paper, 2 edge, 3 none."""
    e = edges.withColumn("cited", F.lit(True))
    canon = pairs.withColumn("src", F.least("doi_a", "doi_b")).withColumn("dst", F.greatest("doi_a", "doi_b")).join(e, ["src", "dst"], "left")
    y = F.when(F.col("uuid_a") == F.col("uuid_b"), 0).when(F.col("doi_a") == F.col("doi_b"), 1).when(F.col("cited"), 2).otherwise(3)
    return canon.withColumn("y", y).drop("src", "dst", "cited")


def reject_near(pairs: DataFrame, figures: DataFrame, radius: int = 8, nibbles: int = 64) -> DataFrame:
    """Pairs whose figures share neither caption nor pixels, nor have image hashes within
    `radius` bits; what is null is like nothing. Captions are compared by md5, so no text is shuffled."""
    short = figures.select("uuid", F.unhex(F.md5(F.col("cap_norm").cast("binary"))).alias("cap_norm"), "px_md5", "dhash")
    part = lambda i: short.select(F.col("uuid").alias(f"uuid_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in ("cap_norm", "px_md5", "dhash")])
    full = pairs.join(part("a"), "uuid_a").join(part("b"), "uuid_b")
    alike = [F.col("cap_norm_a") == F.col("cap_norm_b"), F.col("px_md5_a") == F.col("px_md5_b"), within(F.col("dhash_a"), F.col("dhash_b"), nibbles, radius)]
    none = [~F.coalesce(x, F.lit(False)) for x in alike]
    return full.filter(none[0] & none[1] & none[2]).select(*pairs.columns)


def with_identity(pairs: DataFrame, figures: DataFrame) -> DataFrame:
    """Adds ident: md5 of the image of a and the normalised caption of b."""
    image = figures.select(F.col("uuid").alias("uuid_a"), F.col("bytes_md5").alias("img"))
    caption = figures.select(F.col("uuid").alias("uuid_b"), F.col("cap_norm").alias("cap"))
    full = pairs.join(image, "uuid_a").join(caption, "uuid_b")
    return full.withColumn("ident", F.md5(F.concat("img", F.char(F.lit(0)), "cap").cast("binary"))).drop("img", "cap")


def accept_in_order(by_class: list[DataFrame], quota: int) -> DataFrame:
    """Per class, in order: the least-key row of each identity that no earlier class has
    accepted, then the `quota` least keys. What an earlier class left stays available."""
    out = None
    for y, pairs in enumerate(by_class):
        best = pairs.groupBy("ident").agg(F.min(F.struct("key", "uuid_a", "uuid_b")).alias("m")).select("ident", "m.*")
        if out is not None:
            best = best.join(out.select("ident"), "ident", "left_anti")
        took = best.orderBy("key", "ident").limit(quota).withColumn("y", F.lit(y))
        out = took if out is None else out.unionByName(took)
    return out


def draw(seed: str, what: str, n) -> Column:
    """A number below `n` (a column or an int), by hash of seed, purpose and attempt `t`."""
    return F.conv(F.substring(seeded(seed, F.lit(what), F.col("t")), 1, 12), 16, 10).cast("long") % n


class Pool:
    """Figures (uuid, doi) and edges (src, dst) between their papers, ranked once for drawing."""

    RANDOM, JOURNAL, TWO_HOP = "unrelated_random", "unrelated_same_journal", "unrelated_two_hop"

    def __init__(self, figures: DataFrame, edges: DataFrame, journal: Column):
        self.spark, self._edges, self._journal = figures.sparkSession, edges, journal
        self._figures = figures.filter("doi is not null and doi <> ''").select("doi", "uuid")
        self._n: dict[str, int] = {}

    @cached_property
    def figures(self) -> DataFrame:
        return range_rank(self._figures, "doi", "uuid", out="r")

    @cached_property
    def papers(self) -> DataFrame:
        return range_rank(self.figures.groupBy("doi").agg(F.min("r").alias("first"), F.count("*").alias("n")), "doi", out="p")

    @cached_property
    def shared(self) -> DataFrame:
        return range_rank(self.papers.filter("n > 1").drop("p"), "doi", out="p")

    @cached_property
    def edges(self) -> DataFrame:
        known = self.papers.select("doi")
        real = self._edges.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst").distinct()
        return range_rank(real, "src", "dst", out="i")

    @cached_property
    def neighbours(self) -> DataFrame:
        real = self.edges.select("src", "dst")
        return range_rank(real.toDF("a", "b").unionByName(real.toDF("b", "a")), "a", "b", out="i")

    @cached_property
    def nodes(self) -> DataFrame:
        return range_rank(self.neighbours.groupBy("a").agg(F.min("i").alias("first"), F.count("*").alias("n")), "a", out="p")

    @cached_property
    def journal_papers(self) -> DataFrame:
        named = self.papers.select("doi", self._journal.alias("journal"))
        wide = named.groupBy("journal").agg(F.count("*").alias("n")).filter("n > 1").select("journal")
        return range_rank(named.join(wide, "journal"), "journal", "doi", out="i")

    @cached_property
    def journals(self) -> DataFrame:
        return range_rank(self.journal_papers.groupBy("journal").agg(F.min("i").alias("first"), F.count("*").alias("n")), "journal", out="p")

    def count(self, table: str) -> int:
        if table not in self._n:
            self._n[table] = getattr(self, table).count()
        return self._n[table]

    def _two(self, seed: str, drawn: DataFrame) -> DataFrame:
        """(t, i, j): ranks of two distinct members of groups (first, n), n > 1."""
        i = draw(seed, "first", F.col("n"))
        j = (i + 1 + draw(seed, "second", F.col("n") - 1)) % F.col("n")
        return drawn.select("t", (F.col("first") + i).alias("i"), (F.col("first") + j).alias("j"))

    def _figure(self, drawn: DataFrame, rank: str, uuid: str) -> DataFrame:
        return drawn.join(self.figures.select(F.col("r").alias(rank), F.col("uuid").alias(uuid), F.col("doi").alias(uuid.replace("uuid", "doi"))), rank).drop(rank)

    def _of_papers(self, seed: str, drawn: DataFrame) -> DataFrame:
        """A figure of each of the papers (t, p, q)."""
        at = lambda c: self.papers.select(F.col("doi").alias(c), F.col("first").alias(f"{c}_first"), F.col("n").alias(f"{c}_n"))
        sized = drawn.join(at("p"), "p").join(at("q"), "q")
        ranks = sized.select("t", *[(F.col(f"{c}_first") + draw(seed, f"figure {c}", F.col(f"{c}_n"))).alias(c) for c in "pq"])
        return self._figure(self._figure(ranks, "p", "uuid_a"), "q", "uuid_b")

    def candidates(self, y: int, seed: str, attempts: int, mode: str | None = None) -> DataFrame:
        """(t, uuid_a, doi_a, uuid_b, doi_b) of class y; for class 3 in a mode. Empty if the pool has none."""
        t = self.spark.range(attempts).withColumnRenamed("id", "t")
        need = {0: "figures", 1: "shared", 2: "edges", self.RANDOM: "papers", self.JOURNAL: "journals", self.TWO_HOP: "nodes"}[mode if y == 3 else y]
        n = self.count(need)
        pick = lambda key, what="group": t.withColumn(key, draw(seed, what, max(1, n)))
        if y == 0:
            x = self._figure(pick("r"), "r", "uuid_a")
            out = x.withColumns({"uuid_b": F.col("uuid_a"), "doi_b": F.col("doi_a")})
        elif y == 1:
            ij = self._two(seed, pick("p").join(self.shared, "p"))
            out = self._figure(self._figure(ij, "i", "uuid_a"), "j", "uuid_b")
        elif y == 2:
            e = pick("i").join(self.edges, "i").withColumn("flip", draw(seed, "flip", 2) == 1)
            pq = e.select("t", F.when(F.col("flip"), F.col("dst")).otherwise(F.col("src")).alias("p"), F.when(F.col("flip"), F.col("src")).otherwise(F.col("dst")).alias("q"))
            out = self._of_papers(seed, pq)
        elif mode == self.RANDOM:
            if n < 2:
                return self.candidates(0, seed, 0)
            ij = self._two(seed, t.withColumns({"first": F.lit(0).cast("long"), "n": F.lit(n).cast("long")}))
            at = lambda r, c: self.papers.select(F.col("p").alias(r), F.col("doi").alias(c))
            out = self._of_papers(seed, ij.join(at("i", "p"), "i").join(at("j", "q"), "j").select("t", "p", "q"))
        elif mode == self.JOURNAL:
            ij = self._two(seed, pick("p").join(self.journals, "p"))
            at = lambda r, c: self.journal_papers.select(F.col("i").alias(r), F.col("doi").alias(c))
            out = self._of_papers(seed, ij.join(at("i", "p"), "i").join(at("j", "q"), "j").select("t", "p", "q"))
        else:
            start = pick("p").join(self.nodes, "p").select("t", F.col("a").alias("p"), (F.col("first") + draw(seed, "hop 1", F.col("n"))).alias("i"))
            via = start.join(self.neighbours.select("i", F.col("b").alias("r")), "i")
            last = via.join(self.nodes.select(F.col("a").alias("r"), "first", "n"), "r").select("t", "p", (F.col("first") + draw(seed, "hop 2", F.col("n"))).alias("i"))
            out = self._of_papers(seed, last.join(self.neighbours.select("i", F.col("b").alias("q")), "i").select("t", "p", "q"))
        return out.select("t", "uuid_a", "doi_a", "uuid_b", "doi_b")


#: Attempts per wanted pair, at first and at most.
ATTEMPTS, MOST_ATTEMPTS = 8, 300


def generate(pool: Pool, figures: DataFrame, edges: DataFrame, quota: int, seed: str, last: int = 3) -> DataFrame:
    """(y, mode, t, uuid_a, uuid_b, ident): `quota` pairs of each class up to `last`, no identity twice. The
    classes come in order, class 3 in thirds of its three modes (two-hop stands in for the journal
    mode where no journal has two papers). A class takes its first fitting attempts: not
    near-equal (classes 1 to 3), no direct edge (class 3), the first of its identity, which
    no earlier class or mode has taken. A class that can't be filled is an error."""
    modes = [Pool.RANDOM, Pool.JOURNAL if last == 3 and pool.count("journals") else Pool.TWO_HOP, Pool.TWO_HOP]
    steps = [(0, "same_figure", quota, "0"), (1, "same_paper", quota, "1"), (2, "citation_edge", quota, "2")]
    steps += [(3, mode, (quota - k + 2) // 3, f"3{k}") for k, mode in enumerate(modes)]
    steps = [s for s in steps if s[0] <= last]

    def fitting(which: list[int], per: int) -> DataFrame:
        """(step, t, uuid_a, uuid_b, ident) of the fitting attempts of some steps: the attempts meet
        the figures' contents in one join, so the figures are read once for all of them."""
        drawn = None
        for k in which:
            y, mode, want, salt = steps[k]
            x = pool.candidates(y, f"{seed} {salt}", per * want, mode).select(F.lit(k).alias("step"), F.lit(y).alias("y"), "t", "uuid_a", "doi_a", "uuid_b", "doi_b")
            drawn = x if drawn is None else drawn.unionByName(x)
        drawn = cut(drawn)
        apart = without_direct(drawn.filter("y = 3"), edges).unionByName(drawn.filter("y < 3"))
        ids = drawn.select(F.explode(F.array("uuid_a", "uuid_b")).alias("uuid")).distinct()
        met = cut(figures.join(ids, "uuid", "left_semi").select("uuid", "cap_norm", "bytes_md5", "px_md5", "dhash"))
        keys = met.withColumn("cap_norm", F.md5(F.col("cap_norm").cast("binary")))  # equal captions, short rows
        unlike = reject_near(apart.filter("y > 0"), keys).unionByName(apart.filter("y = 0"))
        named = with_identity(unlike, met)
        return cut(named.groupBy("step", "ident").agg(F.min(F.struct("t", "uuid_a", "uuid_b")).alias("m")).select("step", "ident", "m.*"))

    found = fitting(list(range(len(steps))), ATTEMPTS)
    taken: DataFrame | None = None
    for k, (y, mode, want, _) in enumerate(steps):
        own, per = found.filter(F.col("step") == k), ATTEMPTS
        while True:
            first = own if taken is None else own.join(taken.select("ident"), "ident", "left_anti")
            got = cut(first.orderBy("t").limit(want).select(F.lit(y).alias("y"), F.lit(mode).alias("mode"), "t", "uuid_a", "uuid_b", "ident"))
            if (n := got.count()) == want:
                break
            if per >= MOST_ATTEMPTS:
                raise ValueError(f"class {y}, {mode}: {n} of {want} pairs")
            per = min(4 * per, MOST_ATTEMPTS)
            own = fitting([k], per)
        taken = got if taken is None else taken.unionByName(got)
    return taken
