"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its NEAREST nearest reference points (pivots) in order. Inverted
lists, one per label and set of SHARED pivots, hold the vectors that have those among their
nearest, with the places they have there; two vectors of a common list have a shared-pivot
count of at least SHARED. Those whose places of the list's pivots differ by more than RANKS in
sum see the pivots in another order and aren't retrieved by this list. Pairs so retrieved are
verified by their cosine in double precision, so no false link passes.

Equal vectors of a label form one class first (a partial aggregation), so a vector with
any number of copies is one row of the index, and links of copies are arithmetic: a row's
links are the other rows of its class and all rows of the linked classes. The pivots are a
bounded sample of each length: classes that come first in a hash order, half of them, PIVOTS_LOW
at least and PIVOTS_HIGH or PIVOT_BYTES at most. So many pivots stand inside each topic of
unlinked vectors too, and lists of three stay short there. No list is capped.

A group with a large share of the vectors would take most of the pivots, whose order around
its members is noise. So a sampled vector that many of the sample are linked with becomes
the centre of a dense region first. Every vector linked with a centre is in the core of the
nearest one and is compared, in blocks, with all vectors within twice the angle of a link,
so all its links are found. Such a vector needs no index; the others are indexed with pivots
from among themselves. Blocks give sums of links and a spanning forest, never the pairs.

Defined cases. Rows whose label, id or vector is null, whose vector is empty, zero or holds
a null or non-finite component link with nothing and are components of their own. Vectors
of different length never link. Repeated rows are vectors of their own. Ties: a component
is named by its smallest id. No rows: no rows. Other columns, whatever their names, aren't
looked at. Vectors are one class if they are equal, not if a hash of them is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, cos

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pairmill.operators.components import connected_components
from pairmill.operators.joins import join_hot
from pairmill.session import cut

COSINE = 0.93
NEAREST, SHARED, RANKS = 12, 3, 15
PIVOTS_LOW, PIVOTS_HIGH, PIVOT_BYTES = 256, 8192, 32 << 20
#: Rows of a product with all pivots at once.
ROWS_AT_ONCE = 512
#: A sampled vector linked with DENSE others is a dense region's centre; rows of a block.
DENSE, BLOCK = 4, 2048
#: Sampled vectors, of each length, among which centres are looked for.
SAMPLED = 4096


def usable(label: Column, vec_id: Column, vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & vec_id.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _index(pivots: dict[int, np.ndarray]):
    """(label, dim, list, cid, places) for each set of SHARED pivots among a vector's nearest;
    `places` has their ranks, four bits each, in the order of the pivots' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                every = b.filter(pa.array(dims == dim))
                for at in range(0, every.num_rows, ROWS_AT_ONCE):
                    part = every.slice(at, ROWS_AT_ONCE)
                    far = -(_unit(_matrix(part.column(2))) @ pivots[dim].T)
                    k = min(NEAREST, far.shape[1])
                    t = min(SHARED, k)
                    order = np.argpartition(far, k - 1, axis=1)[:, :k]
                    order = np.take_along_axis(order, np.lexsort((order, np.take_along_axis(far, order, 1))), 1)
                    rank = np.argsort(order, axis=1)  # by number of the pivot
                    number = np.take_along_axis(order, rank, 1)
                    sets = list(combinations(range(k), t))
                    keys = number[:, sets] @ (PIVOTS_HIGH ** np.arange(t)).astype(np.int64)
                    places = rank[:, sets] @ (16 ** np.arange(t)).astype(np.int64)
                    n = keys.shape[1]
                    yield pa.record_batch(
                        {
                            "label": part.column(1).take(pa.array(np.repeat(np.arange(len(keys)), n))),
                            "dim": np.full(keys.size, dim, dtype=np.int32),
                            "list": keys.ravel(),
                            "cid": np.repeat(part.column(0).to_numpy(), n),
                            "places": places.ravel().astype(np.int32),
                        }
                    )

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            dims = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, y = _matrix(part.column(2)), _matrix(part.column(3))
                x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
                cos = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield part.select([0, 1]).append_column("cosine", pa.array(cos)).filter(pa.array(cos >= least))

    return run


def vector_hash(label: Column, vector: Column) -> Column:
    """Shuffled instead of a vector where rows meet their class; vectors decide."""
    return F.xxhash64(label, vector)


def classes(rows: DataFrame) -> DataFrame:
    """(cid, h, label, vector, n, least): a row for each distinct usable vector of a label, with
    a number of its own."""
    own = rows.groupBy("h", "label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return cut(own.select(F.monotonically_increasing_id().alias("cid"), "h", "label", "vector", "n", "least"))


def _sample(own: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors of the classes that come first in hash order, by length."""
    sized = own.select("h", "least", "vector", F.size("vector").alias("dim"))
    counts = {r["dim"]: r["count"] for r in sized.groupBy("dim").count().collect()}
    if not counts:
        return {}
    sizes = {d: min(PIVOTS_HIGH, max(PIVOTS_LOW, PIVOT_BYTES // (8 * d)), max(PIVOTS_LOW, ceil(n / 2))) for d, n in counts.items()}
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("h"), "least"))
    limit = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("dim")]
    first = sized.withColumn("place", place).filter(F.col("place") <= max(sizes.values())).filter(F.col("place") <= limit)
    found = first.select("dim", "place", "vector").toArrow().sort_by([("dim", "ascending"), ("place", "ascending")])
    dims = found.column("dim").to_numpy()
    return {d: _unit(_matrix(found.filter(pa.array(dims == d)).column("vector"))) for d in sizes}


def _centres(sample: dict[int, np.ndarray], least: float) -> dict[int, np.ndarray]:
    """Centres by length, so that no sampled vector has DENSE linked ones outside all cores."""
    found = {}
    for dim, x in sample.items():
        x = x[:SAMPLED]
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        chosen = []
        while True:
            n = near.sum(1)
            best = int(n.argmax())
            if n[best] < DENSE:
                break
            chosen.append(best)
            covered = near[best].copy()
            covered[best] = True
            near[covered] = False
            near[:, covered] = False
        if chosen:
            found[dim] = x[chosen]
    return found


def _homes(centres: dict[int, np.ndarray], least: float):
    """The rows with `home`: the nearest centre a vector is linked with, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("vector").value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                home = np.full(part.num_rows, -1, dtype=np.int32)
                if dim in centres:
                    near = _unit(_matrix(part.column("vector"))) @ centres[dim].T
                    home = np.where(near.max(1) >= least, near.argmax(1), -1).astype(np.int32)
                yield part.append_column("home", pa.array(home))

    return run


def _regions(centres: dict[int, np.ndarray], least: float):
    """(cid, label, vector, n, home, dim, centre) for each centre within twice a link's angle."""
    wide = cos(min(2 * acos(least), np.pi)) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("vector").value_lengths().to_numpy()
            for dim in np.unique(dims):
                if dim not in centres:
                    continue
                part = b.filter(pa.array(dims == dim))
                row, centre = np.nonzero(_unit(_matrix(part.column("vector"))) @ centres[dim].T >= wide)
                for i in range(0, len(row), BLOCK):
                    at = part.take(pa.array(row[i : i + BLOCK]))
                    at = at.append_column("dim", pa.array(np.full(at.num_rows, dim, dtype=np.int32)))
                    yield at.append_column("centre", pa.array(centre[i : i + BLOCK].astype(np.int32)))

    return run


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect what all links connect."""
    done_r, done_c = ~link.any(1), np.zeros(link.shape[1], dtype=bool)
    ends: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for r in range(len(link)):
        if done_r[r]:
            continue
        done_r[r], front = True, np.array([r])
        while len(front):
            cols = np.flatnonzero(link[front].any(0) & ~done_c)
            ends.append((front[link[np.ix_(front, cols)].argmax(0)], cols))
            done_c[cols] = True
            rows = np.flatnonzero(link[:, cols].any(1) & ~done_r)
            if len(rows):
                ends.append((rows, cols[link[np.ix_(rows, cols)].argmax(1)]))
            done_r[rows], front = True, rows
    return np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.int64())])


def _meet(least: float):
    """Of a block of a core and one of its region: (cid, null, rows linked) and edges (a, b, null)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _MET.empty_table()
        right = right.rename_columns([c.removeprefix("to_") for c in right.column_names])
        x, y = (_unit(_matrix(t.column("vector"))) for t in (left, right))
        xc, yc, xn, yn = (t.column(c).to_numpy() for c in ("cid", "n") for t in (left, right))
        centre, home = left.column("home")[0].as_py(), right.column("home").to_numpy()
        link = np.empty((len(x), len(y)), dtype=bool)
        for i in range(0, len(x), 256):
            link[i : i + 256] = x[i : i + 256] @ y.T >= least
        # each pair once: two core vectors meet in the region of each one's centre
        link &= (home < 0) | (home > centre) | ((home == centre) & (xc[:, None] < yc))
        rows, cols = _forest(link)
        far = np.concatenate([link @ yn, xn @ link])
        ids = np.concatenate([xc, yc])
        some = far > 0
        counts, edges = int(some.sum()), len(rows)
        return pa.table(
            [
                pa.array(np.concatenate([ids[some], xc[rows]])),
                pa.concat_arrays([pa.nulls(counts, pa.int64()), pa.array(yc[cols])]),
                pa.concat_arrays([pa.array(far[some]), pa.nulls(edges, pa.int64())]),
            ],
            schema=_MET,
        )

    return run


def dense_links(homed: DataFrame, centres: dict[int, np.ndarray], least: float = COSINE) -> DataFrame:
    """(a, b, far): for vectors of cores and all they are linked with, sums of linked rows
    (b null, to be added up by a) and edges (far null) that connect them."""
    kinds = {f.name: f for f in homed.schema}
    fields = [kinds[c] for c in ("cid", "label", "vector", "n", "home")]
    schema = StructType([*fields, StructField("dim", IntegerType()), StructField("centre", IntegerType())])
    members = cut(homed.select(*[f.name for f in fields]).mapInArrow(_regions(centres, least), schema))
    of = ["label", "dim", "centre"]
    core = F.col("home") == F.col("centre")
    sizes = members.groupBy(*of).agg(F.ceil(F.count("*") / BLOCK).alias("js"), F.ceil(F.sum(core.cast("long")) / BLOCK).alias("is")).filter("is > 0")
    named = members.join(F.broadcast(sizes), of)
    i, j = F.expr("pmod(cid, `is`)").alias("i"), F.expr("pmod(cid, js)").alias("j")
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    cols = [*of, "cid", "vector", "n", "home"]
    left = named.filter(core).select(*cols, i, every("js", "j"))
    right = named.select(*cols, j, every("is", "i"))
    # other names, or Spark takes the two sides' columns for the same
    right = right.toDF(*[f"to_{c}" for c in right.columns])
    keys = [*of, "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"to_{c}" for c in keys])).applyInArrow(_meet(least), "a long, b long, far long")


def class_links(own: DataFrame, least: float = COSINE) -> DataFrame:
    """(a, b, cosine), a < b: linked classes that the index retrieves."""
    pivots = _sample(own)
    indexed = own.filter(F.size("vector").isin(*pivots)) if pivots else own.limit(0)
    label = dict(own.dtypes)["label"]
    lists = indexed.select("cid", "label", "vector").mapInArrow(_index(pivots), f"label {label}, dim int, list long, cid long, places int")
    other = lists.withColumnRenamed("cid", "other").withColumnRenamed("places", "theirs")
    place = lambda c, i: F.shiftright(c, 4 * i).bitwiseAND(F.lit(15))
    apart = sum((F.abs(place("places", i) - place("theirs", i)) for i in range(1, SHARED)), F.abs(place("places", 0) - place("theirs", 0)))
    pairs = lists.join(other, ["label", "dim", "list"]).filter("cid < other").filter(apart <= RANKS).select("cid", "other").distinct()
    vectors = own.select("cid", "vector")
    a, b = vectors.toDF("cid", "va"), vectors.toDF("other", "vb")
    both = pairs.join(a, "cid").join(b, "other").select(F.col("cid").alias("a"), F.col("other").alias("b"), "va", "vb")
    return both.mapInArrow(_verify(least), "a long, b long, cosine double")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    # adding 0 makes -0.0 and 0.0 one value
    vector = F.transform(F.col(vector_col), lambda x: x + F.lit(0.0).cast(dict(df.dtypes)[vector_col][6:-1]))
    rows = df.select(F.col(id_col).alias("vec_id"), vector.alias("vector"), F.col(label_col).alias("label"))
    good = usable(F.col("label"), F.col("vec_id"), F.col("vector"))
    marked = cut(rows.withColumn("h", F.when(good, vector_hash(F.col("label"), F.col("vector")))))
    own = classes(marked.filter("h is not null"))
    centres = _centres(_sample(own), COSINE)
    homed = cut(own.mapInArrow(_homes(centres, COSINE), StructType([*own.schema, StructField("home", IntegerType())]))) if centres else None
    links = cut(class_links(homed.filter("home < 0").drop("home") if centres else own))
    sizes = own.select("cid", "n")
    ends = links.select(F.col("a").alias("cid"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("cid"), F.col("a").alias("to")))
    far = ends.join(sizes.withColumnRenamed("cid", "to"), "to").select("cid", F.col("n").alias("far"))
    edges = links.select("a", "b")
    if centres:
        dense = cut(dense_links(homed, centres))
        far = far.unionByName(dense.filter("b is null").select(F.col("a").alias("cid"), "far"))
        edges = edges.unionByName(dense.filter("b is not null").select("a", "b"))
    linked = far.groupBy("cid").agg(F.sum("far").alias("far"))
    parts = connected_components(edges, "a", "b").select(F.col("node").alias("cid"), F.col("component").alias("root"))
    rooted = cut(own.select("cid", "n", "least").join(parts, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    per_class = join_hot(rooted, named, "root", "members").join(linked, "cid", "left")
    facts = per_class.select("cid", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id").join(own.drop("least"), "cid")
    # classes of one hash, as a rule one, stand in one row
    by_hash = cut(facts.groupBy("h").agg(F.collect_list(F.struct("label", "vector", "n_links", "component_id")).alias("classes"), F.sum("n").alias("n")))
    met = join_hot(marked.filter("h is not null"), by_hash, "h", "n")
    mine = F.filter("classes", lambda c: (c["label"] == F.col("label")) & (c["vector"] == F.col("vector")))[0]
    full = met.select("vec_id", mine.alias("c")).select("vec_id", "c.n_links", "c.component_id")
    alone = marked.filter("h is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    full = full.select("vec_id", "n_links", "component_id").unionByName(alone)
    return full.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
