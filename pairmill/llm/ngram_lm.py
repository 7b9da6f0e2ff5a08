"""Interpolated modified Kneser-Ney language model, counted in Spark.

Order 2. Tasks hash the words of their texts and pre-sum their bigrams, packed by context;
one shuffle by a slice of the context's hash brings equal bigrams together, one shard a task;
tasks sum them and write, per shard, sorted arrays of bigram hashes with counts and of context
hashes with their totals and numbers of followers seen once, twice and more often. Contexts
with very many followers (the begin of a text, common words) are spread over all shards by
context and word instead; which ones is read from a sample of the texts and changes no
count, and their totals, at most WIDE rows, are added up and travel with the model. The same
job passes each word's count and number of distinct predecessors on, shuffles those by word
and writes unigram arrays alike. Only these totals and counts of counts come to the driver. Scoring workers memory-map the arrays in the shared folder and look up a batch's
distinct bigrams by binary search, in sorted order, so neighbours share pages and all
workers of a machine share one page cache. A store that can't be mapped is copied to a
local file that is unlinked as soon as it is mapped.

    p(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / c(u) * q(w)
    q(w) = max(N(.w) - D'(N(.w)), 0) / N(..) + (D'1 n1 + D'2 n2 + D'3 n3+) / N(..) / (V + 1)

with D from counts of counts at each level; an unseen context leaves q(w). Words are 64-bit
hashes and bigrams a 64-bit mix of two: of n distinct bigrams, a share of about n / 2^64 has
another's counts added to its own (1e-8 for 2e11 bigrams); nothing checks for that.

Defined cases. Null, empty and blank texts: the end token alone. No training text: every
probability 1, all counts 0. Repeated rows count and are scored each. A null id is neither
held out nor learned from. No rows: no rows. Very long texts are counted and scored whole.
Other columns, whatever their names, aren't looked at. Tasks that run again write the same bytes and rename them into
place, so lost executors leave whole files.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.units import bounded_batches
from pairmill.session import scratch

BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n begin", 7))
END = np.uint64(xxhash.xxh64_intdigest(b"\n end", 7))
#: Characters of text worked on at once, and bigrams summed before they are sent.
AT_ONCE, PRE_SUM = 2_000_000, 3_000_000
MIN_SHARDS = 8
#: Most contexts that are spread, the followers in a part of the sample that make one, and the sample: one text in so many.
WIDE, WIDE_FOLLOWERS, SAMPLE = 1_000, 2_000, 16
#: Contexts sent to the JVM at once.
SEND_ROWS = 20_000


def folds(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 10; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10


class _Tokens:
    """Tokens of a batch of texts: `words` are hashes of the distinct words, then END, then
    BEGIN; `ids` and `prev` index them; `starts` is where each text's tokens begin."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        end = len(words)
        self.words = np.array([xxhash.xxh64_intdigest(w, 7) for w in words] + [int(END), int(BEGIN)], dtype=np.uint64)
        index = coded.indices.to_numpy(zero_copy_only=False)
        real = np.ones(len(index), dtype=bool) if "" not in words else index != words.index("")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        per_text = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]])
        last = np.cumsum(per_text + 1) - 1
        self.ids = np.empty(int(per_text.sum()) + len(per_text), dtype=np.int64)
        inner = np.ones(len(self.ids), dtype=bool)
        inner[last] = False
        self.ids[inner] = index[real]
        self.ids[last] = end
        self.starts = last - per_text
        self.prev = np.empty_like(self.ids)
        self.prev[1:] = self.ids[:-1]
        self.prev[self.starts] = end + 1
        self.sizes = per_text + 1


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(sizes) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def _mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = u * np.uint64(0x9E3779B97F4A7C15) + w
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _by(u: np.ndarray, w: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The hashes that name bigrams' shards."""
    return np.where(np.isin(u, wide), _mix(u, w), u) if len(wide) else u


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary cells, one for each run of `values` that begins at `first`."""
    edges = np.concatenate([first, [len(values)]]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bigrams(bits: int, wide: np.ndarray):
    """(shard, u, ws, cs): per context (and shard) the words that follow it and how often, as
    packed arrays, from a partition's texts in parts of PRE_SUM tokens."""

    def summed(us: list, ws: list) -> Iterator[pa.RecordBatch]:
        u, w = np.concatenate(us), np.concatenate(ws)
        # by the upper halves of both hashes: equal bigrams lie side by side, contexts too
        order = np.argsort((u & np.uint64(0xFFFFFFFF00000000)) | (w >> np.uint64(32)))
        u, w = u[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        c = np.diff(np.concatenate([first, [len(u)]])).astype(np.uint32)
        u, w = u[first], w[first]
        shard = _shard(_by(u, w, wide), bits)
        if len(wide):
            order = np.lexsort((shard, u))
            u, w, c, shard = u[order], w[order], c[order], shard[order]
        runs = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (shard[1:] != shard[:-1])]))
        whole = pa.record_batch({"shard": shard[runs], "u": u[runs].view(np.int64), "ws": _packed(w, runs), "cs": _packed(c, runs)})
        for i in range(0, len(runs), SEND_ROWS):
            yield whole.slice(i, SEND_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, ws, n = [], [], 0
        for b in batches:
            for part in _slices(b, 0):
                t = _Tokens(part.column(0))
                us.append(t.words[t.prev])
                ws.append(t.words[t.ids])
                n += len(t.ids)
                if n >= PRE_SUM:
                    yield from summed(us, ws)
                    us, ws, n = [], [], 0
        if n:
            yield from summed(us, ws)

    return run


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, n): contexts of a batch's texts with WIDE_FOLLOWERS followers, and BEGIN."""
    for b in batches:
        for part in _slices(b, 0):
            t = _Tokens(part.column(0))
            pairs = np.unique(t.prev * len(t.words) + t.ids)
            n = np.bincount(pairs // len(t.words), minlength=len(t.words))
            n[-1] = max(n[-1], WIDE_FOLLOWERS)
            many = np.flatnonzero(n >= WIDE_FOLLOWERS)
            yield pa.record_batch({"u": t.words[many].view(np.int64), "n": n[many].astype(np.int64)})


def _write(base: str, name: str, **arrays: np.ndarray) -> None:
    store, path = fs.FileSystem.from_uri(base)
    for part, values in arrays.items():
        if not len(values):  # an empty file can't be mapped; an absent one is an empty array
            continue
        at = f"{path}/{name}.{part}"
        with store.open_output_stream(tmp := f"{at}.{uuid.uuid4().hex}") as f:
            f.write(np.ascontiguousarray(values).tobytes())
        store.move(tmp, at)


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _least_type(values: np.ndarray) -> np.ndarray:
    """Counts in 4 bytes each where all fit, else in 8."""
    return values.astype(np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one shard after the other; the first column names it, in order."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        shard = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for i, j in zip(edges, edges[1:]):
            if j > i and shard[i] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], int(shard[i])
            if j > i:
                held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _unpacked(cells: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for c in cells.chunks for x in c])


def _write_bigrams(base: str, wide: np.ndarray):
    """Sums and writes one shard at a time. Gives (kind, w, c, n): kind 0 is a word's count
    and distinct predecessors in a shard, kinds 1 to 4 the number of bigrams seen so often,
    kinds 5 to 8 a wide context's total and numbers of followers in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_shard(batches):
            w = _unpacked(rows.column("ws"), np.uint64)
            c = _unpacked(rows.column("cs"), np.uint32)
            sizes = pc.binary_length(rows.column("ws")).to_numpy() // 8
            u = np.repeat(rows.column("u").to_numpy().view(np.uint64), sizes)
            keys = _mix(u, w)
            order = np.argsort(keys)
            first = _runs(keys[order])
            mc = np.add.reduceat(c[order].astype(np.int64), first)
            mine = order[first]
            mu, mw = u[mine], w[mine]
            _write(base, f"bigram-{s}", keys=keys[mine], counts=_least_type(mc))
            del u, w, c, keys, order, mine
            order = np.argsort(mu, kind="stable")
            first = _runs(mu[order])
            oc = mc[order]
            seen = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (oc, oc == 1, oc == 2, oc >= 3)], axis=1)
            of = mu[order][first]
            part = np.isin(of, wide)
            _write(base, f"context-{s}", keys=of[~part], counts=_least_type(seen[~part]))
            for k in range(4):
                yield pa.record_batch({"kind": np.full(int(part.sum()), 5 + k, np.int32), "w": of[part].view(np.int64), "c": np.zeros(int(part.sum()), np.int64), "n": seen[part, k]})
            order = np.argsort(mw, kind="stable")
            first = _runs(mw[order])
            n = np.diff(np.concatenate([first, [len(mw)]])).astype(np.int64)
            found = pa.record_batch({"kind": np.zeros(len(first), np.int32), "w": mw[order][first].view(np.int64), "c": np.add.reduceat(mc[order], first), "n": n})
            for i in range(0, len(first), SEND_ROWS):
                yield found.slice(i, SEND_ROWS)
            yield pa.record_batch({"kind": np.arange(1, 5, dtype=np.int32), "w": np.zeros(4, np.int64), "c": np.zeros(4, np.int64), "n": np.array([(mc == k).sum() for k in (1, 2, 3, 4)], dtype=np.int64)})

    return run


def _write_words(base: str, bits: int):
    """Writes the unigram shards of a partition and gives totals as (name, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_shard(batches):
            kind, w, c, n = (rows.column(k).to_numpy() for k in ("kind", "w", "c", "n"))
            totals: dict[str, int] = {f"bigrams_{k}": int(n[kind == k].sum()) for k in (1, 2, 3, 4)}
            word = kind == 0
            all_w, all_n = w, n
            w, c, n = w[word].view(np.uint64), c[word], n[word]
            if len(w):
                order = np.argsort(w)
                _write(base, f"word-{s}", keys=w[order], counts=_least_type(np.stack([c[order], n[order]], axis=1)))
            totals |= {"tokens": int(c.sum()), "types": len(w), "bigrams": int(n.sum())} | {f"words_{k}": int((n == k).sum()) for k in (1, 2, 3, 4)}
            for k in range(4):
                of_kind = kind == 5 + k
                totals |= {f"wide {k} {u}": v for u, v in zip(all_w[of_kind].tolist(), all_n[of_kind].tolist())}
            yield pa.record_batch({"name": list(totals), "n": pa.array(totals.values(), pa.int64())})

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more from counts of counts (Chen and Goodman)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))])


class KneserNey:
    """The model's files and totals; a worker maps each file once."""

    _open: dict[str, tuple] = {}
    WIDTH = {"bigram": 1, "context": 4, "word": 2}

    def __init__(self, base: str, bits: int, totals: dict[str, int]):
        self.base, self.bits = base, bits
        of_wide = {int(u) for _, _, u in (k.split() for k in totals if k.startswith("wide "))}
        self.wide = np.sort(np.array(sorted(of_wide), dtype=np.int64).view(np.uint64))
        self.wide_counts = np.array([[totals.get(f"wide {k} {u}", 0) for k in range(4)] for u in self.wide.view(np.int64).tolist()], dtype=np.int64).reshape(-1, 4)
        self.totals = {k: totals.get(k, 0) for k in ("tokens", "types", "bigrams", *(f"{x}_{k}" for x in ("words", "bigrams") for k in (1, 2, 3, 4)))}

    def _map(self, name: str, dtype) -> np.ndarray:
        store, path = fs.FileSystem.from_uri(f"{self.base}/{name}")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return np.empty(0, dtype)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, dtype, "r")
        handle, local = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as f:
            while chunk := f.read(8 << 20):
                out.write(chunk)
        mapped = np.memmap(local, dtype, "r")
        os.unlink(local)
        return mapped

    def _arrays(self, kind: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if (key := f"{self.base}/{kind}-{shard}") not in self._open:
            if self._open and not next(iter(self._open)).startswith(f"{self.base}/"):
                self._open.clear()
            keys, counts = self._map(f"{kind}-{shard}.keys", np.uint64), self._map(f"{kind}-{shard}.counts", np.uint32)
            width = self.WIDTH[kind]
            if len(counts) > len(keys) * width:
                counts = counts.view(np.uint64)
            self._open[key] = (keys, counts.reshape(-1, width))
        return self._open[key]

    def look_up(self, kind: str, by: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct keys (0 where absent); `by` is the hash that names the shard."""
        out = np.zeros((len(keys), self.WIDTH[kind]), dtype=np.int64)
        shard = _shard(by, self.bits)
        order = np.lexsort((keys, shard))
        edges = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            mine = order[edges[s] : edges[s + 1]]
            have, counts = self._arrays(kind, int(s))
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
                out[mine] = np.where((have[at] == keys[mine])[:, None], counts[at], 0)
        return out

    def contexts(self, u: np.ndarray) -> np.ndarray:
        """Totals and numbers of followers of distinct contexts."""
        out = self.look_up("context", u, u)
        if len(self.wide):
            at = np.minimum(np.searchsorted(self.wide, u), len(self.wide) - 1)
            mine = self.wide[at] == u
            out[mine] = self.wide_counts[at[mine]]
        return out

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score, the log10 probability."""
        t, k = _Tokens(texts), self.totals
        words = self.look_up("word", t.words[:-1], t.words[:-1])
        contexts = self.contexts(t.words)
        pair = t.prev * len(t.words) + t.ids
        distinct, back = np.unique(pair, return_inverse=True)
        u, w = t.words[distinct // len(t.words)], t.words[distinct % len(t.words)]
        pairs = self.look_up("bigram", _by(u, w, self.wide), _mix(u, w))[:, 0]
        base = np.log10((words[:, 0] + 0.1) / (k["tokens"] + 0.1 * (k["types"] + 1)))
        one = _discounts(*(k[f"words_{i}"] for i in (1, 2, 3, 4)))
        two = _discounts(*(k[f"bigrams_{i}"] for i in (1, 2, 3, 4)))
        q = np.full(len(t.words), 1.0 / (k["types"] + 1))
        if k["bigrams"]:
            more = k["types"] - k["words_1"] - k["words_2"]
            left = (one[1] * k["words_1"] + one[2] * k["words_2"] + one[3] * more) / k["bigrams"]
            n = words[:, 1]
            q[:-1] = np.maximum(n - one[np.minimum(n, 3)], 0) / k["bigrams"] + left / (k["types"] + 1)
        c = contexts[:, 0]
        back_off = np.where(c > 0, (contexts[:, 1:] @ two[1:]) / np.maximum(c, 1), 1.0)
        du, dw = distinct // len(t.words), distinct % len(t.words)
        p = np.maximum(pairs - two[np.minimum(pairs, 3)], 0) / np.maximum(c[du], 1) + back_off[du] * q[dw]
        add = lambda x: np.add.reduceat(x, t.starts) if len(t.starts) else x[:0]
        known = (words[:, 0] > 0).astype(np.int64)
        return {"n_tokens": t.sizes, "n_known": add(known[t.ids]), "base_score": add(base[t.ids]), "score": add(np.log10(p)[back])}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> KneserNey:
    """Count the documents outside fold 0 and write the model's arrays below `path`
    (a fresh place in the shared folder by default)."""
    base = path or scratch(docs.sparkSession, "ngram-lm")
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    elif base.startswith("file:/") and not base.startswith("file:///"):
        base = "file:///" + base[len("file:") :].lstrip("/")
    store, at = fs.FileSystem.from_uri(base)
    store.create_dir(at, recursive=True)
    # shards grow with the input's file splits, so a shard stays a few million bigrams
    bits = (max(MIN_SHARDS, 2 * docs.rdd.getNumPartitions()) - 1).bit_length()
    texts = bounded_batches(docs).filter(folds(F.col(id_col)) != 0).select(F.col(text_col).alias("text"))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_wide, "u long, n long")
    found = some.groupBy("u").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "u").limit(WIDE).collect()
    wide = np.sort(np.array([r["u"] for r in found], dtype=np.int64).view(np.uint64))
    counts = texts.mapInArrow(_bigrams(bits, wide), "shard int, u long, ws binary, cs binary").repartitionById(1 << bits, "shard").sortWithinPartitions("shard")
    words = counts.mapInArrow(_write_bigrams(base, wide), "kind int, w long, c long, n long")
    whole = words.groupBy("kind", "w").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    slices = whole.select(F.shiftrightunsigned("w", 64 - bits).cast("int").alias("shard"), "kind", "w", "c", "n").repartitionById(1 << bits, "shard").sortWithinPartitions("shard")
    receipts = slices.mapInArrow(_write_words(base, bits), "name string, n long")
    totals = {r["name"]: r["n"] for r in receipts.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    return KneserNey(base, bits, totals)


def _score(model: KneserNey):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 2):
                s = model.score(part.column(2))
                yield pa.record_batch(
                    {"doc_id": part.column(0), "held_out": part.column(1), "n_tokens": s["n_tokens"], "n_known": s["n_known"]}
                    | {"train_tokens": np.full(part.num_rows, model.totals["tokens"]), "base_score": s["base_score"], "score": s["score"]}
                )

    return run


def score_documents(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per
    input row; perplexity is 10 ** (-score / n_tokens)."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(folds(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_score(model), out)
