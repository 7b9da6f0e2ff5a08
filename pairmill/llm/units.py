"""Byte-level BPE over units: the part of encoding that all byte-level tokenizers share.

Their pre-token pattern never spans a change from a non-space to a white-space character,
and its one lookahead looks at the character after a run of white space. So a text's
encoding is the concatenation of the encodings of its units, a unit being a run of white
space with the run of other characters after it, cut again where an ASCII letter or digit
is followed by an ASCII sign (no pre-token goes on from a letter or digit to a sign). Units
repeat, so a batch's texts are cut with array operations on their bytes, made a dictionary,
and only the distinct units are looked at one by one: a worker keeps the ids of those it has
seen, in a table of bounded size that forgets the rarest first; the others are encoded by the
tokenizer library itself, many in one call: units that open with white space are joined, and
their ids are told apart by the bytes that each id stands for. No cut is made behind white
space outside ASCII, where the libraries' classes may differ from ours.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE, _IS_PLAIN, _IS_SIGN = (np.array([f(chr(c)) for c in range(256)]) for f in (lambda c: c in _SPACES.decode(), lambda c: c.isascii() and c.isalnum(), lambda c: "!" <= c <= "~" and not c.isalnum()))
# White space outside ASCII, and the controls that some classes count as such,
# as a class of characters and as the bytes of each.
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_ODD_BYTES = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")


#: Bytes of text worked on at once, and units of one text.
AT_ONCE, UNITS_AT_ONCE = 4_000_000, 1_000_000


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about AT_ONCE bytes of text each (or one longer text)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield batch.slice(i, j - i)


#: Rows of whole texts that Spark hands to a Python worker at once: by default it is 10,000,
#: which for long texts is a hundred megabytes and more in the executor and in the worker.
BATCH_ROWS = 1_000


def bounded_batches(docs: DataFrame) -> DataFrame:
    """`docs`, after its session's Arrow batches were limited to BATCH_ROWS rows. The limit
    is a session setting, so it holds when the plan runs later; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


def packed(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie side by side in `data`, each from an edge to the next."""
    kind, offset = (pa.binary(), np.int32) if edges[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges.astype(offset)), pa.py_buffer(np.ascontiguousarray(data))])


class UnitEncoder:
    """Ids of texts as flat arrays of unsigned 32-bit integers.

    encode_many: ids of each of a list of texts, by the tokenizer library.
    id_bytes: how many bytes of text each id stands for.
    whole: whether texts go to the library uncut, for a pattern that doesn't fit units.
    intact: strings that are one token each; texts that hold one are cut at white space only.
    """

    #: Most units kept, the longest (bytes) that are, and the units joined for one encoding.
    KEEP, KEEP_BYTES, JOIN = 400_000, 48, 500

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], id_bytes: np.ndarray, whole: bool = False, intact: tuple[str, ...] = ()):
        self._encode_many, self._id_bytes, self._whole, self._intact = encode_many, id_bytes, whole, intact
        self._clear()

    def _clear(self) -> None:
        self._place: dict[bytes, int] = {}
        self._ids, self._start, self._n = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0
        self._hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the units met most often, at most half a table."""
        at = np.fromiter(self._place.values(), np.int64, len(self._place))
        hits = self._hits[at]
        stay = hits > np.partition(hits, len(hits) // 2)[len(hits) // 2]
        units = [u for u, s in zip(self._place, stay.tolist()) if s]
        ids, sizes = self._gather(at[stay])
        self._clear()
        self._append(ids, sizes)
        self._hits = hits[stay] // 2
        self._place = dict(zip(units, range(len(units))))

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Units' ids, side by side, behind those that are there."""
        at = int(self._start[self._n])
        if at + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids[:at], np.empty(at + 2 * len(ids), np.uint32)])
        if self._n + len(sizes) + 1 > len(self._start):
            self._start = np.concatenate([self._start[: self._n + 1], np.empty(self._n + 2 * len(sizes) + 1, np.int64)])
        self._ids[at : at + len(ids)] = ids
        self._start[self._n + 1 : self._n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self._n += len(sizes)

    def _learn(self, units: list[bytes]) -> list[bytes]:
        """Appends the ids of units; gives the units in the order they were appended in."""
        joins = [u for u in units if u[0] in _SPACES and u[-1] not in _SPACES] if not self._whole else []
        alone = [u for u in units if u[0] not in _SPACES or u[-1] in _SPACES] if not self._whole else list(units)
        done: list[bytes] = []
        groups = [joins[i : i + self.JOIN] for i in range(0, len(joins), self.JOIN)]
        for group, ids in zip(groups, self._encode_many([b"".join(g).decode("utf-8", "replace") for g in groups])):
            flat = np.asarray(ids, dtype=np.uint32)
            reach = np.cumsum(self._id_bytes[flat])
            ends = np.cumsum([len(u) for u in group])
            at = np.searchsorted(reach, ends)
            if len(reach) and reach[-1] == ends[-1] and (reach[at] == ends).all():
                self._append(flat, np.diff(at, prepend=-1))
                done += group
            else:
                alone += group
        for i in range(0, len(alone), 20_000):
            some = self._encode_many([u.decode("utf-8", "replace") for u in alone[i : i + 20_000]])
            sizes = np.array([len(x) for x in some], dtype=np.int64)
            self._append(np.concatenate([np.asarray(x, dtype=np.uint32) for x in some]), sizes)
        return done + alone

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sizes = self._start[at], self._start[at + 1] - self._start[at]
        before = np.cumsum(sizes) - sizes
        return self._ids[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def _of_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and how many each has."""
        coded = units.dictionary_encode()
        edges = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist()
        flat = coded.dictionary.buffers()[2].to_pybytes()
        known = [flat[i:j] for i, j in zip(edges, edges[1:])]
        if len(self._place) > self.KEEP:
            self._forget()
        find = self._place.get
        at = np.array([find(u, -1) for u in known], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        fresh = {known[i]: i for i in new.tolist()}
        kept = self._learn([u for u in fresh if len(u) <= self.KEEP_BYTES])
        self._place.update(zip(kept, range(self._n - len(kept), self._n)))
        mark = self._n
        once = self._learn([u for u in fresh if len(u) > self.KEEP_BYTES])
        at[[fresh[u] for u in kept + once]] = np.arange(self._n - len(kept) - len(once), self._n)
        which = coded.indices.to_numpy(zero_copy_only=False)
        if self._n > len(self._hits):
            self._hits = np.concatenate([self._hits, np.zeros(self._n, np.int64)])
        self._hits[at] += np.bincount(which, minlength=len(known))
        found = self._gather(at[which])
        self._hits[mark : self._n] = 0
        self._n = mark  # long units aren't kept
        return found

    def _cuts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, where units begin in them (and the end), and how many units each text has."""
        raw = texts.cast(pa.large_binary())
        edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        begins = np.zeros(len(data), dtype=bool)
        if not self._whole and len(data):
            space = _IS_SPACE[data]
            after = space[1:] & ~space[:-1]
            begins[1:] = after | (_IS_SIGN[data[1:]] & _IS_PLAIN[data[:-1]])
            for token in self._intact:
                for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)):
                    begins[edges[i] + 1 : edges[i + 1]] = after[edges[i] : edges[i + 1] - 1]
            for i in np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)):
                at = int(edges[i])
                for m in _ODD_BYTES.finditer(data[at : edges[i + 1]].tobytes()):
                    if at + m.end() < len(data):
                        begins[at + m.end()] = False
        begins[edges[:-1][np.diff(edges) > 0]] = True
        cuts = np.flatnonzero(begins)
        return data, np.append(cuts, len(data)), np.diff(np.searchsorted(cuts, edges))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), side by side, and how many each text has."""
        texts = pc.fill_null(texts, "")
        data, cuts, units = self._cuts(texts)
        parts, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(cuts) - 1, UNITS_AT_ONCE):
            own = cuts[i : i + UNITS_AT_ONCE + 1]
            ids, n = self._of_units(packed(own - own[0], data[own[0] : own[-1]]))
            parts.append(ids)
            sizes.append(n)
        reach = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        ends = np.concatenate([[0], np.cumsum(units)])
        return np.concatenate(parts), np.diff(reach[ends])
