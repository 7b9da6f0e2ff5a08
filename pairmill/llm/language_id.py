"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text accepts exactly the substrings of that
text. A document is parsed against each: from a place, the longest match is one phrase,
the next phrase starts after it. Phrases times log2 of the labelled length estimate the
bits the document needs in that language; the language needing fewest bits a character wins.

Learning takes a bounded sample: per language the ROWS_PER_LANG labelled rows that come
first in a hash order, and of each a passage of CHARS_PER_ROW characters at a place given by
its hash. The automata (at most 2 states a character) are built on the driver from that
sample and sent as transition lists; a worker turns them into one table per process.
Documents are parsed whole. Pieces of PIECE symbols are parsed side by side, each from its
own start, with one table lookup a symbol; then the phrase that a piece leaves open is
followed into the next one until both parses begin a phrase at the same place, from where
they agree. So the pieces have no effect on the phrases.

The commonest letters of the samples have symbols of their own, all others share SHARED
symbols by code point, so a script with many letters keeps most of its order.

Defined cases. Null text, or text without a letter: `und`, score 0. Ties: the language
that is first by code point. No labelled rows: all `und`. Repeated rows: same result each.
No rows: no rows. Very long texts: parsed whole, a bounded number of pieces at a time. Rows
with a null label or id: an id that is null is never used for learning. Other columns,
whatever their names, pass through `keep_identified` and aren't looked at elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.units import bounded_batches

ROWS_PER_LANG, CHARS_PER_ROW = 48, 600
#: Symbols, and those of them that rarer letters share.
ALPHABET, SHARED = 250, 60
PIECE = 256
#: Pieces parsed in step; characters of short texts classified together.
IN_STEP, AT_ONCE = 16_384, 1_500_000
UND = "und"
_SPACE, _PAD = 0, 1


def folds(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def suffix_automaton(text: np.ndarray) -> list[tuple[int, int, int]]:
    """Transitions (state, symbol, state) of the automaton of all substrings; state 0 is the start."""
    length, link, step = [0], [-1], [{}]
    last = 0
    for c in text.tolist():
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        cur, p = len(length) - 1, last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                clone = len(length) - 1
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return [(s, c, t) for s, d in enumerate(step) for c, t in d.items()]


class CrossParser:
    """Suffix automata of several languages over one alphabet."""

    _tables: dict[int, tuple] = {}

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(k for k, v in samples.items() if any(map(_has_letter, v)))
        self.texts = texts = [" ".join(samples[k]) for k in self.langs]
        seen: dict[str, int] = {}
        for ch in "".join(texts).lower():
            if ch.isalpha():
                seen[ch] = seen.get(ch, 0) + 1
        letters = sorted(seen, key=lambda c: (-seen[c], c))[: ALPHABET - 2 - SHARED]
        self.symbols = {ch: i + 2 + SHARED for i, ch in enumerate(letters)}
        lut = self._lut()
        coded = [_fold(t, lut) for t in texts]
        self.bits = np.array([np.log2(max(2, len(c))) for c in coded])
        self.moves = [np.array(suffix_automaton(c), dtype=np.int32).reshape(-1, 3) for c in coded]
        self.key = hash((tuple(self.langs), tuple(texts)))

    def _lut(self) -> np.ndarray:
        """Symbol of each code point: a letter's own or a shared one, else space."""
        lut = np.full(0x110000, _SPACE, dtype=np.uint8)
        letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        lut[letters] = 2 + letters % SHARED
        for ch, s in self.symbols.items():
            lut[ord(ch)] = s
        return lut

    def _own(self) -> tuple:
        if self.key not in self._tables:
            width = len(self.symbols) + 2 + SHARED
            # state 0 of each language is its start, the last one accepts nothing (a symbol it doesn't know)
            starts, blocks, base = [], [], 0
            for m in self.moves:
                n = int(m[:, [0, 2]].max(initial=0)) + 2
                t = np.zeros((n, width), dtype=np.int32)
                t[m[:, 0], m[:, 1]] = m[:, 2] + base
                t[0, t[0] == 0] = base + n - 1
                t[:, _PAD] = np.arange(n) + base
                starts.append(base)
                blocks.append(t)
                base += n
            table = np.concatenate(blocks) if blocks else np.zeros((0, width), np.int32)
            self._tables.clear()
            self._tables[self.key] = (self._lut(), table.ravel(), np.array(starts, dtype=np.int32), width)
        return self._tables[self.key]

    def _step(self, state: np.ndarray, c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins at the symbols `c`."""
        _, table, _, width = self._own()
        to = table.take(state * width + c)
        # a missing move is 0: the start state of the first language is never moved to
        begins = (to == 0) & ((state != 0) | (c != _PAD))
        return np.where(begins, table.take(first + c), to), begins

    def phrases(self, pieces: np.ndarray, opens: np.ndarray, carry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each row of symbols (padded at the end), by language, and the
        states after the last row. `opens`: rows that begin a text; the others go on from the
        row before, row 0 from the states `carry`."""
        _, _, starts, width = self._own()
        n, langs = len(pieces), len(starts)
        first = starts[:, None] * width
        cols = np.ascontiguousarray(pieces.T).astype(np.int32)
        begin = np.zeros((len(cols), langs, n), dtype=bool)
        state = np.repeat(starts[:, None], n, axis=1)
        for k, c in enumerate(cols):
            if (c == _PAD).all():
                break
            state, begin[k] = self._step(state, c, first)
        begin[0] = pieces[:, 0] != _PAD
        alone, count = begin.sum(0), begin.sum(0)
        alone_end, end = state, state.copy()
        todo = np.flatnonzero(~opens)
        while len(todo):
            before = end[:, np.maximum(todo - 1, 0)]
            if todo[0] == 0:
                before[:, 0] = carry
            now, ends = self._follow(before, cols[:, todo], begin, todo, first, alone[:, todo], alone_end[:, todo])
            moved = todo[(ends != end[:, todo]).any(0)] + 1
            count[:, todo], end[:, todo] = now, ends
            todo = moved[moved < n]
            todo = todo[~opens[todo]]
        return count.T, end[:, -1]

    def _follow(self, state, cols, begin, at, first, alone, alone_end):
        """Phrases that begin in the rows `at` and the states at their ends, if the rows before
        them leave `state`: followed until a phrase begins where one of the row's own parse does."""
        count, end = alone.copy(), alone_end.copy()
        live, own, mine = np.ones_like(state, dtype=bool), np.zeros_like(count), np.zeros_like(count)
        rows = np.arange(len(at))
        for k in range(len(cols)):
            state, begins = self._step(state, cols[k, rows], first)
            there = begin[k][:, at[rows]]
            live &= ~(begins & there)
            mine += live & begins
            own += live & there
            if k % 8 == 7 or k == len(cols) - 1:
                going = live.any(0)
                last = k == len(cols) - 1
                done = rows if last else rows[~going]
                pick = slice(None) if last else ~going
                count[:, done] = np.where(live[:, pick], mine[:, pick], alone[:, done] - own[:, pick] + mine[:, pick])
                end[:, done] = np.where(live[:, pick], state[:, pick], alone_end[:, done])
                if last or not going.any():
                    break
                rows, state, live, own, mine = rows[going], state[:, going], live[:, going], own[:, going], mine[:, going]
        return count, end

    def count(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (its symbols) in each language."""
        sizes = np.array([-(-len(c) // PIECE) for c in coded])
        owner = np.repeat(np.arange(len(coded)), sizes)
        flat = np.full((int(sizes.sum()), PIECE), _PAD, dtype=np.uint8)
        at = 0
        for c, k in zip(coded, sizes.tolist()):
            flat[at : at + k].reshape(-1)[: len(c)] = c
            at += k
        total = np.zeros((len(coded), len(self.langs)))
        opens = np.diff(owner, prepend=-1) > 0
        carry = None
        for i in range(0, len(flat), IN_STEP):
            found, carry = self.phrases(flat[i : i + IN_STEP], opens[i : i + IN_STEP], carry)
            np.add.at(total, owner[i : i + IN_STEP], found)
        return total

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, in parts of about AT_ONCE characters; the score is
        the winner's lead over the second, as a share of the second's bits (1 where there is
        one language only)."""
        part = np.cumsum([len(t or "") for t in texts]) // AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        done = [self._classify(texts[i:j]) for i, j in zip(edges, edges[1:])]
        return [x for langs, _ in done for x in langs], np.concatenate([s for _, s in done])

    def _classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lut = self._own()[0]
        coded = [_fold((t or ""), lut) for t in texts]
        letter = np.array([bool((c > _PAD).any()) for c in coded])
        if not self.langs or not len(texts):
            return [UND] * len(texts), np.zeros(len(texts))
        need = self.count(coded) * self.bits
        best = need.argmin(axis=1)
        least = need[np.arange(len(texts)), best]
        if len(self.langs) > 1:
            second = np.partition(need, 1, axis=1)[:, 1]
            score = np.where(second > 0, 1 - least / np.where(second > 0, second, 1), 0.0)
        else:
            score = np.ones(len(texts))
        return [self.langs[b] if ok else UND for b, ok in zip(best, letter)], np.where(letter, np.clip(score, 0, 1), 0.0)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _fold(text: str, lut: np.ndarray) -> np.ndarray:
    """Symbols of a lower-cased text; a run of other characters is one space."""
    codes = lut[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if len(codes) > 1:
        codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
    return codes


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """From labelled rows outside fold 1, a bounded sample of each language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (folds(F.col("doc_id")) != 1) & F.col("text").rlike("\\p{L}"))
    h = F.xxhash64("doc_id", F.lit("language"))
    place = F.pmod(h, F.greatest(F.lit(1), F.length("text") - CHARS_PER_ROW + 1)).cast("int")
    passages = known.select("lang", h.alias("h"), F.substring(F.col("text"), place + 1, F.lit(CHARS_PER_ROW)).alias("passage"))
    first = Window.partitionBy("lang").orderBy("h", "passage")
    picked = passages.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= ROWS_PER_LANG)
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["k"])):
        samples.setdefault(r["lang"], []).append(r["passage"])
    return CrossParser(samples)


def _predict(model: CrossParser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            langs, scores = model.classify(texts)
            own = {f.name: b.column(i) for i, f in enumerate(b.schema) if i < b.num_columns - 1}
            yield pa.record_batch(own | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def identify(docs: DataFrame, model: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row."""
    held = F.coalesce(folds(F.col(id_col)) == 1, F.lit(False))
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: CrossParser, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is known, all columns kept; a missing label is filled in."""

    @F.pandas_udf(docs.select(F.lit("").alias("x")).schema["x"].dataType)
    def predicted(texts: pd.Series) -> pd.Series:
        return pd.Series(model.classify(list(texts))[0], dtype=object)

    # run once a row: a deterministic function would be worked out for the filter and again for the label
    predicted = predicted.asNondeterministic()
    named = bounded_batches(docs).withColumn("__lang_pred", predicted(F.col(text_col))).filter(F.col("__lang_pred") != UND)
    return named.withColumn(lang_col, F.coalesce(F.col(lang_col), "__lang_pred")).drop("__lang_pred")
