"""Piece counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word; dynamic
programming over the word's characters carries the best score and the piece count that
goes with it, without keeping a path. Ties follow the tokenizer: for one end, pieces are
tried from the earliest start on, and only a strictly better score replaces what is
there. A character that starts no one-character piece may be an unknown piece, at the
least score less UNKNOWN_PENALTY; neighbouring unknown pieces count as one.

Words are runs of characters other than ASCII white space; each is prefixed by the space
mark and segmented by itself, so counts of distinct words are kept in a bounded table per
worker and a document's count is a sum over its words. One scan, no shuffle.

Defined cases. Null, empty and blank texts count 0. Repeated rows and null ids count each by
itself. No rows: no rows. Other columns, whatever their names, aren't looked at.
Words of any length are segmented whole. The vocabulary is a parameter: pieces in order of
frequency rank with scores -ln(rank + 1) where a file has no usable scores (Zipf's law; no
tokenizer is trained).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.units import bounded_batches

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words kept per worker, and the longest that are.
KEEP, KEEP_BYTES = 1_000_000, 64


class Unigram:
    """Pieces with scores; the automaton is built once in each worker process."""

    _built: dict[str, tuple] = {}

    def __init__(self, pieces: list[tuple[str, float]], unknown: float | None = None):
        self.pieces = pieces
        self.unknown = (min(s for _, s in pieces) if pieces else 0.0) - UNKNOWN_PENALTY if unknown is None else unknown
        self.key = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def _own(self):
        if self.key not in self._built:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for piece, score in self.pieces:
                if piece and piece not in auto:
                    auto.add_word(piece, (len(piece), score))
            auto.make_automaton()
            self._built.clear()
            self._built[self.key] = (auto, {})
        return self._built[self.key]

    def count_word(self, word: str) -> int:
        """Pieces of one word, space mark included in `word`."""
        auto = self._own()[0]
        n = len(word)
        worst = -math.inf
        best = [0.0] + [worst] * n
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        by_end: list[list] = [[] for _ in range(n + 1)]
        for end, found in auto.iter(word) if len(auto) else ():
            by_end[end + 1].append(found)  # for one end the automaton gives the longest piece first
        for end in range(1, n + 1):
            single = False
            for size, score in by_end[end]:
                start = end - size
                single |= size == 1
                if best[start] + score > best[end]:
                    best[end], count[end], unknown[end] = best[start] + score, count[start] + 1, False
            if not single and best[end - 1] + self.unknown > best[end]:
                best[end], unknown[end] = best[end - 1] + self.unknown, True
                count[end] = count[end - 1] + (not unknown[end - 1])
        return count[n]

    def count_words(self, words: list[str]) -> list[int]:
        kept = self._own()[1]
        if len(kept) > KEEP:
            kept.clear()
        out = []
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.count_word(SPACE_MARK + w)
                if len(w) <= KEEP_BYTES:
                    kept[w] = n
            out.append(n)
        return out


def public_unigram(name: str = "piece_bpe_32k.model") -> Unigram:
    """The pieces of a public vocabulary in rank order, scored by their rank."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    normal = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return Unigram([(p, -math.log(r + 2.0)) for r, p in enumerate(normal)])


def word_lists(texts: pa.Array) -> pa.ListArray:
    """ASCII words of each text; empty strings stand where a text starts or ends with space."""
    return pc.ascii_split_whitespace(pc.fill_null(texts, ""))


def _count(model: Unigram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            lists = word_lists(b.column(1))
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            per_word = np.array([n if w else 0 for w, n in zip(words, model.count_words(words))], dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(per_word[coded.indices.to_numpy(zero_copy_only=False)])]) if len(words) else np.zeros(1, np.int64)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": sums[ends[1:]] - sums[ends[:-1]]})

    return run


def token_counts(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), one row per input row."""
    plain = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_count(model), f"doc_id {dict(plain.dtypes)['doc_id']}, n_tokens long")
