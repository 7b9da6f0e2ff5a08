"""The scorer boundary: prompts in, validated probabilities out, by key."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions import probability
from pairmill.sources import blobs


def score(rows: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], key: str, masked: bool) -> DataFrame:
    """(key, p): `scorer` gives a batch's logits (n, 4); the key passes through the task, so
    nothing relies on row positions. Class 0 gets probability 0 where masked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = np.asarray(scorer(f), dtype=np.float64).reshape(len(f), probability.CLASSES)
            if masked:
                z[:, 0] = -np.inf
            e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            yield pd.DataFrame({key: f[key], "p": list(e / e.sum(axis=1, keepdims=True)) if len(z) else []})

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, p array<double>")


#: Buckets of the linear model's words.
BUCKETS = 64
_MODELS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def save_linear(spark: SparkSession, first: np.ndarray, second: np.ndarray, path: str) -> None:
    """A linear model's weights (classes, BUCKETS) for the first and the second text, as a file in
    a folder of the shared store."""
    out = io.BytesIO()
    np.savez(out, first=first, second=second)
    blobs.put_files(spark.createDataFrame([("weights.npz", bytearray(out.getvalue()))], "name string, bytes binary"), path)


def _linear(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The model's state, read once in each worker process."""
    if path not in _MODELS:
        with blobs.opened(f"{path}/weights.npz") as f:
            state = np.load(io.BytesIO(f.read()))
        _MODELS.clear()
        _MODELS[path] = state["first"], state["second"]
    return _MODELS[path]


def word_means(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weights (texts, classes) of the words of each text; none where it has no words."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    words = pc.list_flatten(lists)
    size = pc.utf8_length(words).to_numpy()
    first = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
    codes = np.array([ord(c) if c else 0 for c in first.dictionary.to_pylist()], dtype=np.int64)
    bucket = (size * 7 + codes[first.indices.to_numpy()]) % BUCKETS if len(words) else np.zeros(0, np.int64)
    some = size > 0
    counts = np.zeros((len(texts), BUCKETS))
    np.add.at(counts, (row[some], bucket[some]), 1)
    return counts @ weights.T / np.maximum(counts.sum(1, keepdims=True), 1)


def score_linear(rows: DataFrame, path: str, key: str) -> DataFrame:
    """(key, p) of `rows` (key, a, b, masked): the mean of the probabilities of both orders of the
    texts; class 0 has probability 0 where masked. The key goes through the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _linear(path)
        for b in batches:
            x, y = b.column(1), b.column(2)
            total = 0
            for one, two in ((x, y), (y, x)):
                z = word_means(one, first) + word_means(two, second)
                z[b.column(3).to_numpy(zero_copy_only=False).astype(bool), 0] = -np.inf
                e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
                total = total + e / e.sum(axis=1, keepdims=True)
            yield pa.record_batch([b.column(0), pa.array(list(total / 2), pa.list_(pa.float64()))], names=[key, "p"])

    return rows.select(key, "a", "b", "masked").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, p array<double>")


def orientation_mean(original: DataFrame, reversed_: DataFrame, key: str) -> DataFrame:
    """(key, p): mean of both orientations' probabilities; the key sets must be equal."""
    both = original.select(key, F.col("p").alias("p1")).join(reversed_.select(key, F.col("p").alias("p2")), key, "full_outer")
    return both.select(key, F.when(F.col("p1").isNull() | F.col("p2").isNull(), F.raise_error(F.lit(f"{key}: an orientation is missing"))).otherwise(probability.mean(F.col("p1"), F.col("p2"))).alias("p"))


def assemble(template: DataFrame, tasks: list[DataFrame], key: str) -> DataFrame:
    """Template rows with one-hot columns of the argmax class; a row without scores is an error."""
    from pairmill.functions.text import LABELS

    scores = tasks[0].select(key, "p")
    for t in tasks[1:]:
        scores = scores.unionByName(t.select(key, "p"))
    hot = probability.one_hot(probability.argmax_class(F.col("p")))
    full = template.select(key).join(scores, key, "left").withColumn("p", F.coalesce("p", F.raise_error(F.lit(f"{key} without scores")).cast("array<double>")))
    return full.select(key, *[c.alias(n) for c, n in zip(hot, LABELS)])


def check_binding(task: str, checkpoint: str, expected: dict[str, str], labels: list[str], marker: str | None, markers: dict[str, str]) -> None:
    """ValueError unless `checkpoint` is the one expected for the task, with this package's
    order of labels and the task's own marker (none of another task where it has none). `markers`
    has the markers that checkpoints of the tasks carry."""
    from pairmill.functions.text import LABELS

    if task not in expected:
        raise ValueError(f"unknown task {task!r}")
    if checkpoint != expected[task]:
        raise ValueError(f"checkpoint {checkpoint!r} is not that of task {task!r}")
    if tuple(labels) != LABELS:
        raise ValueError("checkpoint with another order of labels")
    if (marker != markers[task]) if task in markers else (marker in markers.values()):
        raise ValueError(f"checkpoint with the marker of another task than {task!r}")
