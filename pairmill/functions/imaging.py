"""Pixel fingerprints of image files; undecodable files give null keys, which never match.

Spark's image source reads and decodes the files (whatever the JVM's image readers take: PNG,
JPEG, GIF, BMP, of any depth and palette); alpha is dropped and grey is three equal channels.
The pixel digest is made of built-in functions over the decoded bytes. The gradient hash shrinks
by the windowed sinc that image libraries use for it, in their whole numbers, as two products of
matrices an image, in Arrow batches: a dot product per output cell is no work for nested lambdas.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, channels, data) of the files in a folder; `data` has rows of blue,
    green, red (and alpha) or grey bytes, and is null where the file is no image."""
    image = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    good = F.col("height") > 0
    keep = lambda c: F.when(good, F.col(c))
    name = F.element_at(F.split("origin", "/"), -1)
    return image.select(name.alias("name"), keep("height").alias("height"), keep("width").alias("width"), keep("nChannels").alias("channels"), keep("data").alias("data"))


def pixel_md5(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """md5 of the shape `(height, width, 3)` as text and the bytes red, green, blue."""
    digits = F.hex(data)
    rgb = (
        F.when(channels == 1, F.regexp_replace(digits, "(..)", "$1$1$1"))
        .when(channels == 3, F.regexp_replace(digits, "(..)(..)(..)", "$3$2$1"))
        .when(channels == 4, F.regexp_replace(digits, "(..)(..)(..)..", "$3$2$1"))
    )
    return F.md5(F.concat(F.format_string("(%d, %d, 3)", height, width).cast("binary"), F.unhex(rgb)))


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of an image as the image source gives it."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, 2::-1]


#: Bits of the weights' fraction, and the reach of the window, in the common resampler of 8-bit images.
_FRACTION, _REACH = 22, 3.0


def _resample(size: int, out: int) -> np.ndarray:
    """Weights (out, size) of a windowed sinc that widens when it shrinks, as whole numbers."""
    scale = size / out
    wide = max(scale, 1.0)
    weights = np.zeros((out, size))
    for i in range(out):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - _REACH * wide + 0.5)), min(size, int(centre + _REACH * wide + 0.5))
        x = (np.arange(lo, hi) - centre + 0.5) / wide
        w = np.where(np.abs(x) < _REACH, np.sinc(x) * np.sinc(x / _REACH), 0.0)
        weights[i, lo:hi] = w / w.sum()
    return np.trunc(weights * (1 << _FRACTION) + np.copysign(0.5, weights)).astype(np.int64)


def _shrink(grey: np.ndarray, out: int) -> np.ndarray:
    """Columns resampled to `out`, rounded to 8 bits."""
    if grey.shape[1] == out:
        return grey
    return np.clip((grey @ _resample(grey.shape[1], out).T + (1 << (_FRACTION - 1))) >> _FRACTION, 0, 255)


def gradient_hash(px: np.ndarray, side: int = 16) -> str:
    """Bits of whether brightness rises from one cell to the next, as hex, after the image
    was made grey and shrunk to (side, side + 1), first across, then down."""
    grey = (px.astype(np.int64) @ np.array([19595, 38470, 7471]) + (1 << 15)) >> 16
    cells = _shrink(_shrink(grey, side + 1).T, side).T
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def encode_png(px: np.ndarray) -> bytes:
    """A PNG of 8-bit RGB pixels (height, width, 3)."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((px.shape[0], 1), np.uint8), px.reshape(px.shape[0], -1)], axis=1)
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*[b.column(c).to_pylist() for c in ("height", "width", "channels", "data")])
        found = [None if r[3] is None else gradient_hash(pixels(*r)) for r in rows]
        own = [i for i, n in enumerate(b.schema.names) if n != "data"]
        yield pa.record_batch([*[b.column(i) for i in own], pa.array(found, pa.string())], names=[*[b.schema.names[i] for i in own], "dhash"])


def fingerprints(images: DataFrame) -> DataFrame:
    """(name, height, width, channels, px_md5, dhash) of `read_images`; one bad file doesn't stop
    the others."""
    key = pixel_md5(*[F.col(c) for c in ("height", "width", "channels", "data")])
    return images.select("name", "height", "width", "channels", key.alias("px_md5"), "data").mapInArrow(_hashes, "name string, height int, width int, channels int, px_md5 string, dhash string")


def decoded(raw):
    """Bytes of a base64 column, null where it isn't base64."""
    return F.try_to_binary(raw, F.lit("base64"))
