"""Words, word hashes and word windows of whole texts, in numpy over many texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D. Texts are handled in
slabs of a few megabytes, so a task's memory follows the longest single text, not
its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLAB_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(65535, _BASE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def text_digest(text_col: str) -> list[Column]:
    """Two hashes of a text, h and g; null counts as empty."""
    text = F.coalesce(text_col, F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit("second")).alias("g")]


def slabs(texts: list[bytes], limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` bytes together (or one text)."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of several texts: ``starts``/``ends`` in ``data``, and for each text
    the range ``bounds[k]:bounds[k + 1]`` of its words."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        space = np.concatenate([[True], _SPACE[raw]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(self.data, np.uint8)
        place = np.arange(len(raw), dtype=np.int64)
        place -= np.repeat(self.starts, np.diff(np.append(self.starts, len(raw)))) \
            if self.starts[0] == 0 else np.concatenate(
                [np.zeros(self.starts[0], np.int64),
                 np.repeat(self.starts, np.diff(np.append(self.starts, len(raw))))])
        values = _BYTE[raw] * _POWERS[place & 65535]
        if len(raw) > 65535:
            values *= ((place >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        sums = np.add.reduceat(values, self.starts)
        return mix(sums + (self.ends - self.starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes (doubling, order kept)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, at, size, power, left = np.zeros(n, np.uint64), 0, 1, hashes, width
    while left:
        if left & 1:
            total = mix(total * _BASE + power[at:at + n])
            at += size
        left >>= 1
        if left:
            power = mix(power[:-size] * _BASE + power[size:])
            size *= 2
    return total
