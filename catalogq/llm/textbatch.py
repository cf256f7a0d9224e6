"""Words of a whole Arrow batch of texts as numpy arrays: spans, owners and 64-bit hashes.

A word is a run of bytes other than space and \\x09-\\x0D. Work buffers are taken for one
block of bytes at a time, so memory follows the batch, not the longest text in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 500  # texts handed to a Python worker at a time
BLOCK = 1 << 18  # bytes hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BYTES = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: keep the batches that go to Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base modulo 2^64, extended when a longer block asks for them."""

    def __init__(self, base: int):
        self.base, self.values = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            step = np.full(max(n, BLOCK + 1), self.base)
            step[0] = 1
            self.values = np.multiply.accumulate(step)
        return self.values[:n]


_POWERS = Powers(_BASE)
_INVERSE = Powers(pow(_BASE, -1, 1 << 64))


class Words(NamedTuple):
    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # the words of text i are first[i]:first[i + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def split_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None) -> Words:
    """Spans of all words; gap marks the bytes between words (white space if not given)."""
    gap = _SPACE[data] if gap is None else gap
    begins, stops = ~gap, ~gap
    begins[1:] &= gap[:-1]
    stops[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ~gap[inner]
    stops[inner - 1] = ~gap[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order of their starts and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        stop = ends[j - 1]
        n = int(stop - at)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[at:stop]] * _POWERS.upto(n), out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[b] - sums[a]) * _INVERSE.upto(n + 1)[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words, over the whole array; the caller drops runs that cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = words[:n] * factors[0]
    for k in range(1, size):
        total += words[k : k + n] * factors[k]
    return mix(total)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from all values in a row and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def over_texts(docs: DataFrame, function, schema: str) -> DataFrame:
    """Apply function(batch) -> batch to Arrow batches of a DataFrame, in tasks."""
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return docs.mapInArrow(apply, schema)


def spaced_words(words: Words, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends there; gap as given to split_words."""
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(int(lengths.sum()) + len(lengths), bool)
    inside[ends] = False
    out = np.full(len(inside), 32, np.uint8)
    out[inside] = words.data[~gap]
    return out, ends - lengths, ends


def byte_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow string column of ranges of bytes, which may overlap."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(int(offsets[-1]), dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at]))
