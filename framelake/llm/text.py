"""Vectorised reading of words from batches of whole texts.

A batch is an Arrow string column; its UTF-8 bytes are looked at once, in NumPy,
and every word becomes a 64-bit hash.  Words are runs of bytes that a lookup
table marks, so any class of ASCII separators works and bytes above 0x7F always
belong to words.  Nothing here keeps state between batches.

Null text reads as empty text: no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Bytes of text looked at together; one text longer than this is a slice alone.
SLICE_BYTES = 512 << 10
#: Bytes of an Arrow batch, where the session names no size of its own; a longer row is a batch alone.
BATCH_BYTES = 2 << 20
#: Rows that a Parquet scan decodes together: its buffers are sized by rows, and whole texts are long rows.
SCAN_ROWS = 512
_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS}

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory back, so that a reused worker does not keep what an earlier task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded(spark: SparkSession) -> None:
    """Bounds the session's batches for long rows, where the session names no sizes of its own."""
    for key, value in _SETTINGS.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(value))


def streamed(run: Callable[[Batches], Batches], schema) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: maps batches of bounded bytes, and gives memory back at the end of each task."""

    def lean(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    def apply(df: DataFrame) -> DataFrame:
        bounded(df.sparkSession)
        return df.mapInArrow(lean, schema)

    return apply


_BASE = 0x9E3779B97F4A7C15 | 3  # odd, and 3 modulo 4: powers never collapse
_M64 = (1 << 64) - 1


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE_VALUE = _table(20240521)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = _BASE & _M64 if which == "up" else pow(_BASE & _M64, -1, 1 << 64)
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        _powers[which] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bytes(separators: str) -> np.ndarray:
    """Marks for the 256 byte values: True inside a word.  ``separators`` are ASCII."""
    marks = np.ones(256, bool)
    marks[list(separators.encode("ascii"))] = False
    return marks


#: Words are what stands between white space.
SPACED = word_bytes(" \t\n\x0b\x0c\r")
#: Words are letters a-z (after lower-casing), digits and all non-ASCII characters.
ALNUM = np.array([b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges [start, end) of the data."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power("up", n), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of a slice of texts: text ``k`` owns words ``first[k]:first[k + 1]``."""

    data: np.ndarray  # the bytes of the texts, one after another
    bounds: np.ndarray  # n + 1 byte offsets of the texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, byte bounds) of pieces of the column, whole texts each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, hi, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, marks: np.ndarray = SPACED, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = marks[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), range_hashes(data, start, end))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive values; ``len(values) - n + 1`` of them."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = 1
    for j in range(n):
        out += values[j : j + m] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 & _M64
    return mix(out)


def grams_by_text(w: Words, n: int, whole_if_shorter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every run of ``n`` words inside one text.

    With ``whole_if_shorter`` a text of fewer words, but not none, gives its
    whole sequence as one run.
    """
    owner = w.owner
    count = np.diff(w.first)
    at = np.arange(len(w.hash))
    room = w.first[1:][owner] - at >= n if len(owner) else np.zeros(0, bool)
    at = at[room]
    hashes = grams(w.hash, n)[at] if len(at) else np.zeros(0, np.uint64)
    who = owner[at]
    if whole_if_shorter:
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            more = np.array([grams(w.hash[w.first[k] : w.first[k + 1]], int(count[k]))[0] for k in short], np.uint64)
            hashes = np.concatenate([hashes, mix(more + count[short].astype(np.uint64))])
            who = np.concatenate([who, short])
            at = np.concatenate([at, w.first[short]])
            order = np.argsort(who, kind="stable")
            hashes, who, at = hashes[order], who[order], at[order]
    return hashes, who, at
