"""Checksums and the deterministic generator of the test clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
_MASK = (1 << 64) - 1


def crc_table() -> np.ndarray:
    """The checksum's step for each byte value."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_CRC = crc_table().tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C of bytes."""
    c, t = 0xFFFFFFFF, _CRC
    for b in data:
        c = (c >> 8) ^ t[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def crc32c_many(data: list[bytes]) -> np.ndarray:
    """CRC-32C of each, one byte of all at a time: the longest decides the number of steps.  A few long ones go one by one."""
    size = np.array([len(x) for x in data], np.int64)
    if size.sum() < 16 * size.max(initial=0):
        return np.array([crc32c(x) for x in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(data), np.uint8)
    begin = (np.cumsum(size) - size)[order]
    sizes = size[order]
    table = np.array(_CRC, np.uint32)
    state = np.full(len(data), 0xFFFFFFFF, np.uint32)
    live = len(data)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        while live and sizes[live - 1] <= i:
            live -= 1
        s = state[:live]
        state[:live] = (s >> np.uint32(8)) ^ table[(s ^ flat[begin[:live] + i]) & np.uint32(255)]
    out = np.empty(len(data), np.int64)
    out[order] = (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


def crc32c_rows(data: np.ndarray) -> np.ndarray:
    """CRC-32C of every row of a matrix of bytes."""
    table = np.array(_CRC, np.uint32)
    state = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for i in range(data.shape[1]):
        state = (state >> np.uint32(8)) ^ table[(state ^ data[:, i]) & np.uint32(255)]
    return (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


@F.pandas_udf(LongType())
def crc32c_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC-32C of a binary column; null stays null."""
    for data in batches:
        known = data.notna()
        out = pd.Series(pd.NA, index=data.index, dtype="Int64")
        out[known] = crc32c_many([bytes(x) for x in data[known]])
        yield out


class Xoshiro256:
    """xoshiro256++ over a given state of four 64-bit words."""

    def __init__(self, state: tuple[int, int, int, int]):
        self.s = list(state)

    def next(self) -> int:
        s = self.s
        rot = lambda x, k: ((x << k) | (x >> (64 - k))) & _MASK
        out = (rot((s[0] + s[3]) & _MASK, 23) + s[0]) & _MASK
        t = (s[1] << 17) & _MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rot(s[3], 45)
        return out
