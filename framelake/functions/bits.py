"""Bit strings, highest bit first: kernels, and the same as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDEST = 32


class BitWriter:
    def __init__(self) -> None:
        self.value = self.length = 0

    def write(self, value: int, width: int) -> None:
        if not 0 <= width <= WIDEST:
            raise ValueError(f"a field of {width} bits")
        self.value = self.value << width | value & ((1 << width) - 1)
        self.length += width

    def finish(self) -> bytes:
        """The bytes; the last one is filled up with zeros."""
        size = -(-self.length // 8)
        return (self.value << (8 * size - self.length)).to_bytes(size, "big")


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.length, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def read(self, width: int) -> int:
        if not 0 <= width <= WIDEST:
            raise ValueError(f"a field of {width} bits")
        if self.at + width > self.length:
            raise EOFError(f"bits end at {self.at}")
        self.at += width
        return self.value >> (self.length - self.at) & ((1 << width) - 1)


def packed(fields: list[tuple[Column, int]]) -> Column:
    """A binary column of unsigned fields of given widths, one after another."""
    bits = F.concat(*[F.lpad(F.bin(v.cast("bigint")), w, "0") for v, w in fields])
    total = sum(w for _, w in fields)
    bits = F.rpad(bits, -(-total // 8) * 8, "0")
    return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(bits, 4 * i + 1, 4), 2, 16), 1, "0") for i in range(-(-total // 8) * 2)]))


def unpacked(data: Column, widths: list[int]) -> list[Column]:
    """Unsigned fields of given widths from the start of a binary column; null past its end."""
    out, at = [], 0
    hexed = F.hex(data)
    for w in widths:
        first, last = at // 4, (at + w - 1) // 4
        part = F.substring(hexed, first + 1, last - first + 1)
        bits = F.concat(*[F.lpad(F.conv(F.substring(part, i + 1, 1), 16, 2), 4, "0") for i in range(last - first + 1)])
        field = F.conv(F.substring(bits, at - 4 * first + 1, w), 2, 10).cast("bigint")
        out.append(F.when(F.length(hexed) > last, field))
        at += w
    return out
