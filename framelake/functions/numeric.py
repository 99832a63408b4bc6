"""Integer arithmetic of the format as column expressions; where no array function is used, generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import constants as C


def table(values: list[int], index: Column) -> Column:
    """The value at a 0-based place of a small fixed table; null outside it."""
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), index.cast("int"))


def rounded_shift(v: Column, bits: int) -> Column:
    """Right shift that rounds halves away from zero, the same for both signs."""
    half = F.shiftright(F.abs(v) + F.lit(1 << (bits - 1) if bits else 0), bits)
    return F.when(v < 0, -half).otherwise(half)


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def clamp_sample(v: Column) -> Column:
    return clamp(v, 0, 255)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def quantize(c: Column, scale: Column) -> Column:
    """Level of a coefficient: rounded, symmetric, limited."""
    level = F.least(F.floor((F.abs(c) * 16 + F.floor(scale / 2)) / scale), F.lit(C.LEVEL_MAX))
    return F.when(c < 0, -level).otherwise(level).cast("bigint")


def dequantize(level: Column, scale: Column) -> Column:
    """Coefficient of a level; the shift floors, so negative levels round differently."""
    return F.shiftright(level * scale + 8, 4)


def full_pel(v: Column) -> Column:
    """Nearest whole pixel of a quarter-pixel value, halves away from zero."""
    whole = F.floor((F.abs(v) + 2) / 4) * 4
    return F.when(v < 0, -whole).otherwise(whole).cast("bigint")


def exp_golomb_bits(v: Column) -> Column:
    """Bits of a signed order-0 code: prefix and rest of |v| + 1, and a sign unless zero."""
    return (F.length(F.bin(F.abs(v) + 1)) * 2 - 1 + (v != 0).cast("int")).cast("bigint")


def rd_cost(sse: Column, lambda_q8: Column, bits_q16: Column) -> Column:
    """Squared error and weighted bits in one number, wide enough for any picture."""
    d = "decimal(38,0)"
    return (sse.cast(d) + F.floor((lambda_q8.cast(d) * bits_q16.cast(d) + F.lit(1 << 23).cast(d)) / F.lit(1 << 24).cast(d))).cast(d)


def reflect(i: Column, n: int) -> Column:
    """Mirror index into 0..n-1 without repeating the edge; any distance outside."""
    if n == 1:
        return F.lit(0)
    m = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(m >= n, F.lit(2 * (n - 1)) - m).otherwise(m)


def decibels(sse: Column, samples: Column) -> Column:
    """PSNR of 8-bit samples; null where nothing differs."""
    return F.when(sse > 0, F.log10(F.lit(65025.0) * samples / sse) * 10.0)


def bin_cost(p1: Column, symbol: Column) -> Column:
    """Modelled cost of a binary decision in 1/65536 bits."""
    p = F.when(symbol, p1).otherwise(F.lit(C.PROBABILITY_TOTAL) - p1)
    return F.floor(-F.log2(p / F.lit(float(C.PROBABILITY_TOTAL))) * 65536 + 0.5).cast("bigint")


def little_endian(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes at a 0-based offset of a binary column."""
    return F.conv(F.hex(F.reverse(F.substring(data, offset + 1, size))), 16, 10).cast("bigint") if size == 1 else sum((F.conv(F.hex(F.substring(data, offset + 1 + i, 1)), 16, 10).cast("bigint") * (1 << (8 * i)) for i in range(size)), F.lit(0).cast("bigint"))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    """Full-range BT.601 conversion, rounded and clamped."""
    r = y + (cr - 128) * 1.402
    g = y - (cb - 128) * 0.344136 - (cr - 128) * 0.714136
    b = y + (cb - 128) * 1.772
    return [clamp_sample(F.floor(x + 0.5)).cast("int") for x in (r, g, b)]
