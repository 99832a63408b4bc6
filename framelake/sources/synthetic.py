"""Test clips by pattern, and damage to streams: the generators, each frame and stream on its own."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import batches as B
from ..functions.hashing import Xoshiro256, crc32c
from ..plans import constants as C
from . import packets as PK

PATTERNS = ("flat", "gradient", "noise", "motion", "cut", "fade")
SCHEMA = "frame bigint, width int, height int, y binary, cb binary, cr binary"
_M64 = (1 << 64) - 1
_STIR = 0x9E3779B97F4A7C15


def seeded(seed: int) -> Xoshiro256:
    """A generator from one number, stirred so that its words differ (SplitMix64)."""
    state = []
    for k in range(1, 5):
        z = (seed + k * _STIR) & _M64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _M64
        state.append(z ^ z >> 31)
    return Xoshiro256(tuple(state))


def _ramp(width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return ((x * 3 + y * 2) % 256 + np.where((x // 16 + y // 16) % 2 == 0, 16, 0)) % 256


@cache
def _texture(width: int, height: int, seed: int) -> np.ndarray:
    """A field of blurred noise, 64 wider and higher than the picture, to move over."""
    rng = seeded(seed)
    field = np.array([((rng.next() >> 40 & 255) + 128) // 2 for _ in range((width + 64) * (height + 64))], np.int64).reshape(height + 64, width + 64)
    for _ in range(2):
        near = sum(np.roll(field, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) // 9
        field = field.copy()
        field[1:-1, 1:-1] = near[1:-1, 1:-1]
    return field


def luma(pattern: str, width: int, height: int, index: int, frames: int, seed: int = 0) -> np.ndarray:
    if pattern == "flat":
        return np.full((height, width), 128, np.uint8)
    if pattern == "gradient":
        return _ramp(width, height).astype(np.uint8)
    if pattern == "fade":
        steps = max(frames - 1, 1)
        return (_ramp(width, height) * (steps - min(index, steps)) // steps).astype(np.uint8)
    if pattern == "noise":
        rng = seeded(seed ^ index << 32)
        return np.array([rng.next() >> 32 & 255 for _ in range(width * height)], np.uint8).reshape(height, width)
    if pattern not in ("motion", "cut"):
        raise ValueError(f"{pattern} is not a pattern")
    second = pattern == "cut" and index >= frames // 2
    field = _texture(width, height, seed ^ _STIR if second else seed)
    phase, (dx, dy) = (index - frames // 2, (2, 3)) if second else (index, (3, 2))
    rows, cols = (np.arange(height) + phase * dy) % (height + 63), (np.arange(width) + phase * dx) % (width + 63)
    return field[np.ix_(rows, cols)].astype(np.uint8)


def clip(spark: SparkSession, pattern: str, width: int, height: int, frames: int, seed: int = 0) -> DataFrame:
    """One row for each frame; any frame can be made without the others."""
    if pattern not in PATTERNS:
        raise ValueError(f"{pattern} is not a pattern")
    grey = bytes([128]) * (width * height // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([{"frame": index, "width": width, "height": height, "y": luma(pattern, width, height, index, frames, seed).tobytes(), "cb": grey, "cr": grey}], schema=pa.schema([("frame", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("y", pa.binary()), ("cb", pa.binary()), ("cr", pa.binary())]))

    return spark.range(frames).mapInArrow(run, SCHEMA)


def _take(rng: Xoshiro256, below: int) -> int:
    return rng.next() % below if below > 1 else 0


def _noise(rng: Xoshiro256, size: int) -> bytes:
    return b"".join(struct.pack("<Q", rng.next()) for _ in range(-(-size // 8)))[:size]


def starts(data: bytes) -> list[int]:
    """Every place where a packet's mark stands."""
    out, at = [], data.find(PK.PACKET_MAGIC)
    while at >= 0:
        out.append(at)
        at = data.find(PK.PACKET_MAGIC, at + 4)
    return out


def flip_bit(data: bytes, rng: Xoshiro256, span: int | None = None) -> bytes:
    """One bit turned over, in the first ``span`` bytes where given."""
    out = bytearray(data)
    at = _take(rng, min(len(data), span or len(data)))
    out[at] ^= 1 << _take(rng, 8)
    return bytes(out)


def cut_short(data: bytes, rng: Xoshiro256) -> bytes:
    return data[: _take(rng, len(data) + 1)]


def false_mark(data: bytes, rng: Xoshiro256) -> bytes:
    at = _take(rng, len(data) + 1)
    return data[:at] + PK.PACKET_MAGIC + _noise(rng, 8) + data[at:]


def false_length(data: bytes, rng: Xoshiro256) -> bytes:
    """The first packet says another payload length, under a sound header checksum; an incomplete header stays as it is."""
    every = starts(data)
    if not every or every[0] + 20 > len(data):
        return data
    out, at = bytearray(data), every[0]
    out[at + 4 : at + 8] = struct.pack("<I", C.PAYLOAD_BYTES[0] + _take(rng, 4096))
    out[at + 16 : at + 20] = struct.pack("<I", crc32c(bytes(out[at + 4 : at + 16])))
    return bytes(out)


def break_checksum(data: bytes, rng: Xoshiro256) -> bytes:
    """A byte of the stream header's checksum turned over."""
    out, at = bytearray(data), 20 + _take(rng, 4) if len(data) > 20 else 0
    if len(data) > 20 and at < len(data):
        out[at] ^= 0xFF
    return bytes(out)


def drop_packet(data: bytes, rng: Xoshiro256) -> bytes:
    """A stream without one of its later packets; one of a single packet is damaged otherwise."""
    every = starts(data)
    if len(every) < 2:
        return structured(data, rng)
    k = 1 + _take(rng, len(every) - 1)
    return data[: every[k]] + (data[every[k + 1] :] if k + 1 < len(every) else b"")


def structured(data: bytes, rng: Xoshiro256) -> bytes:
    """One of five kinds of damage."""
    if not data:
        return _noise(rng, 16)
    return (flip_bit, cut_short, false_mark, false_length, break_checksum)[_take(rng, 5)](data, rng)


DAMAGE = {
    "arbitrary_bytes": lambda data, rng: _noise(rng, 1 + _take(rng, 384)),
    "structured_mutation": structured,
    "header_fuzz": lambda data, rng: flip_bit(data, rng, C.HEADER_BYTES) if data else _noise(rng, C.HEADER_BYTES),
    "frame_deletion": drop_packet,
}


def damaged(streams: DataFrame, target: str, seed: int = 0) -> DataFrame:
    """(stream_id, data) after damage of a kind in ``DAMAGE``; a stream's damage hangs on the seed and its id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            data = [DAMAGE[target](x, seeded(seed ^ (i & _M64))) for i, x in zip(ids, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["stream_id", "data"])

    return streams.select("stream_id", "data").mapInArrow(B.lean(run), "stream_id bigint, data binary")
