"""Stream headers and packets: binary layout, strict and recovering scans.

Fixed values: a stream starts with a 24-byte header ``KFV1``, packets with a
24-byte header ``KFP1``; integers are little-endian, checksums CRC-32C.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import batches as B
from ..functions.hashing import crc32c, crc32c_many, crc32c_rows
from ..functions.numeric import little_endian
from ..plans import constants as C

STREAM_MAGIC, PACKET_MAGIC = b"KFV1", b"KFP1"
_STREAM = struct.Struct("<4sHHHBBHHHBBI")
_PACKET = struct.Struct("<4sIIBBHII")
KEY, GOLDEN, SHOW = 1, 2, 4


class FormatError(ValueError):
    """What is wrong, and at which byte."""

    def __init__(self, element: str, offset: int):
        super().__init__(f"{element} at byte {offset}")
        self.element, self.offset = element, offset


@dataclass(frozen=True)
class Stream:
    width: int
    height: int
    fps_num: int
    fps_den: int
    key_interval: int = C.KEY_INTERVAL
    golden_interval: int = C.GOLDEN_INTERVAL


@dataclass(frozen=True)
class Packet:
    frame_index: int
    flags: int
    qp: int
    payload_len: int
    payload_crc: int

    @property
    def size(self) -> int:
        return C.HEADER_BYTES + self.payload_len


def encode_stream(s: Stream) -> bytes:
    head = _STREAM.pack(STREAM_MAGIC, 1, s.width, s.height, 1, 8, s.fps_num, s.fps_den, s.key_interval, s.golden_interval, 0, 0)[:20]
    return head + struct.pack("<I", crc32c(head))


def decode_stream(data: bytes) -> Stream:
    if len(data) < C.HEADER_BYTES:
        raise FormatError("sequence", len(data))
    magic, version, width, height, chroma, depth, num, den, key, golden, flags, crc = _STREAM.unpack_from(data)
    checks = [
        ("magic", magic == STREAM_MAGIC, 0), ("version", version == 1, 4), ("chroma", chroma == 1, 10), ("depth", depth == 8, 11), ("flags", flags == 0, 19), ("header_crc32c", crc == crc32c(data[:20]), 20),
        ("width", C.WIDTHS[0] <= width <= C.WIDTHS[1] and width % 2 == 0, 6), ("height", C.HEIGHTS[0] <= height <= C.HEIGHTS[1] and height % 2 == 0, 8),
        ("fps_num", num > 0, 12), ("fps_den", den > 0, 14), ("kf_interval", key > 0, 16), ("golden_interval", golden > 0, 18),
    ]
    for element, good, offset in checks:
        if not good:
            raise FormatError(f"sequence.{element}", offset)
    return Stream(width, height, num, den, key, golden)


def legal_flags(flags: int) -> bool:
    """Shown, nothing reserved, and a keyframe refreshes the long-term reference."""
    return not flags & 0xF8 and bool(flags & SHOW) and not (flags & KEY and not flags & GOLDEN)


def encode_packets(packets: list[tuple[int, int, int, bytes]]) -> bytes:
    """Packets (index, flags, qp, payload) one after another, their checksums worked out together."""
    if not packets:
        return b""
    for _, flags, qp, payload in packets:
        if not C.PAYLOAD_BYTES[0] <= len(payload) <= C.PAYLOAD_BYTES[1] or not 0 <= qp <= C.QP_MAX or not legal_flags(flags):
            raise FormatError("packet", 0)
    middle = [struct.pack("<IIBBH", len(payload), index, flags, qp, 0) for index, flags, qp, payload in packets]
    head = crc32c_rows(np.frombuffer(b"".join(middle), np.uint8).reshape(-1, 12)).tolist()
    body = crc32c_many([p[3] for p in packets]).tolist()
    return b"".join(PACKET_MAGIC + m + struct.pack("<II", h, b) + p[3] for m, h, b, p in zip(middle, head, body, packets, strict=True))


def encode_packet(frame_index: int, flags: int, qp: int, payload: bytes) -> bytes:
    if not C.PAYLOAD_BYTES[0] <= len(payload) <= C.PAYLOAD_BYTES[1] or not 0 <= qp <= C.QP_MAX or not legal_flags(flags):
        raise FormatError("packet", 0)
    middle = struct.pack("<IIBBH", len(payload), frame_index, flags, qp, 0)
    return PACKET_MAGIC + middle + struct.pack("<II", crc32c(middle), crc32c(payload)) + payload


def decode_header(data: bytes, at: int = 0, checksum: int | None = None) -> Packet | None:
    """The packet header at a place, or None if there is no sound one; ``checksum``: that of its fields, if known."""
    if at + C.HEADER_BYTES > len(data):
        return None
    magic, size, index, flags, qp, reserved, head_crc, crc = _PACKET.unpack_from(data, at)
    sound = magic == PACKET_MAGIC and head_crc == (crc32c(data[at + 4 : at + 16]) if checksum is None else checksum) and reserved == 0 and qp <= C.QP_MAX and legal_flags(flags) and C.PAYLOAD_BYTES[0] <= size <= C.PAYLOAD_BYTES[1]
    return Packet(index, flags, qp, size, crc) if sound else None


def events(data: bytes, start: int = C.HEADER_BYTES) -> list[tuple[str, int, Packet]]:
    """(packet, payload_corrupt or truncated; offset; header) in order; false and stale starts are stepped over."""
    return list(each_event(data, start))


def each_event(data: bytes, start: int = C.HEADER_BYTES, at_once: int = 4096) -> Iterator[tuple[str, int, Packet]]:
    """``events`` one after another, whatever the stream's length.

    So many marks are looked at together: all their headers are checked at
    once, then those that the walk meets, and their payloads.
    """
    free, last, at = start, -1, data.find(PACKET_MAGIC, start)
    while at >= 0 and at + C.HEADER_BYTES <= len(data) and free <= len(data):
        marks = []
        while at >= 0 and at + C.HEADER_BYTES <= len(data) and len(marks) < at_once:
            marks.append(at)
            at = data.find(PACKET_MAGIC, at + 1)
        raw = np.frombuffer(data, np.uint8)[np.array(marks)[:, None] + np.arange(4, 16)]
        met: list[tuple[int, Packet, bool]] = []
        for mark, crc in zip(marks, crc32c_rows(raw).tolist(), strict=True):
            if mark < free:
                continue
            p = decode_header(data, mark, crc)
            if p is None or p.frame_index <= last:
                continue
            last, free = p.frame_index, mark + p.size
            met.append((mark, p, free <= len(data)))
            if free > len(data):
                break
        whole = [(mark, p) for mark, p, complete in met if complete]
        sound = iter((crc32c_many([data[mark + C.HEADER_BYTES : mark + p.size] for mark, p in whole]) == [p.payload_crc for _, p in whole]).tolist() if whole else [])
        yield from ((("packet" if next(sound) else "payload_corrupt") if complete else "truncated", mark, p) for mark, p, complete in met)


def scan(streams: DataFrame, strict: bool = False) -> DataFrame:
    """stream_id, pos, event, offset, frame_index, key, golden, qp, payload_len of every packet of (stream_id, data).

    A strict scan ends each stream at its first damaged packet, which it still
    reports.  One stream is one row, as its packets can only be found in order;
    of what it finds, a task holds a bounded part at a time.
    """
    schema = "stream_id bigint, pos bigint, event string, offset bigint, frame_index bigint, key boolean, golden boolean, qp int, payload_len bigint"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def found(batches: B.Batches) -> Iterator[tuple]:
        for b in batches:
            for stream, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for pos, (event, at, p) in enumerate(each_event(data.as_py() or b"")):
                    yield stream, pos, event, at, p.frame_index, bool(p.flags & KEY), bool(p.flags & GOLDEN), p.qp, p.payload_len
                    if strict and event != "packet":
                        break

    return streams.select("stream_id", F.col("data").cast("binary")).mapInArrow(B.lean(lambda batches: B.packed(found(batches), target)), schema)


def payloads(streams: DataFrame, bad_headers: bool = False) -> DataFrame:
    """The packets of ``scan`` with their payload (null where damaged) and the stream's size.

    A stream with a bad header is an error, or with ``bad_headers`` one row of the event ``bad_header``.
    """

    schema = "stream_id bigint, pos bigint, event string, offset bigint, frame_index bigint, key boolean, golden boolean, qp int, payload_len bigint, width int, height int, payload binary"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def found(batches: B.Batches) -> Iterator[tuple]:
        for b in batches:
            for stream, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = value.as_py()
                if data is None:
                    continue
                try:
                    head = decode_stream(data)
                except FormatError:
                    if not bad_headers:
                        raise
                    yield stream, 0, "bad_header", 0, 0, False, False, 0, 0, 0, 0, None
                    continue
                for pos, (event, at, p) in enumerate(each_event(data)):
                    yield stream, pos, event, at, p.frame_index, bool(p.flags & KEY), bool(p.flags & GOLDEN), p.qp, p.payload_len, head.width, head.height, data[at + C.HEADER_BYTES : at + p.size] if event == "packet" else None

    return streams.select("stream_id", F.col("data").cast("binary")).mapInArrow(B.lean(lambda batches: B.packed(found(batches), target)), schema)


def header_columns(data: Column) -> list[Column]:
    """Stream header fields read from binary in generated code, without checks."""
    at = {"version": (4, 2), "width": (6, 2), "height": (8, 2), "chroma": (10, 1), "depth": (11, 1), "fps_num": (12, 2), "fps_den": (14, 2), "kf_interval": (16, 2), "golden_interval": (18, 1), "flags": (19, 1), "header_crc32c": (20, 4)}
    return [little_endian(data, *x).alias(n) for n, x in at.items()]


def flag_columns(flags: Column) -> list[Column]:
    bit = lambda b: flags.bitwiseAND(b) != 0
    legal = (flags.bitwiseAND(0xF8) == 0) & bit(SHOW) & (~bit(KEY) | bit(GOLDEN))
    return [bit(KEY).alias("key"), bit(GOLDEN).alias("golden_refresh"), bit(SHOW).alias("show"), legal.alias("legal")]


def build_streams(packets: DataFrame) -> DataFrame:
    """(stream_id, data) of packets with stream_id, pos, frame_index, key, payload: written one after another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        body = encode_packets([(i, (KEY | GOLDEN if k else 0) | SHOW, 32, bytes(p)) for i, k, p in zip(pdf["frame_index"].tolist(), pdf["key"].tolist(), pdf["payload"].tolist(), strict=True)])
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "data": [encode_stream(Stream(64, 64, 25, 1)) + body]})

    return packets.groupBy("stream_id").applyInPandas(run, "stream_id bigint, data binary")


def damage(streams: DataFrame, every: int = 7) -> DataFrame:
    """Streams with one payload byte of every ``every``-th packet turned over; the bytes between stay in place."""

    def turn(data: bytes) -> bytes:
        out = bytearray(data)
        for n, (_, at, p) in enumerate(events(data)):
            if n % every == every - 1:
                out[at + C.HEADER_BYTES + p.payload_len // 2] ^= 1
        return bytes(out)

    at = streams.columns.index("data")

    def run(batches: B.Batches) -> B.Batches:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([None if x is None else turn(x) for x in b.column(at).to_pylist()], b.schema.field(at).type))

    return streams.mapInArrow(B.lean(run), streams.schema)
