"""Raw 4:2:0 clips: YUV4MPEG2 files as one row per frame, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans import constants as C
from .packets import FormatError

SCHEMA = "clip string, width int, height int, fps_num int, fps_den int, frame bigint, y binary, cb binary, cr binary"


def parse(data: bytes) -> tuple[dict[str, int], list[tuple[bytes, bytes, bytes]]]:
    """Header fields and planes of every frame; refuses what is not a progressive 4:2:0 clip of legal size."""
    line, newline, _ = data.partition(b"\n")
    tokens = line.split(b" ")
    if tokens[0] != b"YUV4MPEG2" or not newline:
        raise FormatError("y4m.magic", 0)
    head: dict[str, int] = {}
    for t in tokens[1:]:
        tag, value = t[:1], t[1:].decode("ascii", "replace")
        if tag in b"WH":
            head["width" if tag == b"W" else "height"] = int(value) if value.isdigit() else 0
        elif tag in b"FA":
            num, _, den = value.partition(":")
            if not (num.isdigit() and den.isdigit()) or (tag == b"F" and not int(num) * int(den)):
                raise FormatError("y4m.ratio", 0)
            if tag == b"F":
                head["fps_num"], head["fps_den"] = int(num), int(den)
        elif tag == b"I" and value != "p" or tag == b"C" and value != "420jpeg" or tag not in b"ICX":
            raise FormatError("y4m.token", 0)
    w, h = head.get("width", 0), head.get("height", 0)
    if not (C.WIDTHS[0] <= w <= C.WIDTHS[1] and C.HEIGHTS[0] <= h <= C.HEIGHTS[1]) or w % 2 or h % 2 or "fps_num" not in head:
        raise FormatError("y4m.geometry", 0)
    at, frames, luma, chroma = len(line) + 1, [], w * h, w * h // 4
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0 or not data[at:end].startswith(b"FRAME"):
            raise FormatError("y4m.frame", at)
        at = end + 1
        if at + luma + 2 * chroma > len(data):
            raise FormatError("y4m.samples", len(data))
        frames.append((data[at : at + luma], data[at + luma : at + luma + chroma], data[at + luma + chroma : at + luma + 2 * chroma]))
        at += luma + 2 * chroma
    if not frames:
        raise FormatError("y4m.empty", len(data))
    return head, frames


def write(width: int, height: int, fps_num: int, fps_den: int, frames: list[tuple[bytes, bytes, bytes]]) -> bytes:
    for planes in frames:
        if [len(p) for p in planes] != [width * height, width * height // 4, width * height // 4]:
            raise FormatError("y4m.plane", 0)
    return f"YUV4MPEG2 W{width} H{height} F{fps_num}:{fps_den} Ip A0:0 C420jpeg\n".encode() + b"".join(b"FRAME\n" + b"".join(p) for p in frames)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Clips under a path, one row per frame; files are spread over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"].tolist(), b["content"].tolist(), strict=True):
                head, frames = parse(bytes(content))
                for lo in range(0, len(frames), 16):
                    yield pd.DataFrame([(path, head["width"], head["height"], head["fps_num"], head["fps_den"], lo + i, *planes) for i, planes in enumerate(frames[lo : lo + 16])], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
