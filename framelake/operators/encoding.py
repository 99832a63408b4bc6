"""Clips to streams: the plan of keyframes, then pictures coded group by group.

With a fixed quantizer nothing crosses a keyframe, so groups of pictures are
coded apart, like they are decoded; only the plan (scene cuts, intervals) is a
walk over a clip, and that over one number a frame.  With a target bitrate each
picture's quantizer hangs on the bits of all before it, so a clip is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import batches as B
from ..functions import codec as K
from ..functions import pictures as P
from ..functions import search as S
from ..plans import constants as C
from ..sources import packets as PK
from . import folds

PACKETS = "stream_id bigint, frame bigint, key boolean, golden boolean, qp int, width int, height int, packet binary, payload_len bigint, cost_q16 bigint, y binary, cb binary, cr binary"


def frame_changes(clips: DataFrame) -> DataFrame:
    """stream_id, frame and sad: the summed absolute change of luma since the clip's frame before, null for the first."""
    w = Window.partitionBy("stream_id").orderBy("frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sad = []
            for now, before in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                sad.append(None if before is None else int(np.abs(np.frombuffer(now, np.uint8).astype(np.int64) - np.frombuffer(before, np.uint8)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sad, pa.int64())], names=["stream_id", "frame", "sad"])

    pairs = clips.select("stream_id", "frame", "y", F.lag("y").over(w).alias("before"))
    return pairs.mapInArrow(B.lean(run), "stream_id bigint, frame bigint, sad bigint")


def planned(clips: DataFrame, key_interval: int = C.KEY_INTERVAL, golden_interval: int = C.GOLDEN_INTERVAL) -> DataFrame:
    """Clips (stream_id, frame, width, height, y, cb, cr) with key, golden and gop of every frame; frames of several sizes are an error."""
    mixed = clips.groupBy("stream_id").agg(F.count_distinct("width", "height").alias("sizes")).where("sizes > 1").head()
    if mixed is not None:
        raise ValueError(f"clip {mixed['stream_id']} has frames of several sizes")
    changes = frame_changes(clips).withColumn("sad", F.coalesce("sad", F.lit(0)))
    plan = folds.plan_gops(changes, key_interval, golden_interval).drop("scene_cut")
    gop = F.sum(F.col("key").cast("bigint")).over(Window.partitionBy("stream_id").orderBy("frame"))
    return clips.hint("merge").join(plan.withColumn("gop", gop).join(changes, ["stream_id", "frame"]), ["stream_id", "frame"])


def _rows(groups: DataFrame, keys: list[str], code) -> DataFrame:
    needs = ["stream_id", "gop", "frame", "key", "golden", "width", "height", "y", "cb", "cr", "sad"]
    target = to_arrow_schema(StructType.fromDDL(PACKETS))

    def walked(batches: B.Batches) -> Iterator[tuple]:
        at, walk = None, None
        for b in batches:
            for r in b.to_pylist():
                now = tuple(r[k] for k in keys)
                if now != at:
                    at, walk = now, code()
                yield walk(r)

    return B.spread(groups.select(*needs), *keys).sortWithinPartitions(*keys, "frame").mapInArrow(B.lean(lambda batches: B.packed(walked(batches), target)), PACKETS)


def _coded(state: K.State, r: dict, qp: int, without: str | None) -> tuple[tuple, int]:
    source = P.unpacked(r["y"] + r["cb"] + r["cr"], r["width"], r["height"])
    got = S.encode_picture(source, qp, r["key"], state, without)
    state.install(got.picture, r["key"] or r["golden"], got.contexts)
    flags = PK.SHOW | (PK.KEY if r["key"] else 0) | (PK.GOLDEN if r["golden"] else 0)
    packet = PK.encode_packet(r["frame"], flags, qp, got.payload)
    shown = [p.tobytes() for p in P.crop(got.picture, r["width"], r["height"])]
    return (r["stream_id"], r["frame"], r["key"], r["golden"], qp, r["width"], r["height"], packet, len(got.payload), got.cost, *shown), len(packet) * 8


def encode(clips: DataFrame, qp: int, tools: str = "full", key_interval: int = C.KEY_INTERVAL, golden_interval: int = C.GOLDEN_INTERVAL) -> DataFrame:
    """Packets and reconstructed pictures of every frame at one quantizer, with a named set of tools."""
    if not 0 <= qp <= C.QP_MAX or tools not in C.TOOLSETS:
        raise ValueError("no such quantizer or set of tools")
    without = C.TOOLSETS[tools]

    def code():
        state = K.State()
        return lambda r: _coded(state, r, qp, without)[0]

    return _rows(planned(clips, key_interval, golden_interval), ["stream_id", "gop"], code)


def encode_to_rate(clips: DataFrame, bits_per_second: int, fps_num: int, fps_den: int = 1, tools: str = "full", key_interval: int = C.KEY_INTERVAL, golden_interval: int = C.GOLDEN_INTERVAL) -> DataFrame:
    """The same at an average bitrate: a leaky bucket sets each frame's quantizer."""
    without = C.TOOLSETS[tools]

    def code():
        state, rate = K.State(), folds.RateControl(bits_per_second, fps_num, fps_den)

        def walk(r: dict) -> tuple:
            rate.observe(r["sad"])
            row, bits = _coded(state, r, rate.qp, without)
            rate.commit(bits)
            return row

        return walk

    return _rows(planned(clips, key_interval, golden_interval).withColumn("gop", F.lit(0).cast("bigint")), ["stream_id"], code)


def streams(packets: DataFrame, fps_num: int = 25, fps_den: int = 1, key_interval: int = C.KEY_INTERVAL, golden_interval: int = C.GOLDEN_INTERVAL) -> DataFrame:
    """(stream_id, data): header and packets in order, one binary value each."""
    body = F.array_sort(F.collect_list(F.struct("frame", "packet")))
    g = packets.groupBy("stream_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            data = [PK.encode_stream(PK.Stream(r["width"], r["height"], fps_num, fps_den, key_interval, golden_interval)) + b"".join(p["packet"] for p in r["body"]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["stream_id", "data"])

    return g.mapInArrow(B.lean(run), "stream_id bigint, data binary")


def rate_points(clips: DataFrame, qps: list[int], tools: list[str], fps_num: int = 25, fps_den: int = 1) -> DataFrame:
    """clip, toolset, qp, bytes, rate (bits a second) and squared luma error of clips at each quantizer and set of tools."""
    out = None
    for t in tools:
        for qp in qps:
            p = encode(clips, qp, t).hint("merge").join(clips.select("stream_id", "frame", F.col("y").alias("source")), ["stream_id", "frame"])
            rows = p.select("stream_id", F.octet_length("packet").cast("bigint").alias("bytes"), _sse(F.col("source"), F.col("y")).alias("sse"), F.octet_length("source").cast("bigint").alias("n"))
            g = rows.groupBy(F.col("stream_id").alias("clip")).agg((F.sum("bytes") + C.HEADER_BYTES).alias("bytes"), F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.count("*").alias("frames"))
            g = g.select("clip", F.lit(t).alias("toolset"), F.lit(qp).alias("qp"), "bytes", (F.col("bytes") * 8.0 * fps_num / (F.col("frames") * fps_den)).alias("rate"), "sse", "n")
            out = g if out is None else out.unionByName(g)
    return out


def _sse(a: Column, b: Column) -> Column:
    @F.pandas_udf("bigint")
    def sse(x: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([int(((np.frombuffer(p, np.uint8).astype(np.int64) - np.frombuffer(q, np.uint8)) ** 2).sum()) for p, q in zip(x, z, strict=True)])

    return sse(a, b)
