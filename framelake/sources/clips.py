"""Streams and pictures built from rows: a packet writer for elements, and views over the test tables that use it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions.payload import Port, leaves, transforms
from . import packets as PK
from . import views as V

#: Frames of a stream and of a group of pictures in the view.
STREAM_FRAMES, GROUP_FRAMES = 50, 5
#: Below QP 9 the loop filter leaves every sample as it is.
QP = 6


def write_payload(key: bool, superblocks: list[tuple], contexts: list[int] | None) -> tuple[bytes, list[int]]:
    """Payload and contexts of superblocks (partition, [(prediction, {plane: [levels of each transform]})])."""
    port = Port(None, contexts)
    for tree, blocks in superblocks:
        port.partition(tree)
        for (_, _, n), (prediction, levels) in zip(leaves(tree), blocks, strict=True):
            port.prediction(key, prediction)
            if prediction[0] != "skip":
                for plane, (chroma, size, count) in enumerate(transforms(n)):
                    for k in range(count):
                        given = levels.get(plane, [])
                        port.coefficients(chroma, size, given[k] if k < len(given) else [0] * (size * size))
    return port.finish(), port.contexts


def _frame(nth: int, v: list[int]) -> tuple:
    """One 64-pixel block: an intra one with three levels a luma transform, or one that moves or repeats a reference."""

    def low(values: list[int]) -> list[int]:
        return [values[0], values[1]] + [0] * 30 + [values[2]] + [0] * (32 * 32 - 33)

    luma = [low([x - 128 for x in v[3 * t : 3 * t + 3]]) for t in range(4)]
    flat = {0: luma, 1: [[v[12] - 128] + [0] * 1023], 2: [[v[13] - 128] + [0] * 1023]}
    moves = [(v[20 + 2 * k] % 9 - 4) * 8 for k in range(2)]
    kinds = [("intra", "dc"), ("skip", "last"), ("inter", "last", moves[0], moves[1]), ("inter", "golden", moves[1], moves[0]), ("intra", "dc")]
    return kinds[nth], flat if nth in (0, 4) else {}


def element_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id and data: a 64 x 64 stream for each 50 blocks, a packet for each block, in groups of five."""
    b = V.blocks(spark, sf_dir).select(F.floor(F.col("block_id") / STREAM_FRAMES).alias("stream_id"), (F.col("block_id") % STREAM_FRAMES).alias("pos"), "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        contexts, body = None, []
        for pos, v in zip(pdf["pos"].tolist(), pdf["v"].tolist(), strict=True):
            nth = pos % GROUP_FRAMES
            payload, contexts = write_payload(nth == 0, [(64, [_frame(nth, [int(x) for x in v])])], None if nth == 0 else contexts)
            body.append(PK.encode_packet(pos, PK.SHOW | (PK.KEY | PK.GOLDEN if nth == 0 else 0) | (PK.GOLDEN if nth == 2 else 0), QP, payload))
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "data": [PK.encode_stream(PK.Stream(64, 64, 25, 1)) + b"".join(body)]})

    return B.spread(b, "stream_id").groupBy("stream_id").applyInPandas(run, "stream_id bigint, data binary")


def small_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """picture, width, height, y, cb, cr: every block as an 8 x 8 picture; chroma is every second sample, and its complement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            luma = [bytes(x) for x in b.column(1).to_pylist()]
            cb = [bytes(x[16 * r + 2 * c] for r in range(4) for c in range(4)) for x in luma]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([8] * n, pa.int32()), pa.array([8] * n, pa.int32()), pa.array(luma, pa.binary()), pa.array(cb, pa.binary()), pa.array([bytes(255 - s for s in x) for x in cb], pa.binary())], names=["picture", "width", "height", "y", "cb", "cr"])

    return V.blocks(spark, sf_dir).mapInArrow(B.lean(run), "picture bigint, width int, height int, y binary, cb binary, cr binary")


def tiled_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """picture, width, height, qp, blocks, y, cb, cr: 64 blocks in a row make a 64 x 64 picture (grey where one is missing), with a partition by rule."""
    tile = F.struct((F.col("block_id") % 64).cast("int").alias("k"), "v")
    packed = V.blocks(spark, sf_dir).groupBy(F.floor(F.col("block_id") / 64).alias("picture")).agg(F.collect_list(tile).alias("tiles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            rows = []
            for r in b.to_pylist():
                y = np.full((64, 64), 128, np.uint8)
                for t in r["tiles"]:
                    top, left = t["k"] // 8 * 8, t["k"] % 8 * 8
                    y[top : top + 8, left : left + 8] = np.array(t["v"], np.uint8).reshape(8, 8)
                cb = y[::2, ::2]
                p, blocks = r["picture"], []
                quarters = [(0, 0, 64)] if p % 4 == 3 else [(x, z, {0: 32, 1: 16, 2: 8}[(p + k) % 3]) for k, (z, x) in enumerate(((0, 0), (0, 32), (32, 0), (32, 32)))]
                for x0, y0, size in quarters:
                    for by in range(y0, y0 + max(32, size), size):
                        blocks += [{"x": bx, "y": by, "size": size, "intra": (p + bx // 8 + by // 8) % 3 == 0, "coded": (p + bx // 8) % 2 == 0} for bx in range(x0, x0 + max(32, size), size)]
                rows.append({"picture": p, "width": 64, "height": 64, "qp": int(20 + p % 40), "blocks": blocks, "y": y.tobytes(), "cb": cb.tobytes(), "cr": (255 - cb).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("picture", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("qp", pa.int32()), ("blocks", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("size", pa.int32()), ("intra", pa.bool_()), ("coded", pa.bool_())]))), ("y", pa.binary()), ("cb", pa.binary()), ("cr", pa.binary())]))

    return packed.mapInArrow(B.lean(run), "picture bigint, width int, height int, qp int, blocks array<struct<x:int,y:int,size:int,intra:boolean,coded:boolean>>, y binary, cb binary, cr binary")


def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips (stream_id, frame, width, height, y, cb, cr): eight blocks a clip, each sample of a block an 8 x 8 square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            ids = b.column(0).to_numpy()
            small = [np.array(v, np.uint8).reshape(8, 8) for v in b.column(1).to_pylist()]
            luma = [np.kron(v, np.ones((8, 8), np.uint8)).tobytes() for v in small]
            chroma = [np.kron(v, np.ones((4, 4), np.uint8)) for v in small]
            n = pa.array([64] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids // 8), pa.array(ids % 8), n, n, pa.array(luma, pa.binary()), pa.array([c.tobytes() for c in chroma], pa.binary()), pa.array([(255 - c).tobytes() for c in chroma], pa.binary())], names=["stream_id", "frame", "width", "height", "y", "cb", "cr"])

    return V.blocks(spark, sf_dir).mapInArrow(B.lean(run), "stream_id bigint, frame bigint, width int, height int, y binary, cb binary, cr binary")
