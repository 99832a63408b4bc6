"""Block transforms, quantization, scan order and coding costs.

A block is one row with an array; the transforms' matrices are constant, so
they are narrow, batch by batch: no join and no shuffle at any size of table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import numeric as N
from ..functions import pictures as P
from ..plans import constants as C


def _transformed(df: DataFrame, column: str, n: int, kernel) -> DataFrame:
    """An integer transform of a column of row-major n x n arrays, in place: a batch of blocks is two matrix products."""
    schema = StructType([StructField(column, ArrayType(LongType())) if f.name == column else f for f in df.schema.fields])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = pc.list_flatten(b.column(at)).to_numpy(zero_copy_only=False).reshape(-1, n, n)
            out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (n * n), pa.int32()), pa.array(kernel(blocks).ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], out, *b.columns[at + 1 :]], names=b.schema.names)

    return df.mapInArrow(run, schema)


def forward_dct(df: DataFrame, column: str, n: int) -> DataFrame:
    """Integer DCT of a column of row-major arrays, in place: rows first, then columns."""
    return _transformed(df, column, n, P.forward)


def inverse_dct(df: DataFrame, column: str, n: int) -> DataFrame:
    return _transformed(df, column, n, P.inverse)


def residuals(blocks: DataFrame) -> DataFrame:
    """block_id and residual of every block against its rounded mean."""
    b = blocks.withColumn("mean", F.floor((F.aggregate("v", F.lit(0), lambda s, x: s + x) + F.size("v") / 2) / F.size("v")).cast("int"))
    return b.select("block_id", "mean", F.transform("v", lambda x: (x - F.col("mean")).cast("bigint")).alias("residual"))


def coefficients(blocks: DataFrame, n: int = 8) -> DataFrame:
    """block_id, coef."""
    return forward_dct(residuals(blocks).withColumnRenamed("residual", "coef"), "coef", n)


def levels(blocks: DataFrame, qp: int, n: int = 8) -> DataFrame:
    """block_id, level: quantized coefficients in raster order."""
    scale = F.lit(C.QSCALE[qp]).cast("bigint")
    return coefficients(blocks, n).select("block_id", "mean", F.transform("coef", lambda c: N.quantize(c, scale)).alias("level"))


def reconstructed(blocks: DataFrame, qp: int, n: int = 8) -> DataFrame:
    """block_id, v: samples after quantization and back."""
    scale = F.lit(C.QSCALE[qp]).cast("bigint")
    back = levels(blocks, qp, n).select("block_id", "mean", F.transform("level", lambda x: N.dequantize(x, scale)).alias("residual"))
    back = inverse_dct(back, "residual", n)
    return back.select("block_id", F.transform("residual", lambda r: N.clamp_sample(r + F.col("mean")).cast("int")).alias("v"))


def scanned(levels: DataFrame, n: int = 8) -> DataFrame:
    """block_id, scan: levels in alternating-diagonal order."""
    order = [y * n + x for x, y in C.diagonal_scan(n)]
    return levels.select("block_id", F.array(*[F.get("level", F.lit(i)) for i in order]).alias("scan"))


def last_significant(levels: DataFrame, n: int = 8) -> DataFrame:
    """block_id, last (scan place of the last level that is not zero; null if none), x, y and the number of such levels."""
    xs, ys = zip(*C.diagonal_scan(n), strict=True)
    place = F.sequence(F.lit(0), F.lit(n * n - 1))
    s = scanned(levels, n).select("block_id", F.array_max(F.filter(place, lambda i: F.get("scan", i) != 0)).alias("last"), F.size(F.filter("scan", lambda v: v != 0)).cast("bigint").alias("nonzero"))
    return s.select("block_id", "last", N.table(list(xs), F.col("last")).alias("x"), N.table(list(ys), F.col("last")).alias("y"), "nonzero")


def significance_contexts(levels: DataFrame, n: int = 8) -> DataFrame:
    """block_id, context, uses: which significance contexts the scan of each block meets, up to its last level."""
    group = n.bit_length() - 3
    s = scanned(levels, n).select("block_id", F.posexplode_outer("scan").alias("pos", "level"))  # outer: no inferred filter is pushed through the transforms
    w = Window.partitionBy("block_id").orderBy("pos")
    before = F.coalesce(F.sum((F.col("level") != 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(F.when(F.col("level") != 0, F.col("pos"))).over(Window.partitionBy("block_id"))
    s = s.withColumn("seen", before).withColumn("last", last).where("pos < last")
    return s.groupBy("block_id", (F.lit(group * 11) + F.least("seen", F.lit(10))).cast("bigint").alias("context")).agg(F.count("*").alias("uses"))


def level_bits(levels: DataFrame) -> DataFrame:
    """block_id and bits of all its levels as signed order-0 codes."""
    return levels.select("block_id", F.aggregate(F.transform("level", N.exp_golomb_bits), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("bits"))


def modelled_cost(bins: DataFrame) -> DataFrame:
    """stream_id and the modelled cost of its binary decisions (p1, symbol), in 1/65536 bits."""
    return bins.groupBy("stream_id").agg(F.sum(N.bin_cost(F.col("p1").cast("double"), F.col("symbol"))).alias("cost_q16"), F.count("*").alias("bins"))


def quadtree(costs: DataFrame) -> DataFrame:
    """frame, size, x, y: leaves of the cheapest split of each 64-pixel block; a tie keeps the larger square.

    Costs roll up three times, child sums against their parent; then a square is
    a leaf if it keeps itself and no square around it does.
    """
    best = costs.where("size = 8").select("frame", "size", "x", "y", "cost", F.lit(True).alias("keeps"))
    every, below = best, best
    for size in (16, 32, 64):
        cut = lambda c: (F.floor(F.col(c) / size) * size).cast("int").alias(c)  # noqa: B023, E731
        children = below.groupBy("frame", cut("x"), cut("y")).agg(F.sum("cost").alias("split"))
        own = costs.where(F.col("size") == size).join(children, ["frame", "x", "y"], "left")
        below = own.select("frame", "size", "x", "y", F.least("cost", F.coalesce("split", "cost")).alias("cost"), (F.col("split").isNull() | (F.col("cost") <= F.col("split"))).alias("keeps"))
        every = every.unionByName(below)
    top = every.select("*", *[(F.floor(F.col(c) / 64) * 64).cast("int").alias(f"s{c}") for c in ("x", "y")])
    # squares of a 64-pixel block, small in number, meet in one row
    packed = top.where("keeps").groupBy("frame", "sx", "sy").agg(F.collect_list(F.struct("size", "x", "y")).alias("kept"))
    inside = lambda a, b: (a["size"] > b["size"]) & (b["x"] >= a["x"]) & (b["x"] < a["x"] + a["size"]) & (b["y"] >= a["y"]) & (b["y"] < a["y"] + a["size"])
    leaves = F.filter("kept", lambda b: ~F.exists("kept", lambda a: inside(a, b)))
    return packed.select("frame", F.explode(leaves).alias("b")).select("frame", "b.size", "b.x", "b.y")


def cheapest(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The candidate of least cost for each key; of equal ones the first in ``order``."""
    rest = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("cost", "order")).alias("best")).select(*key, "best.*")
