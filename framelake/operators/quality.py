"""Picture quality and rate-quality curves.

Squared errors stay integers until the last step, so sums do not depend on
order.  Pictures are arrays of samples; per-picture work is array expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import numeric as N
from ..plans import constants as C


def psnr_frames(pairs: DataFrame) -> DataFrame:
    """frame, sse, psnr (null and lossless where equal) of (frame, ref, dist) sample arrays."""
    sse = F.aggregate(F.zip_with("ref", "dist", lambda a, b: ((a - b) * (a - b)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pairs.select("frame", sse.alias("sse"), F.size("ref").cast("bigint").alias("n")).select("frame", "sse", "n", N.decibels(F.col("sse"), F.col("n")).alias("psnr"), (F.col("sse") == 0).alias("lossless"))


def psnr_clip(pairs: DataFrame) -> DataFrame:
    """One row: PSNR of the summed error, never the mean of decibels."""
    f = psnr_frames(pairs).agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.count("*").alias("frames"))
    return f.select("frames", "sse", N.decibels(F.col("sse"), F.col("n")).alias("psnr"))


@cache
def _blur(n: int) -> np.ndarray:
    """The 11-tap Gaussian over n samples as a matrix; samples outside are mirrored at the edge."""
    out = np.zeros((n, n))
    for i in range(n):
        for t, w in enumerate(C.gaussian()):
            m = (i + t - C.GAUSSIAN_RADIUS) % (2 * (n - 1)) if n > 1 else 0
            out[i, 2 * (n - 1) - m if m >= n else m] += w
    return out


def ssim_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity at every sample of pictures (n, height, width).  The blur is two constant matrices."""
    rows, cols = _blur(a.shape[1]), _blur(a.shape[2]).T
    ma, mb, aa, bb, ab = (rows @ x @ cols for x in (a, b, a * a, b * b, a * b))
    va, vb, cov = aa - ma * ma, bb - mb * mb, ab - ma * mb
    return (2 * ma * mb + C.SSIM_C1) * (2 * cov + C.SSIM_C2) / ((ma * ma + mb * mb + C.SSIM_C1) * (va + vb + C.SSIM_C2))


def ssim_frames(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """frame, ssim (mean of the map) and n, for arrays of width x height samples, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, height, width) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ssim_map(a, b).mean((1, 2))), pa.array(np.full(len(a), width * height))], names=["frame", "ssim", "n"])

    schema = StructType([pairs.schema["frame"], StructField("ssim", DoubleType()), StructField("n", LongType())])
    return pairs.select("frame", "ref", "dist").mapInArrow(run, schema)


def ssim_clip(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """One row: mean over all samples of the clip."""
    return ssim_frames(pairs, width, height).agg(F.count("*").alias("frames"), (F.sum(F.col("ssim") * F.col("n")) / F.sum("n")).alias("ssim"))


def frame_sad(frames: DataFrame) -> DataFrame:
    """clip, frame and the summed absolute change since the clip's frame before it; null for the first."""
    f = frames.withColumn("before", F.lag("v").over(Window.partitionBy("clip").orderBy("frame")))
    return f.select("clip", "frame", F.aggregate(F.zip_with("v", "before", lambda a, b: F.abs(a - b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("sad"))


class ClipsDiffer(ValueError):
    """Two clips that cannot be compared; says why."""


def check_pair(reference: DataFrame, distorted: DataFrame) -> DataFrame:
    """clip and ``refused`` for clips (clip, frame, width, height) that do not pair up: other frame counts, none, or another size.

    Clips that do pair up give no row, so a caller may test or anti-join it.
    """
    g = lambda df, name: df.groupBy("clip").agg(F.count("*").alias(name))
    counts = g(reference, "left_frames").join(g(distorted, "right_frames"), "clip", "full")
    size = lambda df, side: df.select("clip", "frame", F.struct("width", "height").alias(side))
    differ = size(reference, "a").join(size(distorted, "b"), ["clip", "frame"]).where("a <> b").groupBy("clip").agg(F.min_by(F.struct("frame", "a", "b"), "frame").alias("d"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    says = lambda s: F.concat(F.col(f"d.{s}.width").cast("string"), F.lit("x"), F.col(f"d.{s}.height").cast("string"))
    why = F.when(~F.coalesce("left_frames", F.lit(0)).eqNullSafe(F.coalesce("right_frames", F.lit(0))), F.concat(F.lit("the clips have "), n("left_frames"), F.lit(" and "), n("right_frames"), F.lit(" frames")))
    why = why.when(F.col("d").isNotNull(), F.concat(F.lit("frame "), F.col("d.frame").cast("string"), F.lit(" is "), says("a"), F.lit(" against "), says("b")))
    return counts.join(differ, "clip", "left").withColumn("refused", why).where("refused is not null").select("clip", "refused")


_CURVE = ["clip", "toolset"]


def prepared(points: DataFrame) -> DataFrame:
    """Finite points with ln(rate), one for each quality (the smallest rate), and refusal counts of their curve."""
    p = points.where(~F.isnan("rate") & ~F.isnan("quality") & (F.abs("rate") < float("inf")) & (F.abs("quality") < float("inf")))
    curve = Window.partitionBy(*_CURVE)
    p = p.withColumn("bad", F.count_if(F.col("rate") <= 0).over(curve))
    p = p.where("rate > 0 or bad > 0").withColumn("nth", F.row_number().over(Window.partitionBy(*_CURVE, "quality").orderBy("rate"))).where("nth = 1").drop("nth")
    return p.withColumn("points", F.count("*").over(curve)).withColumn("y", F.when(F.col("rate") > 0, F.ln("rate")))


def slopes(points: DataFrame) -> DataFrame:
    """Monotone cubic (Fritsch-Carlson) slopes of ln(rate) over quality, with each point's next one."""
    w = Window.partitionBy(*_CURVE).orderBy("quality")
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    p = prepared(points).where("bad = 0 and points >= 4")
    p = p.withColumn("h", at("quality", 1) - F.col("quality")).withColumn("d", (at("y", 1) - F.col("y")) / F.col("h"))
    p = p.select("*", at("h", -1).alias("h0"), at("d", -1).alias("d0"), at("h", 1).alias("h2"), at("d", 1).alias("d2"), at("h", -2).alias("h1"), at("d", -2).alias("d1"))
    w1, w2 = F.col("h") * 2 + F.col("h0"), F.col("h") + F.col("h0") * 2
    inner = F.when(F.col("d0") * F.col("d") <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.col("d0") + w2 / F.col("d")))

    def end(near: str, far: str, near_w: str, far_w: str) -> Column:
        n, f, nw, fw = F.col(near), F.col(far), F.col(near_w), F.col(far_w)
        e = ((nw * 2 + fw) * n - nw * f) / (nw + fw)
        return F.when(f.isNull(), n).when(e * n <= 0, 0.0).when((n * f <= 0) & (F.abs(e) > F.abs(n * 3)), n * 3).otherwise(e)

    slope = F.when(F.col("h0").isNull(), end("d", "d2", "h", "h2")).when(F.col("h").isNull(), end("d0", "d1", "h0", "h1")).otherwise(inner)
    return p.select(*_CURVE, "quality", "y", "h", slope.alias("slope"))


def _primitive(t: Column) -> Column:
    """Integral of the Hermite piece from its start to ``t`` (0 to 1), times its width."""
    t2, t3, t4 = t * t, t * t * t, t * t * t * t
    y0, y1, s0, s1, h = (F.col(c) for c in ("y", "y1", "slope", "slope1", "h"))
    return h * (y0 * (t4 / 2 - t3 + t) + h * s0 * (t4 / 4 - t3 * 2 / 3 + t2 / 2) + y1 * (t3 - t4 / 2) + h * s1 * (t4 / 4 - t3 / 3))


def bd_rate(points: DataFrame, baseline: str) -> DataFrame:
    """clip, toolset, bd_rate_percent against the ``baseline`` toolset of the same clip, or the reason there is none."""
    s = slopes(points)
    w = Window.partitionBy(*_CURVE).orderBy("quality")
    pieces = s.select("*", F.lead("y").over(w).alias("y1"), F.lead("slope").over(w).alias("slope1")).where("h is not null")
    stats = prepared(points).groupBy(*_CURVE).agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max("bad").alias("bad"), F.max("points").alias("points"))
    base = stats.where(F.col("toolset") == baseline).select("clip", *[F.col(c).alias(f"base_{c}") for c in ("low", "high", "bad", "points")])
    met = stats.where(F.col("toolset") != baseline).join(base, "clip", "left")
    met = met.withColumn("a", F.greatest("low", "base_low")).withColumn("b", F.least("high", "base_high"))
    sides = met.select("clip", "toolset", "a", "b", F.explode(F.array(F.col("toolset"), F.lit(baseline))).alias("side"))
    p = pieces.withColumnRenamed("toolset", "side")
    inside = sides.join(p, ["clip", "side"])
    unit = lambda x: (x - F.col("quality")) / F.col("h")
    start, stop = F.greatest("quality", "a"), F.least(F.col("quality") + F.col("h"), F.col("b"))
    area = F.when(stop > start, _primitive(unit(stop)) - _primitive(unit(start))).otherwise(0.0)
    total = inside.groupBy("clip", "toolset").agg(F.sum(F.when(F.col("side") == baseline, -area).otherwise(area)).alias("area"))
    refused = (
        F.when(F.col("base_points").isNull(), "no_baseline").when((F.col("bad") > 0) | (F.col("base_bad") > 0), "non_positive_rate")
        .when((F.col("points") < 4) | (F.col("base_points") < 4), "too_few_points").when(~(F.col("b") > F.col("a")), "no_overlap")
    )
    out = met.join(total, ["clip", "toolset"], "left").withColumn("refused", refused)
    return out.select("clip", "toolset", F.when(F.col("refused").isNull(), (F.exp(F.col("area") / (F.col("b") - F.col("a"))) - 1) * 100).alias("bd_rate_percent"), "refused")


def rate_errors(frames: DataFrame, bits_per_second: int, fps_num: int = 25, fps_den: int = 1) -> DataFrame:
    """stream_id, frames, achieved bits per second and its error against the target, in percent."""
    g = frames.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("bits").alias("bits"))
    achieved = F.col("bits") * fps_num / (F.col("frames") * fps_den)
    error = (achieved - bits_per_second) / bits_per_second * 100
    return g.select("stream_id", "frames", achieved.alias("achieved_bps"), error.alias("error_percent"), (F.abs(error) <= C.ABR_TOLERANCE_PERCENT).alias("within"))
