"""Views that give the operators inputs from the driver's tables; they only reshape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, pos, frame_index, key, crc_bad, dec_bad, bits: one row per packet."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    skip = (F.col("event_id") % 17 == 0).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        (F.row_number().over(w) - 1 + F.sum(skip).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("bigint").alias("frame_index"),
        (F.col("event_type") == "signup").alias("key"), (F.col("event_type") == "error").alias("crc_bad"), (F.col("event_id") % 29 == 0).alias("dec_bad"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bits"),
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame, sad: picture change of every frame after the first."""
    return packets(spark, sf_dir).select("stream_id", F.col("pos").alias("frame"), F.col("bits").alias("sad"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id and 64 samples, row by row."""
    v = F.transform("embedding", lambda e: N.clamp_sample(F.floor(e.cast("double") * 128 + 128)).cast("int"))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("block_id"), v.alias("v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, y, x, v."""
    e = blocks(spark, sf_dir).select("block_id", F.posexplode("v").alias("i", "v"))
    return e.select("block_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, ref, dist: a block and the next one, 64 samples each."""
    b = blocks(spark, sf_dir)
    return b.select(F.col("block_id").alias("frame"), F.col("v").alias("ref")).join(b.select((F.col("block_id") - 1).alias("frame"), F.col("v").alias("dist")), "frame")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, toolset, rate, quality: one point per quantity step."""
    li = table(spark, sf_dir, "lineitem")
    q = F.floor(F.col("l_quantity") / 9)
    g = li.groupBy(F.col("l_returnflag").alias("clip"), F.col("l_linestatus").alias("toolset"), q.alias("q")).agg(F.count("*").alias("n"))
    return g.select("clip", "toolset", (F.pow(F.lit(1.5), F.col("q").cast("double")) * F.sqrt(F.col("n").cast("double"))).alias("rate"), (F.lit(28.0) + F.col("q") * 2.5 + (F.col("n") % 7) * 0.1).alias("quality"))


def motion_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, size, ref, mv_x, mv_y: one 8-pixel block of a motion field per row, 16 in a line; ref is null where intra.

    32 orders in a row make a frame, so frames grow with the table and every row keeps a place of its own.
    """
    li = table(spark, sf_dir, "lineitem")
    frame = F.floor(F.col("l_orderkey") / 32)
    nth = F.row_number().over(Window.partitionBy(frame).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) - 1
    ref = F.when(F.col("l_partkey") % 5 != 0, F.when(F.col("l_partkey") % 3 == 0, "golden").otherwise("last"))
    return li.select(frame.alias("frame"), nth.alias("nth"), ref.alias("ref"), (F.col("l_partkey") % 65 - 32).alias("mv_x"), (F.col("l_suppkey") % 33 - 16).alias("mv_y")).select(
        "frame", (F.col("nth") % 16 * 8).cast("bigint").alias("x"), (F.floor(F.col("nth") / 16) * 8).cast("bigint").alias("y"), F.lit(8).alias("size"), "ref", "mv_x", "mv_y"
    )


def leaf_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, size, x, y, cost: cost of coding each square of a 64-pixel block whole; all sizes are summed in one pass."""
    base = samples(spark, sf_dir).select(F.col("block_id").alias("frame"), (F.col("x") * 8).alias("x"), (F.col("y") * 8).alias("y"), F.col("v").cast("bigint").alias("v"))
    cut = lambda c, size: (F.floor(F.col(c) / size) * size).cast("int")
    square = F.explode(F.array(*[F.struct(F.lit(size).alias("size"), cut("x", size).alias("x"), cut("y", size).alias("y")) for size in (8, 16, 32, 64)]))
    g = base.select("frame", "v", square.alias("s")).groupBy("frame", "s.size", "s.x", "s.y").agg(F.sum(F.col("v") * F.col("v")).alias("s2"), F.sum("v").alias("s"), F.count("*").alias("n"))
    return g.select("frame", "size", "x", "y", (F.col("s2") - F.floor(F.col("s") * F.col("s") / F.col("n")) + 900).cast("bigint").alias("cost"))
