"""Coverage sets, receipts and block reports: accounting over measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import constants as C


def coverage(seen: DataFrame, capacity: int = C.CONTEXTS) -> DataFrame:
    """stream_id, recorded, complete, missing: which of ``capacity`` ids (column id) each stream has used."""
    every = F.sequence(F.lit(0), F.lit(capacity - 1))
    g = seen.where((F.col("id") >= 0) & (F.col("id") < capacity)).groupBy("stream_id").agg(F.collect_set(F.col("id").cast("int")).alias("ids"))
    missing = F.array_except(every, "ids")
    return g.select("stream_id", F.size("ids").cast("bigint").alias("recorded"), (F.size("ids") == capacity).alias("complete"), F.concat_ws(",", F.transform(missing, lambda x: x.cast("string"))).alias("missing"))


def total_coverage(seen: DataFrame, capacity: int = C.CONTEXTS) -> DataFrame:
    """recorded, missing of all streams together: the union of their sets."""
    return seen.where((F.col("id") >= 0) & (F.col("id") < capacity)).agg(F.count_distinct("id").alias("recorded")).select("recorded", (F.lit(capacity) - F.col("recorded")).alias("missing"))


def receipt_diff(fresh: DataFrame, recorded: DataFrame, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Fresh measurements that the recorded ones lack or contradict; what only the record has is ignored."""
    r = recorded.select(*key, F.col(value).alias("recorded"), F.lit(True).alias("there"))
    d = fresh.select(*key, F.col(value).alias("fresh")).join(r, key, "left")
    close = F.col("fresh").eqNullSafe(F.col("recorded")) | (F.abs(F.col("fresh") - F.col("recorded")) <= F.greatest(F.abs("fresh"), F.abs("recorded")) * tolerance)
    return d.where(F.col("there").isNull() | ~F.coalesce(close, F.lit(False))).select(*key, "fresh", "recorded", F.when(F.col("there").isNull(), "absent").otherwise("unequal").alias("why"))


def regressions(now: DataFrame, before: DataFrame, allowance: float = C.BD_ALLOWANCE_PERCENT) -> DataFrame:
    """clip, change (percent of rate) and verdict of ``now`` against ``before``; an unmatched clip is reported."""
    j = now.select("clip", F.col("rate").alias("now")).join(before.select("clip", F.col("rate").alias("before")), "clip", "left")
    change = (F.col("now") / F.col("before") - 1) * 100
    return j.select("clip", change.alias("change"), F.when(F.col("before").isNull(), "unmatched").when(change > allowance, "regressed").otherwise("ok").alias("verdict"))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of the two has, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def coding_order(x: Column, y: Column) -> Column:
    """A number that rises with the order in which blocks are coded: superblocks by rows, inside them quarter by quarter."""
    bit = lambda c, k: F.floor(c / (C.CELL << k)).cast("bigint") % 2
    inside = sum((bit(x, k) * (1 << 2 * k) + bit(y, k) * (2 << 2 * k) for k in range(3)), F.lit(0).cast("bigint"))
    return (F.floor(y / C.SUPERBLOCK) * (1 << 20) + F.floor(x / C.SUPERBLOCK)) * 64 + inside


def worst_block(blocks: DataFrame) -> DataFrame:
    """The block of each frame with the most error per modelled bit; clean blocks are left out, the first coded wins ties."""
    b = blocks.where("sse > 0").withColumn("score", F.col("sse") / F.col("n") / F.greatest(F.lit(1.0), F.col("cost_q16") / 65536.0))
    first = F.max_by(F.struct("x", "y", "score"), F.struct("score", -coding_order(F.col("x"), F.col("y"))))
    return b.groupBy("frame").agg(first.alias("b")).select("frame", "b.*")


def heat(blocks: DataFrame, value: str) -> DataFrame:
    """Every block's value as a share of the largest in its frame."""
    peak = F.max(value).over(Window.partitionBy("frame"))
    return blocks.select("frame", "x", "y", F.when(peak > 0, F.col(value) / peak).otherwise(0.0).alias("share"))


def reconcile(blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, parts, total, agrees: bytes of blocks, structure and flush against the payload's length."""
    g = blocks.groupBy("frame").agg(F.sum("emitted").alias("emitted"))
    j = frames.join(g, "frame", "left").withColumn("parts", F.coalesce("emitted", F.lit(0)) + F.col("structure") + F.col("flush"))
    return j.select("frame", "parts", F.col("payload_len").alias("total"), (F.col("parts") == F.col("payload_len")).alias("agrees"))
