"""Packets of damaged streams: random access, gaps, recovery and the display timeline.

All of it is ordered windows over one stream; a packet's fate follows from the
last break before it and the last good keyframe up to it, so no state is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans import constants as C



def _order() -> WindowSpec:
    return Window.partitionBy("stream_id").orderBy("pos")


def _past() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _so_far() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def seek_entries(packets: DataFrame) -> DataFrame:
    """The keyframe that decoding of each frame must start from, and the frames that costs."""
    entry = F.last(F.when(F.col("key"), F.col("frame_index")), ignorenulls=True).over(_so_far())
    return packets.select("stream_id", "frame_index", entry.alias("entry")).withColumn("cost", F.col("frame_index") - F.col("entry") + 1)


def seek(packets: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (stream_id, target): the packets from its entry keyframe up to it.

    A target meets the packets of its group of pictures alone, by its number.
    """
    grouped = packets.withColumn("gop", F.sum(F.col("key").cast("bigint")).over(_so_far())).where("gop > 0")
    wanted = targets.join(grouped.select("stream_id", F.col("frame_index").alias("target"), "gop"), ["stream_id", "target"])
    return grouped.join(wanted, ["stream_id", "gop"]).where("frame_index <= target").select("stream_id", "target", "frame_index", "key")


def _expected() -> Column:
    return F.coalesce(F.lag("frame_index").over(_order()) + 1, F.lit(0))


def index_gaps(packets: DataFrame) -> DataFrame:
    """Packets whose index is not the one expected, and how many are missing before them."""
    return packets.select("stream_id", "pos", "frame_index", _expected().alias("expected")).where("frame_index <> expected").withColumn("missing", F.col("frame_index") - F.col("expected"))


def classify(packets: DataFrame) -> DataFrame:
    """status of every packet: shown, recovered_gap, recovered_leading_loss, dependency_lost or corrupt."""
    p = packets.withColumn("expected", _expected()).withColumn("gap", F.col("frame_index") != F.col("expected"))
    p = p.withColumn("brk", F.max(F.when(F.col("gap") | F.col("crc_bad") | F.col("dec_bad"), F.col("pos"))).over(_past()))
    p = p.withColumn("good", F.max(F.when(F.col("key") & ~F.col("crc_bad") & ~F.col("dec_bad"), F.col("pos"))).over(_so_far()))
    in_chain = F.col("good").isNotNull() & ~F.col("gap") & (F.col("brk").isNull() | (F.col("good") >= F.col("brk")))
    status = (
        F.when(F.col("crc_bad"), "corrupt")
        .when(F.col("key") & F.col("dec_bad"), "corrupt")
        .when(F.col("key") & F.col("gap") & (F.col("expected") == 0), "recovered_leading_loss")
        .when(F.col("key") & F.col("gap"), "recovered_gap")
        .when(F.col("key"), "shown")
        .when(~in_chain, "dependency_lost")
        .when(F.col("dec_bad"), "corrupt")
        .otherwise("shown")
    )
    return p.select("stream_id", "pos", "frame_index", status.alias("status"))


def has_image(status: Column) -> Column:
    return status.isin("shown", "recovered_gap", "recovered_leading_loss")


def status_counts(packets: DataFrame) -> DataFrame:
    return classify(packets).groupBy("status").agg(F.count("*").alias("n"), F.count_if(has_image(F.col("status"))).alias("images"))


def timeline(packets: DataFrame) -> DataFrame:
    """What is on screen at each packet: its own image or the last one before it; nothing before the first."""
    shown = F.when(has_image(F.col("status")), F.col("frame_index"))
    return classify(packets).select("stream_id", "pos", "status", F.last(shown, ignorenulls=True).over(_so_far()).alias("image")).where("image is not null")


def gops(packets: DataFrame) -> DataFrame:
    """Groups of pictures: each starts with a keyframe; packets before the first belong to none."""
    g = packets.withColumn("gop", F.sum(F.col("key").cast("bigint")).over(_so_far())).where("gop > 0")
    return g.groupBy("stream_id", "gop").agg(F.min("frame_index").alias("entry"), F.count("*").alias("frames"), F.sum("bits").alias("bits"))


def golden_refresh(packets: DataFrame, interval: int = C.GOLDEN_INTERVAL) -> DataFrame:
    """Packets that refresh the long-term reference: keyframes, and every ``interval``-th packet after one."""
    g = packets.withColumn("gop", F.sum(F.col("key").cast("bigint")).over(_so_far()))
    nth = F.row_number().over(Window.partitionBy("stream_id", "gop").orderBy("pos")) - F.when(F.col("gop") > 0, 1).otherwise(0)
    return g.select("stream_id", "pos", "key", (F.col("key") | (nth % interval == 0)).alias("golden"))


def damaged_streams(packets: DataFrame) -> DataFrame:
    """Intact and damaged packets of each stream; a stream is sound with none damaged and some intact."""
    g = packets.groupBy("stream_id").agg(F.count_if(~F.col("crc_bad")).alias("intact"), F.count_if("crc_bad").alias("damaged"))
    return g.withColumn("sound", (F.col("damaged") == 0) & (F.col("intact") > 0))
