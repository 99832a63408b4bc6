"""Command line: clips to streams and back, what a stream holds, and how two clips differ.

    python -m framelake enc  CLIPS.y4m OUT --qp 32 [--tools full] [--bitrate BPS]
    python -m framelake dec  STREAMS   OUT
    python -m framelake probe STREAMS
    python -m framelake metric psnr|ssim REFERENCE.y4m DISTORTED.y4m

Clips are files (or folders of files) that Spark can read; streams are Parquet
tables of (stream_id, data).  Files of one argument are taken in the order of
their names.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import decoding, encoding, verification
from .plans import constants as C
from .sources import packets as PK
from .sources import y4m


def _clips(spark: SparkSession, path: str) -> DataFrame:
    frames = y4m.read(spark, path)
    names = frames.select("clip").distinct().withColumn("stream_id", F.row_number().over(Window.orderBy("clip")).cast("bigint"))
    return frames.join(names, "clip")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    enc = verbs.add_parser("enc")
    enc.add_argument("clips")
    enc.add_argument("out")
    enc.add_argument("--qp", type=int, default=32)
    enc.add_argument("--bitrate", type=int)
    enc.add_argument("--tools", choices=list(C.TOOLSETS), default="full")
    enc.add_argument("--keyframe-interval", type=int, default=C.KEY_INTERVAL)
    enc.add_argument("--golden-interval", type=int, default=C.GOLDEN_INTERVAL)
    dec = verbs.add_parser("dec")
    dec.add_argument("streams")
    dec.add_argument("out")
    verbs.add_parser("probe").add_argument("streams")
    metric = verbs.add_parser("metric")
    metric.add_argument("metric", choices=["psnr", "ssim"])
    metric.add_argument("reference")
    metric.add_argument("distorted")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("framelake").getOrCreate()
    if a.verb == "enc":
        clips = _clips(spark, a.clips)
        if a.bitrate:
            rate = clips.select("fps_num", "fps_den").first()
            coded = encoding.encode_to_rate(clips, a.bitrate, rate["fps_num"], rate["fps_den"], a.tools, a.keyframe_interval, a.golden_interval)
        else:
            coded = encoding.encode(clips, a.qp, a.tools, a.keyframe_interval, a.golden_interval)
        encoding.streams(coded, key_interval=a.keyframe_interval, golden_interval=a.golden_interval).write.parquet(a.out)
    elif a.verb == "dec":
        decoding.decode(PK.payloads(spark.read.parquet(a.streams))).write.parquet(a.out)
    elif a.verb == "probe":
        lines = verification.probe_lines(decoding.probe_blocks(decoding.probe(PK.payloads(spark.read.parquet(a.streams)))))
        for r in lines.orderBy("stream_id", "frame_index", "y", "x").select("stream_id", "frame_index", "line").toLocalIterator():
            print(r["stream_id"], r["frame_index"], r["line"])
    else:
        named = lambda path: y4m.read(spark, path).withColumn("clip", F.lit("clip"))
        reports = verification.quality_reports(named(a.reference), named(a.distorted), a.metric)
        for r in reports.select("report", verification.report_line(F.col("report")).alias("line")).collect():
            print(r["report"])
            print(r["line"])


if __name__ == "__main__":
    main()
