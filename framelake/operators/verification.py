"""Measurements as reports, and the checks that hold streams and reports to what they say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import numeric as N
from ..plans import constants as C
from ..sources import packets as PK
from ..sources import reports as R
from ..sources import synthetic
from . import decoding, quality
from .recovery import has_image

# -- streams --------------------------------------------------------------------


def seek_equivalence(packets: DataFrame) -> DataFrame:
    """stream_id, frame_index, entry, decoded, same: for every frame, whether seeking to it shows what decoding from the start does.

    Each frame's seek is a group of its own (its keyframe up to it), as a seek
    shares nothing with another; the work is that of all seeks.
    """
    groups = decoding.grouped(packets)
    targets = groups.where("gop > 0").select("stream_id", "gop", F.col("pos").alias("upto"), F.col("frame_index").alias("target"))
    alone = groups.join(targets.hint("merge"), ["stream_id", "gop"]).where("pos <= upto")
    key = F.xxhash64("gop", "upto")
    alone = alone.withColumn("gop", key).withColumn("expected", F.when(F.col("key"), F.col("frame_index")).otherwise(F.col("expected")))
    sought = decoding.pictures_of(alone.select(*groups.columns))
    upto = alone.groupBy("stream_id", "gop").agg(F.max("pos").alias("pos"), F.min("frame_index").alias("entry"), F.count("*").alias("decoded"))
    # the last picture of each seek; several seeks show the earlier ones as well
    shown = sought.where(has_image(F.col("status"))).groupBy("stream_id", "pos").agg(F.min(F.sha2("y", 256)).alias("low"), F.max(F.sha2("y", 256)).alias("high"))
    linear = decoding.decode(packets).where(has_image(F.col("status"))).select("stream_id", "pos", "frame_index", F.sha2("y", 256).alias("linear"))
    out = linear.join(shown.hint("merge"), ["stream_id", "pos"]).join(upto.hint("merge"), ["stream_id", "pos"])
    return out.select("stream_id", "frame_index", "entry", "decoded", ((F.col("low") == F.col("linear")) & (F.col("high") == F.col("linear"))).alias("same"))


def damage_outcomes(streams: DataFrame, target: str, seed: int = 0) -> DataFrame:
    """stream_id and outcome of streams after damage: decoded, or refused with its first fault; no damage is an error of the decoder."""
    packets = PK.payloads(synthetic.damaged(streams, target, seed), bad_headers=True)
    sound, refused = decoding.decode_strict(packets)
    whole = sound.select("stream_id").distinct().select("stream_id", F.lit("decoded").alias("outcome"), F.lit(None).cast("string").alias("element"))
    faults = refused.select("stream_id", F.lit("refused").alias("outcome"), "element")
    empty = streams.select("stream_id").join(whole.select("stream_id").unionByName(faults.select("stream_id")), "stream_id", "left_anti")
    return whole.unionByName(faults).unionByName(empty.select("stream_id", F.lit("refused").alias("outcome"), F.lit("initial_keyframe").alias("element")))


def uncovered(met: DataFrame, name: str, required: list) -> DataFrame:
    """The required contexts or elements (column ``name``) that nothing in ``met`` has coded."""
    spark = met.sparkSession
    return spark.createDataFrame([(x,) for x in required], f"{name} {dict(met.dtypes)[name]}").join(met.select(name), name, "left_anti")


# -- quality reports ---------------------------------------------------------------


def _errors(reference: DataFrame, distorted: DataFrame) -> DataFrame:
    """clip, frame, n, sse: squared luma error of every pair of frames."""
    pairs = reference.select("clip", "frame", F.col("y").alias("a")).hint("merge").join(distorted.select("clip", "frame", F.col("y").alias("b")), ["clip", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            sse = [int(((np.frombuffer(x, np.uint8).astype(np.int64) - np.frombuffer(z, np.uint8)) ** 2).sum()) for x, z in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in a], pa.int64()), pa.array(sse, pa.int64())], names=["clip", "frame", "n", "sse"])

    return pairs.mapInArrow(B.lean(run), "clip string, frame bigint, n bigint, sse bigint")


def _similarity(reference: DataFrame, distorted: DataFrame) -> DataFrame:
    """clip, frame, n, ssim of every pair of frames."""
    pairs = reference.select("clip", "frame", "width", "height", F.col("y").alias("a")).hint("merge").join(distorted.select("clip", "frame", F.col("y").alias("b")), ["clip", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                planes = [np.frombuffer(p, np.uint8).reshape(1, h, w).astype(float) for p in (a, b)]
                out.append(float(quality.ssim_map(*planes).mean()))
            n = [w * h for w, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(out, pa.float64())], names=["clip", "frame", "n", "ssim"])

    return pairs.mapInArrow(B.lean(run), "clip string, frame bigint, n bigint, ssim double")


def measured(reference: DataFrame, distorted: DataFrame, metric: str) -> DataFrame:
    """clip, frames, lossless, global and per_frame of clips (clip, frame, width, height, y) by ``psnr`` or ``ssim``.

    Clips that do not pair up are an error that says why.
    """
    bad = quality.check_pair(reference, distorted).orderBy("clip").head()
    if bad is not None:
        raise quality.ClipsDiffer(f"{bad['clip']}: {bad['refused']}")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("frame", c.alias("v")))), lambda x: x["v"])
    if metric == "psnr":
        e = _errors(reference, distorted)
        g = e.groupBy("clip").agg(F.count("*").alias("frames"), F.sum("sse").alias("sse"), F.sum("n").alias("n"), in_order(N.decibels(F.col("sse"), F.col("n"))).alias("per_frame"))
        return g.select("clip", "frames", (F.col("sse") == 0).alias("lossless"), N.decibels(F.col("sse"), F.col("n")).alias("global"), "per_frame")
    if metric != "ssim":
        raise ValueError(f"{metric} is not a metric")
    e = _similarity(reference, distorted)
    g = e.groupBy("clip").agg(F.count("*").alias("frames"), (F.sum(F.col("ssim") * F.col("n")) / F.sum("n")).alias("global"), in_order(F.col("ssim")).alias("per_frame"))
    return g.select("clip", "frames", (F.col("global") == 1.0).alias("lossless"), "global", "per_frame")


def content_hashes(clips: DataFrame) -> DataFrame:
    """clip and the hash of its frames' luma in order: a name that survives a move."""
    frames = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.sha2("y", 256).alias("h")))), lambda x: x["h"]), "\n")
    return clips.groupBy("clip").agg(F.sha2(frames, 256).alias("sha256"))


def quality_reports(reference: DataFrame, distorted: DataFrame, metric: str) -> DataFrame:
    """clip and its report as JSON; ``config_sha256`` covers what the numbers hang on: the metric and both contents."""
    m = measured(reference, distorted, metric)
    m = m.join(content_hashes(reference).withColumnRenamed("sha256", "a"), "clip").join(content_hashes(distorted).withColumnRenamed("sha256", "b"), "clip")
    config = F.sha2(F.concat_ws("\n", F.lit(metric), "a", "b"), 256)
    body = F.struct(F.lit(f"{metric}-y").alias("metric"), config.alias("config_sha256"), F.col("a").alias("reference_sha256"), F.col("b").alias("distorted_sha256"), "frames", "lossless", "global", "per_frame")
    return m.select("clip", R.compact(body).alias("report"))


def moved_fields(recorded: DataFrame, fresh: DataFrame, key: str = "clip") -> DataFrame:
    """key, field, recorded, fresh: every field of fresh reports (key, report) that the recorded one lacks or contradicts."""
    fields = lambda df, name: df.select(key, F.explode(F.from_json("report", "map<string,string>")).alias("field", name))
    j = fields(fresh, "fresh").join(fields(recorded, "recorded"), [key, "field"], "left")
    return j.where(~F.col("fresh").eqNullSafe(F.col("recorded"))).select(key, "field", "recorded", "fresh")


def report_line(report: Column) -> Column:
    """A quality report or a rate difference (JSON) as a line to read; null for anything else."""
    at = lambda f: F.get_json_object(report, f"$.{f}")
    figure = F.when(at("global").isNull(), F.lit("lossless")).otherwise(F.format_string("%.4f", at("global").cast("double")))
    unit = F.when(at("metric") == "psnr-y", F.lit(" dB")).otherwise("")
    picture = F.concat(F.upper(at("metric")), F.lit("  "), figure, unit, F.lit(" over "), at("frames"), F.lit(" frames"))
    rate = F.format_string("BD-rate  %+.4f%% bitrate at equal quality, over %s and %s points", at("bd_rate_percent").cast("double"), at("baseline_points"), at("candidate_points"))
    return F.when(at("metric").isin("psnr-y", "ssim-y"), picture).when(at("metric") == "bd-rate", rate)


# -- probes to read --------------------------------------------------------------


def modelled_bits(cost_q16: Column) -> Column:
    """1/65536 bits as a number of two places, in whole numbers throughout."""
    hundredths = F.shiftright(F.pmod(cost_q16, F.lit(65536)) * 100 + 32768, 16)
    whole = F.shiftright(cost_q16, 16) + F.when(hundredths == 100, 1).otherwise(0)
    return F.format_string("%d.%02d", whole, F.pmod(hundredths, F.lit(100)))


def probe_lines(blocks: DataFrame) -> DataFrame:
    """Blocks of ``decoding.probe_blocks`` with ``line``: a bar as long as the block is wide, its place and what predicted it."""
    said = F.when(F.col("kind") == "intra", F.concat(F.lit("intra "), "mode")).when(F.col("kind") == "skip", F.concat(F.lit("skip "), "reference"))
    said = said.otherwise(F.concat(F.lit("inter "), F.col("reference"), F.lit(" mv ["), F.col("mv_x").cast("string"), F.lit(", "), F.col("mv_y").cast("string"), F.lit("]")))
    line = F.format_string("%-8s %2dx%-2d at (%3d,%3d)  %s  modelled %s bits", F.expr("repeat('#', greatest(1, size div 8))"), "size", "size", "x", "y", said, modelled_bits(F.col("modeled_entropy_q16")))
    return blocks.where("kind <> 'structure'").withColumn("line", line)


PROBE_RULES = {
    "probe_version": "r.probe_version = 1", "bitstream_version": "r.stream.bitstream_version = 1", "chroma": "r.stream.chroma = '420jpeg'", "depth": "r.stream.depth = 8", "qp": f"r.frame.qp between 0 and {C.QP_MAX}",
    "show": "r.frame.flags.show", "golden_refresh": "r.frame.flags.golden_refresh or not r.frame.flags.key", "payload": f"r.frame.input_payload_len between {C.PAYLOAD_BYTES[0]} and {C.PAYLOAD_BYTES[1]}",
    "mismatch": "r.frame.canonical_payload_match = (r.frame.first_mismatch_offset is null)", "superblocks": "size(r.frame.superblocks) > 0 and forall(r.frame.superblocks, s -> s.size = 64 and s.pos[0] % 64 = 0 and s.pos[1] % 64 = 0)",
    "blocks": "forall(flatten(r.frame.superblocks.cbs), b -> b.size in (8, 16, 32, 64) and b.prediction.kind in ('intra', 'skip', 'inter') and (b.prediction.kind = 'intra') = (b.prediction.reference is null) and (b.prediction.kind = 'inter') = (b.prediction.mv_q4 is not null))",
}


def probe_faults(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` whose probe report breaks a rule, with ``broken``, the names of those rules; a sound report gives no row."""
    r = documents.withColumn("r", F.from_json(text, R.PROBE))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in PROBE_RULES.items()]))
    return r.withColumn("broken", broken).where(F.size("broken") > 0).drop("r")


# -- receipts of encodes --------------------------------------------------------------


def receipts(coded: DataFrame, sources: DataFrame, settings: dict[str, object]) -> DataFrame:
    """stream_id and a JSON receipt of what ``encoding.encode`` returned: content hashes, settings, and every frame's packet and PSNR."""
    clip = lambda df: df.select(F.col("stream_id").cast("string").alias("clip"), "frame", "width", "height", "y")
    e = _errors(clip(sources), clip(coded)).select(F.col("clip").cast("bigint").alias("stream_id"), "frame", N.decibels(F.col("sse"), F.col("n")).alias("psnr_y"))
    rows = coded.join(e, ["stream_id", "frame"])
    frame = F.struct(F.col("frame").alias("frame_index"), "key", F.col("golden").alias("golden_refresh"), "qp", "payload_len", "psnr_y")
    stream = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.sha2("packet", 256).alias("h")))), lambda x: x["h"]), "\n")
    g = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"), F.sum(F.octet_length("packet")).alias("bytes"), F.sha2(stream, 256).alias("packets_sha256"), F.first("width").alias("width"), F.first("height").alias("height"))
    hashes = content_hashes(clip(sources)).select(F.col("clip").cast("bigint").alias("stream_id"), F.col("sha256").alias("source_sha256"))
    said = F.struct("width", "height", F.size("frames").alias("frames"), *[F.lit(v).alias(k) for k, v in settings.items()])
    body = F.struct("source_sha256", "packets_sha256", (F.col("bytes") + C.HEADER_BYTES).alias("bytes"), said.alias("settings"), "frames")
    return g.join(hashes, "stream_id").select("stream_id", R.compact(body).alias("receipt"))
