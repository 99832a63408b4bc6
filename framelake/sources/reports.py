"""Reports and manifests as tables: JSON by schema, the corpus manifest's TOML by line.

JSON is read with declared schemas, so a document is parsed in the JVM and only
the fields asked for are kept.  A document that is no report of its kind has a
null root, and is told apart from one that holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a report's ``format`` must say.
CAMPAIGN_FORMAT = "key-frame-rd-campaign-v1"

CAMPAIGN = """format string, encoder_version string, config_sha256 string, settings struct<frames:int,keyframe_interval:int,golden_interval:int,qp_ladder:array<int>>,
curves array<struct<clip:string,toolset:string,width:int,height:int,frames:int,bd_rate_percent:string,bd_rate_refused:string,points:array<struct<qp:int,bytes:bigint,rate:double,quality:double,psnr_y:double,ssim_y:double,stream_sha256:string>>>>,
rate_control struct<clips:array<struct<clip:string,frames:int,targets:array<struct<target_bps:double,achieved_bps:double,error_percent:double,psnr_y:double>>>>>"""
_BLOCK = "struct<pos:array<int>,size:int,prediction:struct<kind:string,mode:string,reference:string,mv_q4:array<int>>,qp:int,modeled_entropy_q16:bigint,emitted_payload_bytes:bigint,dc_energy:bigint>"
PROBE = f"""probe_version int, stream struct<bitstream_version:int,width:int,height:int,chroma:string,depth:int>,
frame struct<frame_index:bigint,flags:struct<key:boolean,golden_refresh:boolean,show:boolean>,qp:int,input_payload_len:bigint,canonical_replay_payload_len:bigint,canonical_payload_match:boolean,first_mismatch_offset:bigint,frame_flush_bytes:bigint,
superblocks:array<struct<pos:array<int>,size:int,structure_modeled_entropy_q16:bigint,structure_emitted_payload_bytes:bigint,cbs:array<{_BLOCK}>>>>"""
POINTS = "array<struct<rate:double,quality:double>>"


class ReportError(ValueError):
    """A document that is not what it should be."""


def _finite(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), n)


def campaigns(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``report``, the campaign, and ``refused``, why it is none: not JSON, another format, or without curves."""
    r = documents.withColumn("report", F.from_json(text, CAMPAIGN))
    why = F.when(F.coalesce(F.col("report.format"), F.lit("")) != CAMPAIGN_FORMAT, "not a campaign report").when(F.col("report.curves").isNull(), "no curves").when(F.exists("report.curves", lambda c: c["points"].isNull()), "a curve without points")
    return r.withColumn("refused", why)


def curves(reports: DataFrame, *keys: str) -> DataFrame:
    """One row for each curve: its order, clip, toolset, size, and the recorded rate difference or why there is none."""
    c = reports.where("refused is null").select(*keys, F.posexplode("report.curves").alias("nth", "c"))
    percent = _finite(F.col("c.bd_rate_percent"))
    bad = F.col("c.bd_rate_percent").isNotNull() & percent.isNull()
    return c.select(
        *keys, "nth", F.coalesce("c.clip", F.lit("unnamed")).alias("clip"), F.coalesce("c.toolset", F.lit("unnamed")).alias("toolset"), F.coalesce("c.width", F.lit(0)).alias("width"), F.coalesce("c.height", F.lit(0)).alias("height"),
        F.coalesce("c.frames", F.lit(0)).alias("frames"), F.when(bad, F.raise_error(F.lit("a curve records a rate difference that is not a number"))).otherwise(percent).alias("bd_rate_percent"),
        F.when(F.col("c.bd_rate_percent").isNull(), F.col("c.bd_rate_refused")).alias("bd_rate_refused"), F.col("c.points").alias("points"),
    )


def curve_points(curve_rows: DataFrame, *keys: str) -> DataFrame:
    return curve_rows.select(*keys, "clip", "toolset", F.explode("points").alias("p")).select(*keys, "clip", "toolset", "p.*")


def rate_targets(reports: DataFrame, *keys: str) -> DataFrame:
    """One row for each average-bitrate target of a report; a report without any gives none."""
    c = reports.where("refused is null").select(*keys, F.explode("report.rate_control.clips").alias("c"))
    c = c.select(*keys, F.coalesce("c.clip", F.lit("unnamed")).alias("clip"), F.coalesce("c.frames", F.lit(0)).alias("frames"), F.explode("c.targets").alias("t"))
    return c.select(*keys, "clip", "frames", "t.*")


def clips_of(curve_rows: DataFrame, *keys: str) -> DataFrame:
    """Every clip once, with the place where it first stands."""
    return curve_rows.groupBy(*keys, "clip").agg(F.min("nth").alias("first"))


def curve_files(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``points`` of a bare array or of an object's ``points``, and ``refused``: no points, or the first without both numbers."""
    bare = F.from_json(text, POINTS)
    inside = F.from_json(F.get_json_object(text, "$.points"), POINTS)
    points = F.when(F.ltrim(F.col(text)).startswith("["), bare).otherwise(inside)
    d = documents.withColumn("points", points)
    at = F.array_position(F.transform("points", lambda p: p["rate"].isNull() | p["quality"].isNull()), True)
    why = F.when(F.col("points").isNull() | (F.size("points") == 0), "no points").when(at > 0, F.concat(F.lit("point "), (at - 1).cast("string"), F.lit(" lacks a number")))
    return d.withColumn("refused", why)


def probe_blocks(documents: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Blocks of probe reports: frame_index, superblock, place, size, prediction and costs."""
    r = documents.select(*keys, F.from_json(text, PROBE).alias("r")).where("r.probe_version = 1")
    s = r.select(*keys, F.col("r.frame.frame_index").alias("frame_index"), F.posexplode("r.frame.superblocks").alias("superblock", "s"))
    b = s.select(*keys, "frame_index", "superblock", F.explode("s.cbs").alias("b"))
    return b.select(*keys, "frame_index", "superblock", F.get("b.pos", F.lit(0)).alias("x"), F.get("b.pos", F.lit(1)).alias("y"), "b.size", "b.prediction.*", "b.qp", "b.modeled_entropy_q16", "b.emitted_payload_bytes", "b.dc_energy")


def block_at(blocks: DataFrame, points: DataFrame, *keys: str) -> DataFrame:
    """For each point (keys, px, py) the block that covers it, by an equi-join on 8-pixel cells."""
    step = F.sequence(F.lit(0), F.col("size") - 8, F.lit(8))
    c = blocks.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    c = c.withColumns({"cell_x": F.floor((F.col("x") + F.col("dx")) / 8), "cell_y": F.floor((F.col("y") + F.col("dy")) / 8)}).drop("dx", "dy")
    p = points.withColumns({"cell_x": F.floor(F.col("px") / 8), "cell_y": F.floor(F.col("py") / 8)})
    return p.join(c, [*keys, "cell_x", "cell_y"]).drop("cell_x", "cell_y")


def pinned_clips(lines: DataFrame) -> DataFrame:
    """name, file, width, height, frames and ``missing`` (the first field that is not there) of each ``[[clips]]`` of a manifest.

    ``lines`` holds (file, n, line); another table's header ends a clip.  A value
    is quoted text or a bare number, and ``#`` outside quotes begins a comment.
    """
    line = F.trim("line")
    w = Window.partitionBy("path").orderBy("n")
    opens, header = line == "[[clips]]", line.startswith("[")
    t = lines.withColumns({"line": line, "opens": opens.cast("int"), "part": F.sum(header.cast("int")).over(w)})
    clip = F.max("opens").over(Window.partitionBy("path", "part"))
    raw = F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    value = F.when(raw.startswith('"'), F.regexp_extract(raw, r'^"([^"]*)', 1)).otherwise(F.rtrim(F.regexp_extract(raw, r"^([^#]*)", 1)))
    t = t.withColumn("clip", clip).where("clip = 1").withColumns({"field": F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)), "value": value})
    field = lambda name: F.max_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("n"))).alias(name)
    got = t.groupBy("path", "part").agg(*[field(n) for n in ("name", "file", "width", "height", "frames")], F.min("n").alias("at"))
    bad = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("name", "file", "width", "height", "frames")])
    number = lambda n: F.col(n).try_cast("int").alias(n)
    return got.select("path", "at", "name", "file", number("width"), number("height"), number("frames"), bad.alias("missing"))


def compact(c: Column) -> Column:
    """JSON of a struct on one line; numbers that are not finite become null."""
    return F.regexp_replace(F.to_json(c), r':"(NaN|-?Infinity)"', ":null")
