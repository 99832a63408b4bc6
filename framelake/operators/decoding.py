"""Streams to pictures: resilient and strict decoding, seeking, probing, coverage.

The unit of work is a group of pictures: a keyframe needs nothing before it, so
packets are dealt by (stream, group), sorted, and walked with one group's state
in hand.  A long stream is as many tasks as it has keyframes, and no task holds
more than two pictures of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import batches as B
from ..functions import codec as K
from ..functions import pictures as P
from ..functions.payload import SyntaxFault
from ..plans import constants as C
from .recovery import has_image

PICTURE = "stream_id bigint, pos bigint, frame_index bigint, key boolean, status string, width int, height int, y binary, cb binary, cr binary"
_NEEDS = ("stream_id", "gop", "pos", "event", "frame_index", "expected", "key", "golden", "qp", "width", "height", "payload")


def grouped(packets: DataFrame) -> DataFrame:
    """Packets with ``gop`` (sound keyframes so far; 0 before the first) and ``expected`` (the index due)."""
    w = Window.partitionBy("stream_id").orderBy("pos")
    sound_key = (F.col("key") & (F.col("event") == "packet")).cast("bigint")
    gop = F.sum(sound_key).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return packets.withColumns({"gop": gop, "expected": F.coalesce(F.lag("frame_index").over(w) + 1, F.lit(0))})


def _walked(groups: DataFrame, step: Callable[[K.State, dict], Iterator[tuple] | None], schema: str) -> DataFrame:
    """Rows that ``step`` gives for each packet, with the state of its group."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: B.Batches) -> Iterator[tuple]:
        at, state = None, K.State()
        for b in batches:
            for row in b.to_pylist():
                if (row["stream_id"], row["gop"]) != at:
                    at, state = (row["stream_id"], row["gop"]), K.State()
                yield from step(state, row)

    return B.spread(groups.select(*_NEEDS), "stream_id", "gop").sortWithinPartitions("stream_id", "gop", "pos").mapInArrow(B.lean(lambda batches: B.packed(walk(batches), target)), schema)


def decode_packet(state: K.State, row: dict) -> tuple[str, K.Decoded | None]:
    """A packet's fate and its picture; the state moves on only with a whole picture."""
    recovered = None
    if row["frame_index"] != row["expected"]:
        state.forget()
        recovered = "recovered_leading_loss" if row["expected"] == 0 else "recovered_gap"
    if row["event"] != "packet":
        state.forget()
        return "corrupt", None
    if not row["key"] and not state.ready:
        state.forget()
        return "dependency_lost", None
    try:
        got = K.decode_payload(row["width"], row["height"], row["payload"], row["qp"], row["key"], state)
    except (K.CodecFault, SyntaxFault):
        state.forget()
        return "corrupt", None
    state.install(got.picture, row["key"] or row["golden"], got.port.contexts)
    return recovered if recovered and row["key"] else "shown", got


def _shown(state: K.State, row: dict) -> Iterator[tuple]:
    status, got = decode_packet(state, row)
    planes = [p.tobytes() for p in P.crop(got.picture, row["width"], row["height"])] if got else [None] * 3
    yield (row["stream_id"], row["pos"], row["frame_index"], row["key"], status, row["width"], row["height"], *planes)


def pictures_of(groups: DataFrame) -> DataFrame:
    """status and picture of every packet of ``groups``, each group (stream_id, gop) from a fresh state."""
    return _walked(groups, _shown, PICTURE)


def decode(packets: DataFrame) -> DataFrame:
    """status and picture (visible part; null where there is none) of every packet of damaged or sound streams."""
    return pictures_of(grouped(packets))


def faults(decoded: DataFrame, packets: DataFrame) -> DataFrame:
    """stream_id, pos and element of the first fault for which a strict decoder refuses a stream.

    A bad stream header, a gap of indices, a damaged or truncated packet, bytes between packets, a
    first packet that is no keyframe, or a payload that breaks the syntax.
    """
    w = Window.partitionBy("stream_id").orderBy("pos")
    due = F.coalesce(F.lag(F.col("offset") + C.HEADER_BYTES + F.col("payload_len")).over(w), F.lit(C.HEADER_BYTES).cast("bigint"))
    seen = grouped(packets).withColumn("due", due).select("stream_id", "pos", "event", "offset", "due", "frame_index", "expected", "key")
    every = seen.join(decoded.select("stream_id", "pos", "status"), ["stream_id", "pos"])
    element = (
        F.when(F.col("event") == "bad_header", "sequence.header").when(F.col("offset") != F.col("due"), "packet.sync").when(F.col("event") != "packet", F.concat(F.lit("packet."), "event"))
        .when(F.col("frame_index") != F.col("expected"), "packet.frame_index_gap").when((F.col("expected") == 0) & ~F.col("key"), "pframe.references").when(~has_image(F.col("status")), "payload")
    )
    bad = every.withColumn("element", element).where("element is not null")
    return bad.groupBy("stream_id").agg(F.min_by(F.struct("pos", "element"), "pos").alias("f")).select("stream_id", "f.pos", "f.element")


def decode_strict(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pictures of the streams without fault, and the fault of each other stream."""
    decoded = decode(packets)
    refused = faults(decoded, packets)
    return decoded.hint("merge").join(refused.select("stream_id"), "stream_id", "left_anti"), refused


def seek(packets: DataFrame, targets: DataFrame, onwards: bool = False) -> DataFrame:
    """Pictures at (stream_id, target); only the group of each target is decoded, up to it.

    ``onwards`` returns every picture from the target to the end of its stream.
    A target that is not there, or has no keyframe before it, gives no row.
    """
    groups = grouped(packets)
    wanted = targets.select("stream_id", F.col("target").cast("bigint").alias("target")).distinct()
    at = groups.select("stream_id", "gop", F.col("frame_index").alias("target"), F.col("pos").alias("upto")).join(wanted, ["stream_id", "target"]).where("gop > 0")
    if onwards:
        need = at.groupBy("stream_id").agg(F.min("gop").alias("from_gop"))
        used = groups.join(need, "stream_id").where("gop >= from_gop")
    else:
        need = at.groupBy("stream_id", "gop").agg(F.max("upto").alias("upto"))
        used = groups.join(need, ["stream_id", "gop"]).where("pos <= upto")
    # a seek starts at its keyframe whatever was lost before it
    used = used.withColumn("expected", F.when(F.col("key"), F.col("frame_index")).otherwise(F.col("expected")))

    shown = pictures_of(used).where(has_image(F.col("status"))).hint("merge")
    keys = at.select("stream_id", "target", F.col("upto").alias("pos"))
    if onwards:
        first = keys.groupBy("stream_id").agg(F.min("target").alias("target"), F.min("pos").alias("first"))
        return shown.join(first, "stream_id").where("pos >= first").drop("first")
    return shown.join(keys, ["stream_id", "pos"])


def coverage(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts (id, uses in pictures) and syntax elements (name, uses in pictures) that the streams code."""
    schema = "stream_id bigint, pos bigint, contexts array<int>, elements array<string>"

    def step(state: K.State, row: dict) -> Iterator[tuple]:
        _, got = decode_packet(state, row)
        if got:
            yield row["stream_id"], row["pos"], sorted(got.port.used), sorted(got.port.elements)

    met = _walked(grouped(packets), step, schema)
    count = lambda c, name: met.select(F.explode(c).alias(name)).groupBy(name).agg(F.count("*").alias("pictures"))
    return count("contexts", "context"), count("elements", "element")


BLOCKS = "x int, y int, size int, kind string, mode string, reference string, mv_x int, mv_y int, modeled_entropy_q16 bigint, emitted_payload_bytes bigint, dc_energy bigint"
PROBE = f"stream_id bigint, frame_index bigint, width int, height int, key boolean, golden_refresh boolean, qp int, input_payload_len bigint, canonical_replay_payload_len bigint, canonical_payload_match boolean, first_mismatch_offset bigint, frame_flush_bytes bigint, parts array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in BLOCKS.split(','))}>>"


def probe(packets: DataFrame) -> DataFrame:
    """One report for each sound packet after a keyframe: its syntax, read and written anew, and what every part of it costs.

    A payload whose syntax breaks ends its group; packets after it are left out.
    """

    def step(state: K.State, row: dict) -> Iterator[tuple]:
        if row["event"] != "packet" or (not row["key"] and (state.contexts is None or row["frame_index"] != row["expected"])):
            state.forget()
            return
        try:
            got = K.replay(row["width"], row["height"], row["payload"], row["key"], None if row["key"] else state.contexts)
        except (K.CodecFault, SyntaxFault, EOFError):
            state.forget()
            return
        state.contexts = got.contexts
        data, again = row["payload"], got.payload
        differ = next((i for i, (a, b) in enumerate(zip(data, again, strict=False)) if a != b), None)
        if differ is None and len(data) != len(again):
            differ = min(len(data), len(again))
        names = [f.split()[0] for f in BLOCKS.split(",")]
        parts = [dict(zip(names, p, strict=True)) for p in got.rows]
        yield row["stream_id"], row["frame_index"], row["width"], row["height"], row["key"], row["golden"], row["qp"], len(data), len(again), differ is None, differ, got.flushed, parts

    return _walked(grouped(packets), step, PROBE)


def probe_blocks(reports: DataFrame) -> DataFrame:
    """One row for each part of the reports: the structure of a superblock, or a block."""
    return reports.select("stream_id", "frame_index", F.explode("parts").alias("p")).select("stream_id", "frame_index", "p.*")


def probe_json(reports: DataFrame) -> DataFrame:
    """stream_id, frame_index and the report as JSON of the probe's first version."""
    at = lambda b: F.array(b["x"], b["y"])

    def block(b: Column) -> Column:
        intra = F.struct(F.lit("intra").alias("kind"), b["mode"].alias("mode"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("array<int>").alias("mv_q4"))
        skip = F.struct(F.lit("skip").alias("kind"), F.lit(None).cast("string").alias("mode"), b["reference"].alias("reference"), F.lit(None).cast("array<int>").alias("mv_q4"))
        inter = F.struct(F.lit("inter").alias("kind"), F.lit(None).cast("string").alias("mode"), b["reference"].alias("reference"), F.array(b["mv_x"], b["mv_y"]).alias("mv_q4"))
        prediction = F.when(b["kind"] == "intra", intra).when(b["kind"] == "skip", skip).otherwise(inter)
        return F.struct(at(b).alias("pos"), b["size"].alias("size"), prediction.alias("prediction"), F.col("qp").alias("qp"), b["modeled_entropy_q16"].alias("modeled_entropy_q16"), b["emitted_payload_bytes"].alias("emitted_payload_bytes"), b["dc_energy"].alias("dc_energy"))

    inside = lambda b, s: (F.floor(b["x"] / C.SUPERBLOCK) * C.SUPERBLOCK == s["x"]) & (F.floor(b["y"] / C.SUPERBLOCK) * C.SUPERBLOCK == s["y"])
    structures = F.filter("parts", lambda p: p["kind"] == "structure")
    superblocks = F.transform(
        structures,
        lambda s: F.struct(
            at(s).alias("pos"), s["size"].alias("size"), s["modeled_entropy_q16"].alias("structure_modeled_entropy_q16"), s["emitted_payload_bytes"].alias("structure_emitted_payload_bytes"),
            F.transform(F.filter("parts", lambda b: (b["kind"] != "structure") & inside(b, s)), block).alias("cbs"),
        ),
    )
    stream = F.struct(F.lit(1).alias("bitstream_version"), "width", "height", F.lit("420jpeg").alias("chroma"), F.lit(8).alias("depth"))
    flags = F.struct("key", "golden_refresh", F.lit(True).alias("show"))
    frame = F.struct("frame_index", flags.alias("flags"), "qp", "input_payload_len", "canonical_replay_payload_len", "canonical_payload_match", "first_mismatch_offset", "frame_flush_bytes", superblocks.alias("superblocks"))
    report = F.struct(F.lit(1).alias("probe_version"), stream.alias("stream"), frame.alias("frame"))
    return reports.select("stream_id", "frame_index", F.to_json(report).alias("report"))


# -- pictures as rows -----------------------------------------------------------


def deblocked(pictures: DataFrame) -> DataFrame:
    """Pictures (…, width, height, y, cb, cr, qp, blocks array<struct<x, y, size, intra, coded>>) after the loop filter; other columns stay."""
    schema = pictures.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                planes = tuple(p.copy() for p in P.unpacked(r["y"] + r["cb"] + r["cr"], r["width"], r["height"]))
                P.deblock(planes, r["qp"], [P.Block(x["x"], x["y"], x["size"], x["intra"], x["coded"]) for x in r["blocks"]])
                r["y"], r["cb"], r["cr"] = (p.tobytes() for p in planes)
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return pictures.mapInArrow(B.lean(run), schema)


def predicted(blocks: DataFrame) -> DataFrame:
    """Adds ``predicted`` (array<int>) to rows (width, height, plane, x, y, size, mode) of intra blocks, or (…, mv_x, mv_y, phases) of inter blocks, where mode is null."""
    schema = StructType([*blocks.schema.fields, StructField("predicted", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out = []
            for r in b.to_pylist():
                plane = np.frombuffer(r["plane"], np.uint8).reshape(r["height"], r["width"])
                got = P.intra(plane, r["x"], r["y"], r["size"], r["mode"]) if r.get("mode") is not None else P.inter(plane, r["x"], r["y"], r["size"], (r["mv_x"], r["mv_y"]), r["phases"])
                out.append(got.ravel().tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "predicted"])

    return blocks.mapInArrow(B.lean(run), schema)


def resized(pictures: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Pictures cropped, or padded by their edges, to another size (both even)."""
    target = pictures.withColumns({"to_width": F.lit(width) if isinstance(width, int) else width, "to_height": F.lit(height) if isinstance(height, int) else height})
    schema = pictures.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                w, h = r.pop("to_width"), r.pop("to_height")
                planes = P.unpacked(r["y"] + r["cb"] + r["cr"], r["width"], r["height"])
                planes = P.crop(planes, min(w, r["width"]), min(h, r["height"]))
                planes = P.pad(planes, w, h)
                r.update(width=w, height=h, y=planes[0].tobytes(), cb=planes[1].tobytes(), cr=planes[2].tobytes())
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([b.schema.field(n) for n in schema.names]))

    return target.mapInArrow(B.lean(run), schema)
