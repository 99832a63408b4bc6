"""Checks of streams and reports, and the command line from clip to report."""

import json

import pytest
from pyspark.sql import functions as F

from framelake import __main__ as cli
from framelake.operators import decoding, encoding, quality, verification
from framelake.plans import constants as C
from framelake.sources import packets as PK
from framelake.sources import synthetic, y4m


@pytest.fixture(scope="module")
def coded(spark):
    clips = synthetic.clip(spark, "gradient", 64, 64, 6, 5).withColumn("stream_id", F.lit(1).cast("bigint"))
    return clips, encoding.encode(clips, 44, "no-split", key_interval=3).cache()


def test_seeks_show_what_decoding_shows(spark, coded):
    got = verification.seek_equivalence(PK.payloads(encoding.streams(coded[1]))).orderBy("frame_index").collect()
    assert [tuple(r)[1:] for r in got] == [(k, k - k % 3, k % 3 + 1, True) for k in range(6)]


def test_damage_is_refused_or_decoded(spark, coded):
    streams = encoding.streams(coded[1]).collect()
    data = bytes(streams[0]["data"])
    many = spark.createDataFrame([(i, bytearray(data)) for i in range(30)], "stream_id bigint, data binary")
    for kind in synthetic.DAMAGE:
        got = {r["stream_id"]: r for r in verification.damage_outcomes(many, kind, 3).collect()}
        assert sorted(got) == list(range(30)) and {r["outcome"] for r in got.values()} <= {"decoded", "refused"}
        assert kind != "arbitrary_bytes" or {r["outcome"] for r in got.values()} == {"refused"}
    gone = verification.damage_outcomes(many, "frame_deletion", 3).collect()
    for r in gone:  # only without its last packet is a stream still whole
        left = synthetic.DAMAGE["frame_deletion"](data, synthetic.seeded(3 ^ r["stream_id"]))
        assert (r["outcome"] == "decoded") == (left == data[: len(left)])


def test_coverage_says_what_is_missing(spark, coded):
    contexts, elements = decoding.coverage(PK.payloads(encoding.streams(coded[1])))
    lacking = {r["element"] for r in verification.uncovered(elements, "element", list(C.ELEMENTS)).collect()}
    met = {r["element"] for r in elements.collect()}
    assert lacking == set(C.ELEMENTS) - met and {"partition_tree", "skip", "intra_mode", "has_coeff"} <= met
    assert verification.uncovered(contexts, "context", list(range(C.CONTEXTS))).count() == C.CONTEXTS - contexts.count()


def test_reports_reproduce(spark, coded):
    clips, out = coded
    named = lambda df: df.select(F.col("stream_id").cast("string").alias("clip"), "frame", "width", "height", "y")
    for metric in ("psnr", "ssim"):
        report = verification.quality_reports(named(clips), named(out), metric).cache()
        assert verification.moved_fields(report, verification.quality_reports(named(clips), named(out), metric)).count() == 0
        body = json.loads(report.first()["report"])
        assert body["metric"] == f"{metric}-y" and body["frames"] == 6 == len(body["per_frame"]) and not body["lossless"]
        same = verification.quality_reports(named(clips), named(clips), metric)
        assert json.loads(same.first()["report"])["lossless"]
        moved = {r["field"] for r in verification.moved_fields(report, same).collect()}
        assert {"config_sha256", "distorted_sha256", "lossless", "per_frame"} <= moved
        line = same.select(verification.report_line(F.col("report"))).first()[0]
        assert line == ("PSNR-Y  lossless dB over 6 frames" if metric == "psnr" else "SSIM-Y  1.0000 over 6 frames")
    with pytest.raises(quality.ClipsDiffer, match="6 and 5 frames"):
        verification.measured(named(clips), named(out).where("frame < 5"), "psnr")
    bd = spark.createDataFrame([('{"metric": "bd-rate", "bd_rate_percent": -3.25, "baseline_points": 5, "candidate_points": 4}',), ('{"metric": "other"}',)], "r string")
    assert [r[0] for r in bd.select(verification.report_line(F.col("r"))).collect()] == ["BD-rate  -3.2500% bitrate at equal quality, over 5 and 4 points", None]


def test_receipts(spark, coded):
    clips, out = coded
    got = json.loads(verification.receipts(out, clips, {"qp": 44, "keyframe_interval": 3}).first()["receipt"])
    packets = [len(r["packet"]) for r in out.collect()]
    assert got["bytes"] == sum(packets) + 24 and got["settings"] == {"width": 64, "height": 64, "frames": 6, "qp": 44, "keyframe_interval": 3}
    assert [f["key"] for f in got["frames"]] == [True, False, False] * 2 and all(f["psnr_y"] > 10 for f in got["frames"])


def test_modelled_bits(spark):
    costs = [0, 65536, 65535, 65536 * 3 + 32768, 1, 65536 * 7 + 65200]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in costs], "c bigint").select(verification.modelled_bits(F.col("c"))).collect()]
    assert got == ["0.00", "1.00", "1.00", "3.50", "0.00", "7.99"]


def test_command_line(spark, tmp_path, capsys):
    frames = [tuple(bytes(x) for x in (r["y"], r["cb"], r["cr"])) for r in synthetic.clip(spark, "fade", 64, 64, 3).orderBy("frame").collect()]
    (tmp_path / "a.y4m").write_bytes(y4m.write(64, 64, 25, 1, frames))
    cli.main(["enc", str(tmp_path / "a.y4m"), str(tmp_path / "s"), "--qp", "40", "--tools", "no-split", "--keyframe-interval", "2"], spark)
    cli.main(["dec", str(tmp_path / "s"), str(tmp_path / "d")], spark)
    shown = spark.read.parquet(str(tmp_path / "d")).orderBy("pos").collect()
    assert [(r["status"], r["key"]) for r in shown] == [("shown", True), ("shown", False), ("shown", True)]
    (tmp_path / "b.y4m").write_bytes(y4m.write(64, 64, 25, 1, [tuple(bytes(r[c]) for c in ("y", "cb", "cr")) for r in shown]))
    capsys.readouterr()
    cli.main(["probe", str(tmp_path / "s")], spark)
    assert len(capsys.readouterr().out.splitlines()) == 3
    cli.main(["metric", "psnr", str(tmp_path / "a.y4m"), str(tmp_path / "b.y4m")], spark)
    report, line = capsys.readouterr().out.splitlines()
    assert json.loads(report)["frames"] == 3 and line.startswith("PSNR-Y  ")
    cli.main(["enc", str(tmp_path / "a.y4m"), str(tmp_path / "r"), "--bitrate", "90000"], spark)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_rate_points_of_a_clip(spark):
    clips = synthetic.clip(spark, "motion", 64, 64, 2, 7).withColumn("stream_id", F.lit(3).cast("bigint"))
    got = {(r["toolset"], r["qp"]): r for r in encoding.rate_points(clips, [24, 48], ["full", "no-inter"]).collect()}
    assert len(got) == 4 and all(r["clip"] == 3 and r["n"] == 2 * 64 * 64 for r in got.values())
    for tools in ("full", "no-inter"):
        assert got[tools, 24]["bytes"] > got[tools, 48]["bytes"] and got[tools, 24]["sse"] < got[tools, 48]["sse"]
        assert got[tools, 24]["rate"] == got[tools, 24]["bytes"] * 8 * 25 / 2
    assert got["full", 24]["bytes"] < got["no-inter", 24]["bytes"]
    mixed = clips.unionByName(clips.where("frame = 1").withColumns({"frame": F.lit(2).cast("bigint"), "width": F.lit(32)}))
    with pytest.raises(ValueError, match="several sizes"):
        encoding.encode(mixed, 30)


def test_decoding_while_a_stream_arrives(spark, coded, tmp_path):
    from framelake.streaming import decoding as streaming

    data = bytes(encoding.streams(coded[1]).first()["data"])
    at = synthetic.starts(data)
    hurt = bytearray(data)
    hurt[at[1] + 30] ^= 1  # its payload; the next keyframe recovers
    packets = PK.payloads(spark.createDataFrame([(1, bytearray(data)), (2, hurt)], "stream_id bigint, data binary")).cache()
    for k in range(3):  # two packets a batch
        packets.where(f"pos div 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.decode(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted((r["stream_id"], r["pos"], r["status"], r["y"] and bytes(r["y"])) for r in df.collect())
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows(decoding.decode(packets))
    assert [s for i, _, s, _ in got if i == 2] == ["shown", "corrupt", "dependency_lost", "shown", "shown", "shown"]
