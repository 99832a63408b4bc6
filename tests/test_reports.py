"""Reports, manifests, pairs of clips, edges and vectors over tables."""

import json

import pytest
from pyspark.sql import functions as F

from framelake.functions import bits
from framelake.functions import pictures as P
from framelake.operators import prediction, quality
from framelake.sources import reports as R


def documents(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")


CAMPAIGN = {
    "format": "key-frame-rd-campaign-v1", "encoder_version": "9", "settings": {"qp_ladder": [22, 27]},
    "curves": [{"clip": "b", "toolset": "full", "width": 176, "points": [{"qp": 22, "bytes": 9, "rate": 1.5, "quality": 30}]}, {"clip": "a", "toolset": "no-skip", "bd_rate_percent": 2.5, "points": []}, {"clip": "b", "toolset": "no-skip", "bd_rate_refused": "no overlap", "points": []}],
    "rate_control": {"clips": [{"clip": "b", "frames": 3, "targets": [{"target_bps": 9, "achieved_bps": 10, "error_percent": 11.1}]}]},
}


def test_campaigns(spark):
    texts = [json.dumps(CAMPAIGN), json.dumps({**CAMPAIGN, "format": "other"}), "{", None, json.dumps({**CAMPAIGN, "curves": 3}), json.dumps({**CAMPAIGN, "curves": [{"clip": "x"}]})]
    r = R.campaigns(documents(spark, *texts))
    assert [x["refused"] for x in r.orderBy("id").collect()] == [None, *["not a campaign report"] * 3, "no curves", "a curve without points"]
    c = R.curves(r, "id")
    assert [(x["clip"], x["toolset"], x["frames"], x["bd_rate_percent"], x["bd_rate_refused"]) for x in c.orderBy("nth").collect()] == [("b", "full", 0, None, None), ("a", "no-skip", 0, 2.5, None), ("b", "no-skip", 0, None, "no overlap")]
    assert [(x["clip"], x["rate"]) for x in R.curve_points(c, "id").collect()] == [("b", 1.5)]
    assert [x["clip"] for x in R.clips_of(c, "id").orderBy("first").collect()] == ["b", "a"]
    assert [(x["clip"], x["frames"], x["target_bps"]) for x in R.rate_targets(r, "id").collect()] == [("b", 3, 9.0)]
    wrong = json.dumps({**CAMPAIGN, "curves": [{"clip": "a", "bd_rate_percent": "much", "points": []}]})
    with pytest.raises(Exception, match="not a number"):
        R.curves(R.campaigns(documents(spark, wrong))).collect()


def test_curve_files(spark):
    got = R.curve_files(documents(spark, '[{"rate": 1, "quality": 2}]', '{"points": [{"rate": 1, "quality": 2, "qp": 3}], "x": 1}', "[]", '{"a": 1}', '[{"rate": 1, "quality": 2}, {"rate": 1}]', None, '[{"rate": "fast", "quality": 2}]')).orderBy("id").collect()
    assert [r["refused"] for r in got] == [None, None, "no points", "no points", "point 1 lacks a number", "no points", "point 0 lacks a number"]


def test_manifest(spark):
    text = 'format = "x"\nname = "stray"\n[[clips]]\nname = "one" # the "first\nfile="one.y4m"\nwidth = 64 # wide\nheight = 66\nframes = 7\n[other]\nwidth = 9\n[[clips]]\nname = "two"\nfile = "a=b.y4m"\nwidth = 64\nheight = sixty\n'
    lines = spark.createDataFrame([("m", i, x) for i, x in enumerate(text.split("\n"))], "path string, n int, line string").repartition(3)
    got = [tuple(r)[2:] for r in R.pinned_clips(lines).orderBy("at").collect()]
    assert got == [("one", "one.y4m", 64, 66, 7, None), ("two", "a=b.y4m", 64, None, None, "frames")]


def test_probe_reports_and_blocks_at_points(spark):
    block = lambda x, y, n: {"pos": [x, y], "size": n, "prediction": {"kind": "intra", "mode": "dc"}, "qp": 3, "modeled_entropy_q16": 5, "emitted_payload_bytes": 1, "dc_energy": 0}
    report = {"probe_version": 1, "frame": {"frame_index": 4, "superblocks": [{"pos": [0, 0], "size": 64, "cbs": [block(0, 0, 32), block(32, 0, 16)]}]}}
    blocks = R.probe_blocks(documents(spark, json.dumps(report), json.dumps({**report, "probe_version": 2})), "text", "id")
    assert [(r["frame_index"], r["x"], r["size"], r["mode"]) for r in blocks.orderBy("x").collect()] == [(4, 0, 32, "dc"), (4, 32, 16, "dc")]
    points = spark.createDataFrame([(0, 31, 9), (0, 40, 15), (0, 40, 16)], "id bigint, px int, py int")
    assert sorted((r["px"], r["py"], r["x"]) for r in R.block_at(blocks, points, "id").collect()) == [(31, 9, 0), (40, 15, 32)]


def test_clips_that_do_not_pair(spark):
    frames = lambda rows: spark.createDataFrame(rows, "clip string, frame int, width int, height int")
    a = frames([("same", 0, 64, 64), ("short", 0, 64, 64), ("short", 1, 64, 64), ("size", 0, 64, 64), ("size", 1, 64, 64), ("alone", 0, 64, 64)])
    b = frames([("same", 0, 64, 64), ("short", 0, 64, 64), ("size", 0, 64, 64), ("size", 1, 64, 66)])
    assert dict(map(tuple, quality.check_pair(a, b).collect())) == {"short": "the clips have 2 and 1 frames", "size": "frame 1 is 64x64 against 64x66", "alone": "the clips have 1 and 0 frames"}


def test_edges_equal_the_kernel(spark):
    blocks = [P.Block(0, 0, 64, False, False), P.Block(64, 0, 32, True, False), P.Block(96, 0, 16, False, True), P.Block(112, 0, 16, False, False), P.Block(96, 16, 16, False, False), P.Block(112, 16, 16, True, True)]
    blocks += [P.Block(64, 32, 32, False, True)] + [P.Block(96 + 8 * x, 32 + 8 * y, 8, (x + y) % 2 == 0, x % 2 == 0) for y in range(4) for x in range(4)]
    rows = spark.createDataFrame([(1, b.x, b.y, b.size, b.intra, b.coded) for b in blocks], "frame int, x int, y int, size int, intra boolean, coded boolean")
    e = prediction.block_edges(rows, 128, 64)
    e = e.withColumn("strength", prediction.edge_strength(F.col("kind"), F.col("intra"), F.col("coded")))
    key = ("vertical", "line", "start", "length", "strength")
    luma = P.edges(blocks, 128, 64)
    assert sorted(tuple(r[c] for c in key) for r in e.collect()) == sorted(luma)
    assert sorted(tuple(r[c] for c in key) for r in prediction.chroma_edges(e).collect()) == sorted(P.chroma_edges(luma))


def test_vectors_of_large_blocks_equal_the_kernel(spark):
    f, rows, want = P.MotionField(128, 64), [], []
    order = [(0, 0, 64, "last", 4, 8), (64, 0, 32, "golden", 3, 3), (96, 0, 32, "last", 20, -4), (64, 32, 16, "last", 7, 7), (80, 32, 16, None, 0, 0), (64, 48, 16, "last", 1, 1)]
    for x, y, n, ref, dx, dy in order:
        f.record(x, y, n, ref, (dx, dy))
        rows.append((1, x, y, n, ref, dx, dy))
    for x, y, n, *_ in order:
        want.append((x, y, *f.predictor(x, y, n, "last")))
    got = prediction.median_vectors(spark.createDataFrame(rows, "frame int, x bigint, y bigint, size int, ref string, mv_x bigint, mv_y bigint"))
    assert sorted((r["x"], r["y"], r["mv_x"], r["mv_y"]) for r in got.collect()) == sorted(want)


def test_bits_as_columns(spark):
    row = spark.range(1).select(bits.packed([(F.lit(5), 3), (F.lit(50), 6), (F.lit(2**32 - 1), 32)]).alias("b"))
    w = bits.BitWriter()
    for v, n in ((5, 3), (50, 6), (2**32 - 1, 32)):
        w.write(v, n)
    assert bytes(row.first()["b"]) == w.finish()
    a, b, c, d = bits.unpacked(F.col("b"), [3, 6, 32, 9])
    assert tuple(row.select(a, b, c, d).first()) == (5, 50, 2**32 - 1, None)


def test_json_without_numbers_that_are_not_finite(spark):
    row = spark.sql("select named_struct('a', double('NaN'), 'b', double('-Infinity'), 'c', 1.5D) as s")
    assert json.loads(row.select(R.compact(F.col("s"))).first()[0]) == {"a": None, "b": None, "c": 1.5}
