"""Codec operators against values worked out by hand, closed forms and independent plain-Python rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import numeric as N
from framelake.functions import rangecoder as R
from framelake.functions.hashing import Xoshiro256, crc32c, crc32c_many
from framelake.operators import coding, entropy, folds, ledger, prediction, quality, recovery
from framelake.plans import constants as C
from framelake.sources import packets as PK
from framelake.sources import y4m

# Published vectors of the format.
CRC = [(b"", 0), (b"123456789", 0xE3069283)]
STREAM_HEX = "4b465631010040004000010818000100780010000e72b95d"
PACKET_HEX = "4b46503105000000000000000720000073729227357672450000000000"
RANGE = [
    ([0] * 24, 2048, "000000000000", 949), ([1] * 24, 2048, "00fffe9981e2", 3134), ([0, 1] * 16, 2048, "00570f04842f1dbb00", 2050),
    ([1, 1, 1, 0, 1, 1, 0, 1] * 4, 3072, "009e0da3a0cedb42", 3041), ([1] * 9 + [0] * 3 + [1] * 21, 4095, "00008fe22b5a1f", 3897),
]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_crc_and_headers():
    for data, want in CRC:
        assert crc32c(data) == want
    assert crc32c_many([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, crc32c(b"a")]
    assert PK.encode_stream(PK.Stream(64, 64, 24, 1)).hex() == STREAM_HEX
    assert PK.decode_stream(bytes.fromhex(STREAM_HEX)) == PK.Stream(64, 64, 24, 1)
    assert PK.encode_packet(0, 7, 32, bytes(5)).hex() == PACKET_HEX
    for at in range(24):
        broken = bytearray.fromhex(STREAM_HEX)
        broken[at] ^= 1
        with pytest.raises(PK.FormatError):
            PK.decode_stream(bytes(broken))


@pytest.mark.parametrize("symbols,start,want,end", RANGE)
def test_range_coder_vectors(symbols, start, want, end):
    contexts = [start]
    data, _ = R.encode([(s, 0) for s in symbols], contexts)
    assert data.hex() == want and contexts == [end]
    contexts, reader = [start], R.Decoder(data)
    assert [reader.context(contexts, 0) for _ in symbols] == symbols


def test_range_coder_even_odds_and_levels():
    data, cost = R.encode([(s, None) for s in [0, 1] * 20], [])
    assert data.hex() == "0055554d5555000000" and cost == 40 << 16
    rng = random.Random(1)
    for _ in range(50):
        levels = [rng.choice([0, 0, 0, 1, -1, 5, -17, 32767]) for _ in range(rng.randrange(1, 70))]
        payload, _ = entropy.encode_levels(levels)
        assert entropy.decode_levels(payload, len(levels)) == levels
    with pytest.raises(EOFError):
        entropy.decode_levels(payload[:4], 1)


def test_scanner_skips_false_starts_and_reports_damage():
    body = [PK.encode_packet(i, 7 if i == 0 else 4, 20, b"KFP1 payload %d" % i) for i in range(4)]
    head = PK.encode_stream(PK.Stream(64, 64, 25, 1))
    assert [(e, p.frame_index) for e, _, p in PK.events(head + b"".join(body))] == [("packet", i) for i in range(4)]
    broken = bytearray(body[1])
    broken[-1] ^= 1
    got = [(e, p.frame_index) for e, _, p in PK.events(head + body[0] + bytes(broken) + b"KFP1junk" + body[0] + body[2] + body[3][:-1])]
    assert got == [("packet", 0), ("payload_corrupt", 1), ("packet", 2), ("truncated", 3)]
    assert list(PK.events(b"")) == []


def test_scan_frames(spark):
    data = PK.encode_stream(PK.Stream(64, 64, 25, 1)) + b"".join(PK.encode_packet(i, 7 if i == 0 else 4, 20, b"12345") for i in range(3))
    df = spark.createDataFrame([(1, data), (2, None), (3, b"")], "stream_id bigint, data binary")
    assert rows(PK.scan(df), "stream_id", "pos", "event", "key") == [(1, 0, "packet", True), (1, 1, "packet", False), (1, 2, "packet", False)]
    damaged = PK.damage(df.where("stream_id = 1"), every=2)
    assert rows(PK.scan(damaged, strict=True), "pos", "event") == [(0, "packet"), (1, "payload_corrupt")]


def test_y4m_round_trip(spark, tmp_path):
    frames = [(bytes([i]) * 4096, bytes([i + 1]) * 1024, bytes([i + 2]) * 1024) for i in range(20)]
    data = y4m.write(64, 64, 30000, 1001, frames)
    (tmp_path / "a.y4m").write_bytes(data)
    got = y4m.read(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(bytes(r["y"]), bytes(r["cb"]), bytes(r["cr"])) for r in got] == frames and got[0]["fps_den"] == 1001
    for bad in (b"", b"YUV4MPEG2 W63 H64 F1:1\n", b"YUV4MPEG2 W64 H64 F1:1 It\nFRAME\n", data[:-1], data.split(b"FRAME")[0]):
        with pytest.raises(y4m.FormatError):
            y4m.parse(bad)


def state_machine(packets):
    """Recovery as a plain walk with state."""
    expected, holds, out = 0, False, []
    for index, key, crc_bad, dec_bad in packets:
        gap = index != expected
        holds = holds and not gap
        if crc_bad:
            s = "corrupt"
        elif key:
            s = "corrupt" if dec_bad else "shown" if not gap else "recovered_leading_loss" if expected == 0 else "recovered_gap"
        else:
            s = ("corrupt" if dec_bad else "shown") if holds else "dependency_lost"
        holds = s in ("shown", "recovered_gap", "recovered_leading_loss")
        expected = index + 1
        out.append(s)
    return out


def test_recovery_equals_state_machine(spark):
    rng, data, want = random.Random(3), [], []
    for stream in range(60):
        index, packets = rng.randrange(2), []
        for pos in range(rng.randrange(1, 30)):
            packets.append((index, rng.random() < 0.25, rng.random() < 0.1, rng.random() < 0.1))
            index += 1 + (rng.random() < 0.15) * rng.randrange(1, 4)
        data += [(stream, pos, *p, 10) for pos, p in enumerate(packets)]
        want += [(stream, pos, s) for pos, s in enumerate(state_machine(packets))]
    df = spark.createDataFrame(data, "stream_id bigint, pos bigint, frame_index bigint, key boolean, crc_bad boolean, dec_bad boolean, bits bigint")
    assert rows(recovery.classify(df), "stream_id", "pos", "status") == want
    assert recovery.timeline(df).where("image is null").count() == 0
    empty = df.limit(0)
    assert recovery.classify(empty).count() == recovery.gops(empty).count() == folds.plan_gops(empty.select("stream_id", F.col("pos").alias("frame"), F.col("bits").alias("sad"))).count() == 0


# Fill, capacity, QP before and after.
@pytest.mark.parametrize("fill,capacity,before,after", [(0, 300, 32, 30), (300, 300, 32, 34), (150, 300, 32, 32), (0, 300, 0, 0), (300, 300, 63, 63)])
def test_rate_control_steps(fill, capacity, before, after):
    rc = folds.RateControl(1000, 25, 1)
    rc.fill, rc.capacity, rc.qp, rc.budget = fill << 16, capacity << 16, before, 0
    rc.commit(0)
    assert rc.qp == after


def test_gop_planner_resets():
    g = folds.GopPlanner(interval=10, golden=3)
    keys = [g.step((s,)) for s in [0, 5, 5, 5, 5, 15, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5]]
    assert [i for i, k in enumerate(keys) if k[0]] == [0, 5, 15] and keys[5][2] and not keys[15][2]
    assert [i for i, k in enumerate(keys) if k[1]] == [0, 3, 5, 8, 11, 14, 15]


def shift(v, n):
    return int(math.copysign((abs(v) + (1 << (n - 1))) >> n, v)) if v else 0


def test_transform_round_trip_and_basis(spark):
    rng = random.Random(5)
    for n in (4, 8, 16):
        m = C.dct_matrix(n)
        block = [rng.randrange(-255, 256) for _ in range(n * n)]
        log = n.bit_length() - 1
        h = [[shift(sum(block[y * n + x] * m[f][x] for x in range(n)), log + 1) for f in range(n)] for y in range(n)]
        want = [shift(sum(h[y][fx] * m[fy][y] for y in range(n)), log + 8) for fy in range(n) for fx in range(n)]
        df = spark.createDataFrame([(block,)], "v array<bigint>")
        got = coding.forward_dct(df, "v", n)
        assert list(got.first()["v"]) == want
        h = [[shift(sum(want[fy * n + fx] * m[fx][x] for fx in range(n)), 7) for x in range(n)] for fy in range(n)]
        back = [min(max(shift(sum(h[fy][x] * m[fy][y] for fy in range(n)), 13 - log), -32768), 32767) for y in range(n) for x in range(n)]
        assert list(coding.inverse_dct(got, "v", n).first()["v"]) == back


def test_scalars(spark):
    df = spark.createDataFrame([(v,) for v in range(-40, 41)], "v bigint")
    got = df.select("v", N.rounded_shift(F.col("v"), 3).alias("s"), N.full_pel(F.col("v")).alias("f"), N.exp_golomb_bits(F.col("v")).alias("b"), N.dequantize(F.col("v"), F.lit(21)).alias("d"), N.quantize(F.col("v"), F.lit(18)).alias("q"), N.reflect(F.col("v"), 5).alias("r"), N.reflect(F.col("v"), 1).alias("one")).collect()
    for r in got:
        v, sign = r["v"], (r["v"] > 0) - (r["v"] < 0)
        assert r["s"] == shift(v, 3) and r["f"] == sign * ((abs(v) + 2) // 4 * 4) and r["b"] == len(R.exp_golomb_bins(v))
        assert r["d"] == (v * 21 + 8) >> 4 and r["q"] == sign * min((16 * abs(v) + 9) // 18, 32767) and r["one"] == 0
        i = v
        while not 0 <= i < 5:
            i = -i if i < 0 else 8 - i
        assert r["r"] == i


def test_psnr_ssim_edges(spark):
    a = list(range(64))
    df = spark.createDataFrame([(0, a, a), (1, a, [x + 1 for x in a])], "frame bigint, ref array<int>, dist array<int>")
    p = {r["frame"]: r for r in quality.psnr_frames(df).collect()}
    assert p[0]["psnr"] is None and p[0]["lossless"] and abs(p[1]["psnr"] - 10 * math.log10(65025)) < 1e-9
    assert abs(quality.psnr_clip(df).first()["psnr"] - 10 * math.log10(65025 * 2)) < 1e-9
    s = {r["frame"]: r["ssim"] for r in quality.ssim_frames(df, 8, 8).collect()}
    assert abs(s[0] - 1) < 1e-12 and s[1] < 1


def test_bd_rate_known_curves(spark):
    q = [30.0, 33.0, 36.0, 39.0]
    base = [("a", "full", 100.0 * 2**i, x) for i, x in enumerate(q)]
    half = [("a", "half", 50.0 * 2**i, x) for i, x in enumerate(q)]
    few = [("a", "few", 10.0, 31.0), ("a", "few", 10.0, 31.0)]
    away = [("a", "away", 100.0 * 2**i, x + 50) for i, x in enumerate(q)]
    zero = [("a", "zero", 0.0 if i == 1 else 9.0, x) for i, x in enumerate(q)]
    alone = [("b", "half", 5.0 * 2**i, x) for i, x in enumerate(q)]
    df = spark.createDataFrame(base + half + few + away + zero + alone, "clip string, toolset string, rate double, quality double")
    got = {(r["clip"], r["toolset"]): (r["bd_rate_percent"], r["refused"]) for r in quality.bd_rate(df, "full").collect()}
    assert abs(got["a", "half"][0] + 50) < 1e-9 and got["a", "half"][1] is None
    assert [got[k][1] for k in (("a", "few"), ("a", "away"), ("a", "zero"), ("b", "half"))] == ["too_few_points", "no_overlap", "non_positive_rate", "no_baseline"]


def test_deblock_rules(spark):
    lines = [([10, 10, 10, 10, 14, 14, 14, 14], q, s) for q in (0, 40, 63) for s in (0, 1, 2)]
    df = spark.createDataFrame(lines, "s array<int>, qp int, strength int")
    for r in df.withColumn("o", prediction.deblock_line(F.col("s"), F.col("qp"), F.col("strength"))).collect():
        if r["qp"] == 0 or r["strength"] == 0:
            assert list(r["o"]) == list(r["s"])
        else:
            assert list(r["o"]) == ([10, 10, 10, 12, 12, 14, 14, 14] if r["strength"] == 1 else [10, 11, 11, 12, 13, 13, 14, 14])


def test_ledger(spark):
    seen = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (1, 9)], "stream_id bigint, id bigint")
    r = ledger.coverage(seen, 4).first()
    assert (r["recorded"], r["complete"], r["missing"]) == (2, False, "1,3")
    fresh = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 4.0)], "k string, v double")
    rec = spark.createDataFrame([("a", 1.0 + 1e-12), ("b", 2.1), ("c", None), ("z", 9.0)], "k string, v double")
    assert rows(ledger.receipt_diff(fresh, rec, ["k"], "v"), "k", "why") == [("b", "unequal"), ("d", "absent")]


def test_generator():
    x = Xoshiro256((1, 2, 3, 4))
    assert x.next() == 41943041 and x.next() == 58720359
