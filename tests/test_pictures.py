"""Payload syntax, prediction, loop filter, decoder, probe and encoder, against published vectors and plain loops."""

import hashlib
import random

import numpy as np
import pytest

from framelake.functions import bits
from framelake.functions import codec as K
from framelake.functions import pictures as P
from framelake.functions import search as S
from framelake.functions.payload import Port, SyntaxFault, leaves, transforms
from framelake.operators import decoding, encoding
from framelake.plans import constants as C
from framelake.sources import packets as PK
from framelake.sources import synthetic

# A published stream of one picture, its decisions and the hash of its samples.
STREAM = "4b465631010040004000010818000100780010000e72b95d4b465031060000000000000007200000230e00748a7c2a57000000000000"
SAMPLES_SHA256 = "cb11e05cb5da949c0e0f5b5a7cb310df35a96a22c45d1ada70d950859fe697d1"


def test_published_stream():
    port = Port(None)
    port.partition(64)
    port.prediction(True, ("intra", "dc"))
    for chroma, n, count in transforms(64):
        for _ in range(count):
            port.coefficients(chroma, n, [0] * (n * n))
    assert port.finish() == bytes(6)
    data = bytes.fromhex(STREAM)
    (event, at, p), = PK.events(data)
    assert event == "packet" and p.flags == 7 and p.qp == 32
    got = K.decode_payload(64, 64, data[at + 24 :], p.qp, True, K.State())
    assert hashlib.sha256(P.packed(got.picture)).hexdigest() == SAMPLES_SHA256


def random_payload(rng, key, contexts=None):
    def tree(n):
        return n if n == 8 or rng.random() < 0.4 else [tree(n // 2) for _ in range(4)]

    port, said = Port(None, contexts), []
    t = tree(64)
    port.partition(t)
    said.append(t)
    for _, _, n in leaves(t):
        kind = "intra" if key else rng.choice(["intra", "skip", "inter"])
        p = {"intra": ("intra", rng.choice(C.INTRA_MODES)), "skip": ("skip", rng.choice(C.REFERENCES)), "inter": ("inter", rng.choice(C.REFERENCES), rng.randrange(-512, 513), rng.randrange(-9, 9))}[kind]
        port.prediction(key, p)
        said.append(p)
        for chroma, m, count in transforms(n) if kind != "skip" else []:
            for _ in range(count):
                levels = [0] * (m * m)
                for _ in range(rng.choice([0, 1, 5])):
                    levels[rng.randrange(m * m)] = rng.choice([1, -1, 2, -3, 70, C.LEVEL_MAX, -C.LEVEL_MAX])
                port.coefficients(chroma, m, levels)
                said.append(levels)
    return port, port.finish(), said


@pytest.mark.parametrize("key", [True, False])
def test_syntax_round_trip(key):
    rng = random.Random(4)
    for _ in range(5):
        written, data, said = random_payload(rng, key)
        port, want = Port(data), iter(said)
        t = port.partition()
        assert t == next(want)
        for _, _, n in leaves(t):
            p = port.prediction(key)
            assert p == next(want)
            for chroma, m, count in transforms(n) if p[0] != "skip" else []:
                for _ in range(count):
                    assert port.coefficients(chroma, m) == next(want)
        assert port.contexts == written.contexts and port.elements == written.elements and port.used == written.used
        again = K.replay(64, 64, data, key, None)
        assert again.payload == data and sum(r[9] for r in again.rows) + again.flushed == len(data)


def test_syntax_refusals():
    for wrong in (lambda p: p.partition([64, 32, 32, 32]), lambda p: p.prediction(True, ("skip", "last")), lambda p: p.prediction(False, ("inter", "last", 513, 0)), lambda p: p.coefficients(False, 4, [0] * 15), lambda p: p.coefficients(False, 4, [C.LEVEL_MAX + 1] + [0] * 15)):
        with pytest.raises(SyntaxFault):
            wrong(Port(None))
    with pytest.raises(EOFError):
        Port(bytes(4))
    with pytest.raises(K.CodecFault):
        K.decode_payload(64, 64, bytes(6), 32, False, K.State())


def plain_intra(plane, x, y, n, mode):
    h, w = plane.shape
    top = [int(plane[y - 1, min(x + k, w - 1)]) for k in range(2 * n + 1)] if y else None
    left = [int(plane[min(y + k, h - 1), x - 1]) for k in range(2 * n + 1)] if x else None
    t = top or [left[0] if left else 128] * (2 * n + 1)
    s = left or [top[0] if top else 128] * (2 * n + 1)
    main = lambda k: t[min(k, 2 * n)] if k >= 0 else s[min(-k - 1, 2 * n)]
    out = np.zeros((n, n), int)
    for r in range(n):
        for c in range(n):
            if mode == "dc":
                known = (top[:n] if top else []) + (left[:n] if left else [])
                out[r, c] = (sum(known) + len(known) // 2) // len(known) if known else 128
            elif mode == "horizontal":
                out[r, c] = s[r]
            elif mode == "vertical":
                out[r, c] = t[c]
            elif mode == "planar":
                out[r, c] = ((n - 1 - c) * s[r] + (c + 1) * t[n] + (n - 1 - r) * t[c] + (r + 1) * s[n] + n) // (2 * n)
            else:
                k, f = divmod(c * 32 + (r + 1) * C.ANGLES[mode], 32)
                out[r, c] = ((32 - f) * main(k) + f * main(k + 1) + 16) >> 5
    return out


def test_intra_against_loops():
    rng = np.random.default_rng(1)
    plane = rng.integers(0, 256, (64, 64), dtype=np.uint8)
    for n, x, y in ((4, 0, 0), (4, 60, 8), (8, 0, 16), (16, 16, 0), (16, 48, 48), (32, 32, 32), (64, 0, 0)):
        for mode in C.INTRA_MODES:
            assert (P.intra(plane, x, y, n, mode) == plain_intra(plane, x, y, n, mode)).all(), (n, x, y, mode)


def plain_inter(plane, x, y, n, vector, phases):
    h, w = plane.shape
    at = lambda c, r: int(plane[min(max(r, 0), h - 1), min(max(c, 0), w - 1)])

    def blend(here, half, after, part):
        m = phases // 2
        if part == m:
            return half
        a, b, k = (here, half, part) if part < m else (half, after, part - m)
        return (a * (m - k) + b * k + m // 2) // m

    def across(c, r, part):
        here = at(c, r) * 32
        return here if not part else blend(here, sum(f * at(c + k - 2, r) for k, f in enumerate(C.FILTER_TAPS)), at(c + 1, r) * 32, part)

    (wx, px), (wy, py) = divmod(vector[0], phases), divmod(vector[1], phases)
    out = np.zeros((n, n), int)
    for r in range(n):
        for c in range(n):
            cc, rr = x + wx + c, y + wy + r
            v = across(cc, rr, px) * 32
            if py:
                v = blend(v, sum(f * across(cc, rr + k - 2, px) for k, f in enumerate(C.FILTER_TAPS)), across(cc, rr + 1, px) * 32, py)
            out[r, c] = min(max((v + 512) >> 10, 0), 255)
    return out


def test_inter_against_loops():
    plane = np.random.default_rng(2).integers(0, 256, (32, 32), dtype=np.uint8)
    for phases in (4, 8):
        for vector in ((0, 0), (1, 0), (0, 3), (5, -7), (-130, 40), (9, 250), (-3, -3)):
            for x, y, n in ((0, 0, 8), (24, 8, 8), (8, 16, 4)):
                assert (P.inter(plane, x, y, n, vector, phases) == plain_inter(plane, x, y, n, P.legal_vector(plane, x, y, n, vector, phases), phases)).all()


def test_vectors_stay_within_the_virtual_edge():
    plane = np.zeros((64, 64), np.uint8)
    assert P.legal_vector(plane, 0, 0, 8, (-300, 999)) == (-256, 256)
    assert P.legal_vector(plane, 0, 56, 8, (-255, 255)) == (-252, 252)  # a fraction reads two before and three after


def test_motion_field_looks_beside_the_block():
    f = P.MotionField(64, 64)
    f.record(0, 0, 32, "last", (4, 8))
    f.record(32, 0, 16, "last", (20, -4))
    f.record(48, 0, 16, "golden", (100, 100))
    assert f.predictor(0, 32, 32, "last") == (0, 0)  # what is above right is not there yet
    f.record(32, 16, 16, "last", (12, 12))
    assert f.predictor(0, 32, 32, "last") == (4, 8)
    assert f.predictor(0, 0, 8, "last") == (0, 0)


def plain_deblock(plane, qp, blocks, chroma):
    scale = 2 if chroma else 1
    height, width = plane.shape
    found = []
    at = lambda x, y: next((b for b in blocks if b.x <= x < b.x + b.size and b.y <= y < b.y + b.size), None)
    for b in blocks:
        for vertical, line, start, near in ((True, b.x + b.size, b.y, at(b.x + b.size, b.y)), (False, b.y + b.size, b.x, at(b.x, b.y + b.size))):
            if line < (width if vertical else height) * scale:
                found.append((vertical, line, start, b.size, P.strength("coding_block", b.intra or near.intra, b.coded or near.coded)))
        if b.size == 64:
            found += [(v, (b.x if v else b.y) + 32, b.y if v else b.x, 64, P.strength("derived_transform", b.intra, b.coded)) for v in (True, False)]
    if chroma:
        found = [(v, a // 2, s // 2, n // 2, k) for v, a, s, n, k in found if n >= 16 and a % 2 == 0 and s % 2 == 0]
    for vertical in (True, False):
        for _, line, start, length, k in sorted(e for e in found if e[0] == vertical):
            for o in range(start, start + length):
                cut = np.s_[o, line - 4 : line + 4] if vertical else np.s_[line - 4 : line + 4, o]
                plane[cut] = P.filter_lines(plane[cut][None], qp, np.array([min(k, 1) if chroma else k]))[0]


def test_deblock_against_loops():
    rng = random.Random(7)

    def tree(n):
        return n if n == 8 or rng.random() < 0.45 else [tree(n // 2) for _ in range(4)]

    for qp in (20, 40, 63):
        base = np.random.default_rng(qp).integers(100, 130, (128, 128)).astype(np.uint8)
        blocks = [P.Block(x, y, n, rng.random() < 0.4, rng.random() < 0.5) for sy in (0, 64) for sx in (0, 64) for x, y, n in leaves(64 if sx == sy == 0 else tree(64), sx, sy)]
        picture = (base.copy(), base[::2, ::2].copy(), base[1::2, 1::2].copy())
        P.deblock(picture, qp, blocks)
        for plane, source, chroma in zip(picture, (base, base[::2, ::2], base[1::2, 1::2]), (False, True, True), strict=True):
            want = source.copy()
            plain_deblock(want, qp, blocks, chroma)
            assert (plane == want).all()


# Published lines across an edge, before and after.
LINES = [
    (32, 1, [128] * 8, [128] * 8), (32, 1, [128, 128, 100, 100, 140, 140, 140, 140], [128, 128, 100, 104, 136, 140, 140, 140]), (40, 2, [10, 20, 30, 40, 50, 60, 70, 80], [10, 25, 35, 40, 50, 55, 65, 80]),
    (32, 1, [0, 0, 0, 0, 48, 48, 48, 48], [0, 0, 0, 0, 48, 48, 48, 48]), (32, 1, [112, 112, 112, 100, 106, 106, 106, 106], [112, 112, 112, 100, 106, 106, 106, 106]), (32, 1, [140, 140, 140, 140, 100, 100, 128, 128], [140, 140, 140, 136, 104, 100, 128, 128]),
]


def test_published_filter_lines():
    for qp, level, before, after in LINES:
        assert P.filter_lines(np.array([before], np.uint8), qp, np.array([level]))[0].tolist() == after


def test_geometry():
    p = P.pad(P.crop(P.filled(64, 64, 9), 60, 62), 64, 64)
    assert [x.shape for x in p] == [(64, 64), (32, 32), (32, 32)]
    for wrong in (lambda: P.crop(p, 63, 64), lambda: P.crop(p, 66, 64), lambda: P.pad(p, 32, 64), lambda: P.unpacked(b"123", 2, 2)):
        with pytest.raises(ValueError):
            wrong()
    assert P.packed(P.unpacked(P.packed(p), 64, 64)) == P.packed(p)


def test_bits():
    w = bits.BitWriter()
    w.write(0b101, 3)
    w.write(0b110010, 6)
    assert (w.length, w.finish()) == (9, bytes([0b10111001, 0]))
    r = bits.BitReader(w.finish())
    assert (r.read(3), r.read(6), r.at) == (0b101, 0b110010, 9)
    with pytest.raises(EOFError):
        r.read(8)
    with pytest.raises(ValueError):
        w.write(0, 33)


def test_encoder_finds_a_shift_and_decodes_to_itself():
    base = synthetic.luma("motion", 64, 64, 0, 4, 3)
    moved = synthetic.luma("motion", 64, 64, 1, 4, 3)
    assert S.motion(moved, np.pad(base, 0), 16, 16, 16, (0, 0))[0] == (12, 8)
    state, decoder, grey = K.State(), K.State(), np.full((32, 32), 128, np.uint8)
    for k, luma in enumerate((base, moved)):
        got = S.encode_picture((luma, grey, grey), 30, k == 0, state, "split" if k == 0 else None)
        back = K.decode_payload(64, 64, got.payload, 30, k == 0, decoder)
        assert P.packed(back.picture) == P.packed(got.picture) and back.port.contexts == got.contexts
        state.install(got.picture, k == 0, got.contexts)
        decoder.install(back.picture, k == 0, back.port.contexts)
    assert all(t.prediction[0] in ("inter", "skip", "intra") for t in got.blocks) and any(t.vector for t in got.blocks)


def clip_rows(spark, frames, pattern="fade"):
    from pyspark.sql import functions as F

    return synthetic.clip(spark, pattern, 64, 64, frames, 5).withColumn("stream_id", F.lit(1).cast("bigint")).drop("clip")


def test_streams_from_clip_to_picture_and_probe(spark):
    clips = clip_rows(spark, 5)
    coded = encoding.encode(clips, 40, "no-split", key_interval=3).cache()
    packets = PK.payloads(encoding.streams(coded)).cache()
    want = {r["frame"]: (bytes(r["y"]), bytes(r["cb"])) for r in coded.collect()}
    assert [r["key"] for r in coded.orderBy("frame").collect()] == [True, False, False, True, False]
    pictures, refused = decoding.decode_strict(packets)
    assert {r["frame_index"]: (bytes(r["y"]), bytes(r["cb"])) for r in pictures.collect()} == want and not refused.count()
    target = spark.createDataFrame([(1, 4), (1, 99)], "stream_id bigint, target bigint")
    assert [(r["frame_index"], bytes(r["y"])) for r in decoding.seek(packets, target).collect()] == [(4, want[4][0])]
    reports = decoding.probe(packets)
    for r in reports.collect():
        assert r["canonical_payload_match"] and sum(p["emitted_payload_bytes"] for p in r["parts"]) + r["frame_flush_bytes"] == r["input_payload_len"]
    cost = {r["frame"]: r["cost_q16"] for r in coded.collect()}
    assert {r["frame_index"]: sum(p["modeled_entropy_q16"] for p in r["parts"]) for r in reports.collect()} == cost


def test_a_lost_packet_and_strict_refusal(spark):
    from pyspark.sql import functions as F

    coded = encoding.encode(clip_rows(spark, 4, "gradient"), 50, "no-split", key_interval=3)
    data = encoding.streams(coded).collect()[0]["data"]
    at = synthetic.starts(bytes(data))
    lost = bytes(data[: at[1]] + data[at[2] :])
    frame = lambda b: spark.createDataFrame([(1, bytearray(b))], "stream_id bigint, data binary")
    packets = PK.payloads(frame(lost))
    assert [r["status"] for r in decoding.decode(packets).orderBy("pos").collect()] == ["shown", "dependency_lost", "shown"]
    assert [(r["pos"], r["element"]) for r in decoding.decode_strict(packets)[1].collect()] == [(1, "packet.frame_index_gap")]
    junk = PK.payloads(frame(data[: at[1]] + b"xx" + data[at[1] :]))
    assert [r["element"] for r in decoding.decode_strict(junk)[1].collect()] == ["packet.sync"]
    late = PK.payloads(frame(data[:24] + data[at[1] :]))
    assert [r["status"] for r in decoding.decode(late).orderBy("pos").collect()] == ["dependency_lost", "dependency_lost", "shown"]
    for kind in synthetic.DAMAGE:
        out = synthetic.damaged(frame(data), kind, seed=9).collect()[0]["data"]
        again = synthetic.damaged(frame(data).repartition(3), kind, seed=9).collect()[0]["data"]
        assert out == again
    assert decoding.decode(PK.payloads(frame(data))).where(F.col("status") != "shown").count() == 0


def test_rate_control_takes_bits_into_account(spark):
    coded = encoding.encode_to_rate(clip_rows(spark, 3, "noise"), 64_000, 25, tools="no-split", key_interval=2).orderBy("frame").collect()
    assert coded[0]["qp"] == C.first_qp(64_000 // 25) and coded[1]["qp"] > coded[0]["qp"] - 3


def test_patterns():
    assert synthetic.luma("flat", 64, 64, 0, 1).min() == 128
    fade = [int(synthetic.luma("fade", 64, 64, k, 3).max()) for k in range(3)]
    assert fade[0] > fade[1] > fade[2] == 0
    a, b = synthetic.luma("motion", 64, 64, 0, 2), synthetic.luma("motion", 64, 64, 1, 2)
    assert (a[2:, 3:] == b[:-2, :-3]).all()
    assert (synthetic.luma("cut", 64, 64, 1, 2) != b).any()
    with pytest.raises(ValueError):
        synthetic.luma("stripes", 64, 64, 0, 1)
