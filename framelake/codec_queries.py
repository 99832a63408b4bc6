"""Registered queries of whole streams and pictures, and SQL that works out what they must give."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import queries as _Q
from .functions import bits
from .functions import numeric as N
from .functions.hashing import crc_table
from .operators import decoding as D
from .operators import encoding, quality
from .operators import verification as VF
from .plans import constants as C
from .queries import ORACLES, SAMPLES, _shift, _sql_table, query
from .sources import clips, synthetic
from .sources import fragments as FR
from .sources import packets as PK
from .sources import reports as R
from .sources import views as V
from .sources.shared import saved
from .sources.stream_run import run_to_table
from .streaming import decoding as streaming

_SCALE = C.QSCALE[clips.QP]
_low = lambda c: f"greatest(0, least(63, {c}))"

# What the streams of ``clips.element_streams`` hold, from the blocks they were made of.
FRAMES = SAMPLES + """, f AS (SELECT block_id, block_id // 50 AS stream_id, block_id % 50 AS pos, block_id % 5 AS nth, list(v ORDER BY i) AS v FROM samples GROUP BY block_id),
mv AS (SELECT *, (v[21] % 9 - 4) * 8 AS m0, (v[23] % 9 - 4) * 8 AS m1 FROM f)"""
PIXELS = (
    FRAMES
    + f""", lv AS (SELECT block_id, t, (({_SCALE} * (v[3 * t + 1] - 128) + 8) >> 4) AS a, (({_SCALE} * (v[3 * t + 2] - 128) + 8) >> 4) AS b, (({_SCALE} * (v[3 * t + 3] - 128) + 8) >> 4) AS c FROM f, (SELECT unnest(range(4)) AS t) WHERE nth IN (0, 4)),
w AS (SELECT k, CAST(round(64 * sqrt(2.0) * cos(pi() * (2 * k + 1) / 64)) AS BIGINT) AS w FROM (SELECT unnest(range(32)) AS k)),
h AS (SELECT block_id, t, k AS x, {_shift("64 * a + w * b", 7)} AS h0, {_shift("64 * c", 7)} AS h1 FROM lv, w),
px AS (SELECT block_id, CAST(t % 2 * 32 + x AS INTEGER) AS x, CAST(t // 2 * 32 + k AS INTEGER) AS y, CAST(greatest(0, least(255, 128 + {_shift("64 * h0 + w * h1", 8)})) AS INTEGER) AS val FROM h, w),
g AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT unnest(range(64)) AS x), (SELECT unnest(range(64)) AS y)),
every AS (SELECT * FROM px UNION ALL SELECT f.block_id, x, y, val FROM f JOIN px ON px.block_id = f.block_id - 1 WHERE nth = 1
  UNION ALL SELECT a.block_id, g.x, g.y, p.val FROM mv a, g JOIN px p ON p.block_id = a.block_id - 2 AND p.x = {_low("g.x + m0 // 4")} AND p.y = {_low("g.y + m1 // 4")} WHERE nth = 2
  UNION ALL SELECT a.block_id, g.x, g.y, p.val FROM mv a JOIN mv b ON b.block_id = a.block_id - 1, g JOIN px p ON p.block_id = a.block_id - 3 AND p.x = {_low(_low("g.x + a.m1 // 4") + " + b.m0 // 4")} AND p.y = {_low(_low("g.y + a.m0 // 4") + " + b.m1 // 4")} WHERE a.nth = 3),
luma AS (SELECT block_id, md5(string_agg(format('{{:02X}}', val), '' ORDER BY y, x)) AS luma FROM every GROUP BY block_id),
flat AS (SELECT block_id, CAST(greatest(0, least(255, 128 + {_shift("64 * " + _shift(f"64 * (({_SCALE} * (v[13] - 128) + 8) >> 4)", 7), 8)})) AS INTEGER) AS cb FROM f),
shown AS (SELECT stream_id, pos AS frame_index, luma, md5(repeat(format('{{:02X}}', flat.cb), 1024)) AS cb FROM f JOIN luma USING (block_id) JOIN flat ON flat.block_id = CASE WHEN nth IN (0, 4) THEN f.block_id ELSE f.block_id - nth END)"""
)


def _packets(spark, d):
    return PK.payloads(clips.element_streams(spark, d))


def _hashes(pictures):
    return pictures.select("stream_id", "frame_index", F.md5(F.hex("y").cast("binary")).alias("luma"), F.md5(F.hex("cb").cast("binary")).alias("cb"))


@query(f"WITH {PIXELS} SELECT * FROM shown")
def decode_frames(spark, d):
    """Streams with intra blocks of low levels, repeated and moved blocks of both references, to pictures."""
    return _hashes(D.decode(_packets(spark, d)).where("status = 'shown'"))


_FATE = "CASE WHEN pos % 7 = 6 THEN 'corrupt' WHEN pos % 5 > 0 AND len(list_filter(range(pos - pos % 5, pos), lambda j: j % 7 = 6)) > 0 THEN 'dependency_lost' ELSE 'shown' END"


@query(f"WITH {PIXELS}, t AS (SELECT stream_id, pos, {_FATE} AS status FROM f) SELECT t.stream_id, t.pos, t.status, CASE WHEN status = 'shown' THEN luma END AS luma FROM t JOIN shown s ON s.stream_id = t.stream_id AND s.frame_index = t.pos")
def decode_damaged(spark, d):
    damaged = PK.damage(clips.element_streams(spark, d), every=7)
    return D.decode(PK.payloads(damaged)).select("stream_id", "pos", "status", F.md5(F.hex("y").cast("binary")).alias("luma"))


@query(f"WITH {PIXELS} SELECT s.stream_id, frame_index, luma, cb FROM shown s WHERE frame_index IN (7, 23, 48)")
def seek_image(spark, d):
    p = _packets(spark, d)
    targets = p.select("stream_id").distinct().select("stream_id", F.explode(F.array(F.lit(7), F.lit(23), F.lit(48))).alias("target"))
    return _hashes(D.seek(p, targets))


@query(f"WITH {PIXELS} SELECT * FROM shown WHERE frame_index >= 33")
def decode_onwards(spark, d):
    p = _packets(spark, d)
    return _hashes(D.seek(p, p.select("stream_id", F.lit(33).alias("target")).distinct(), onwards=True))


@query(f"WITH {FRAMES} SELECT DISTINCT stream_id, CAST(6 AS BIGINT) AS pos, 'packet.payload_corrupt' AS element FROM f WHERE pos = 6")
def strict_faults(spark, d):
    p = PK.payloads(PK.damage(clips.element_streams(spark, d), every=7))
    return D.decode_strict(p)[1]


_PARTS = """parts AS (SELECT stream_id, pos AS frame_index, 'structure' AS kind, NULL AS mode, NULL AS reference, NULL AS mv_x, NULL AS mv_y, 0 AS dc_energy FROM mv
UNION ALL SELECT stream_id, pos, CASE WHEN nth IN (0, 4) THEN 'intra' WHEN nth = 1 THEN 'skip' ELSE 'inter' END, CASE WHEN nth IN (0, 4) THEN 'dc' WHEN nth = 1 THEN 'skip' ELSE 'inter' END, CASE WHEN nth IN (1, 2) THEN 'last' WHEN nth = 3 THEN 'golden' END,
  CASE nth WHEN 2 THEN m0 WHEN 3 THEN m1 END, CASE nth WHEN 2 THEN m1 WHEN 3 THEN m0 END, CASE WHEN nth IN (0, 4) THEN abs(v[1] - 128) + abs(v[4] - 128) + abs(v[7] - 128) + abs(v[10] - 128) + abs(v[13] - 128) + abs(v[14] - 128) ELSE 0 END FROM mv)"""


@query(f"WITH {FRAMES}, {_PARTS} SELECT stream_id, frame_index, 0 AS x, 0 AS y, 64 AS size, kind, mode, reference, CAST(mv_x AS INTEGER) AS mv_x, CAST(mv_y AS INTEGER) AS mv_y, CAST(dc_energy AS BIGINT) AS dc_energy FROM parts")
def payload_elements(spark, d):
    """Every element of the payloads, read back: kinds, modes, references, vectors and the energy of the levels."""
    return D.probe_blocks(D.probe(_packets(spark, d))).drop("modeled_entropy_q16", "emitted_payload_bytes")


@query(f"WITH {FRAMES} SELECT stream_id, pos AS frame_index, nth = 0 AS key, nth IN (0, 2) AS golden_refresh, {clips.QP} AS qp, TRUE AS canonical_payload_match, NULL::BIGINT AS first_mismatch_offset, TRUE AS adds_up FROM f")
def probe_reports(spark, d):
    r = D.probe(_packets(spark, d))
    parts = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["emitted_payload_bytes"])
    return r.select("stream_id", "frame_index", "key", "golden_refresh", "qp", "canonical_payload_match", "first_mismatch_offset", (parts + F.col("frame_flush_bytes") == F.col("input_payload_len")).alias("adds_up"))


@query(f"WITH {FRAMES}, {_PARTS} SELECT stream_id, frame_index, '420jpeg' AS chroma, kind, mode, reference, CAST(mv_x AS VARCHAR) AS mv_x, CAST(dc_energy AS VARCHAR) AS dc_energy FROM (SELECT * REPLACE (CASE WHEN kind = 'intra' THEN mode END AS mode) FROM parts WHERE kind <> 'structure')")
def probe_json(spark, d):
    j = D.probe_json(D.probe(_packets(spark, d)))
    at = lambda path, name: F.get_json_object("report", path).alias(name)
    block = "$.frame.superblocks[0].cbs[0]"
    return j.select("stream_id", "frame_index", at("$.stream.chroma", "chroma"), at(f"{block}.prediction.kind", "kind"), at(f"{block}.prediction.mode", "mode"), at(f"{block}.prediction.reference", "reference"), at(f"{block}.prediction.mv_q4[0]", "mv_x"), at(f"{block}.dc_energy", "dc_energy"))


_LEVELS14 = "[" + ", ".join(f"abs(v[{i}] - 128)" for i in range(1, 15)) + "]"
_MET = {
    "partition_tree": "TRUE", "skip": "nth > 0", "is_inter": "nth > 1", "intra_mode": "i", "ref_select": "nth BETWEEN 1 AND 3", "mvd": "nth IN (2, 3)", "has_coeff": "nth <> 1", "last_x": "i AND most > 0", "last_y": "i AND most > 0",
    "sig": "i AND list_max([m[2], m[3], m[5], m[6], m[8], m[9], m[11], m[12]]) > 0", "gt1": "i AND most > 0", "gt2": "i AND most > 1", "magnitude_remainder": "i AND most > 2", "nonzero_sign": "i AND most > 0",
}


@query(f"WITH {FRAMES}, m AS (SELECT nth, nth IN (0, 4) AS i, {_LEVELS14} AS m, list_max({_LEVELS14}) AS most FROM f), e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS element, count(*) AS pictures FROM m WHERE {v}" for k, v in _MET.items()) + ") SELECT * FROM e WHERE pictures > 0")
def syntax_coverage(spark, d):
    return D.coverage(_packets(spark, d))[1]


# -- prediction on 8 x 8 planes, all four 4 x 4 blocks ----------------------------

_PLANES = SAMPLES + ", b AS (SELECT block_id, list(v ORDER BY i) AS v FROM samples GROUP BY block_id), corners AS (SELECT block_id, v, CAST(p % 2 * 4 AS INTEGER) AS x, CAST(p // 2 * 4 AS INTEGER) AS y FROM b, (SELECT unnest(range(4)) AS p))"
_NEIGHBOURS = _PLANES + """, n AS (SELECT *, CASE WHEN y > 0 THEN list_transform(range(9), lambda k: v[(y - 1) * 8 + least(x + k, 7) + 1]) END AS top, CASE WHEN x > 0 THEN list_transform(range(9), lambda k: v[least(y + k, 7) * 8 + x]) END AS beside FROM corners),
nb AS (SELECT block_id, x, y, top, beside, coalesce(top, list_transform(range(9), lambda k: coalesce(beside[1], 128))) AS t, coalesce(beside, list_transform(range(9), lambda k: coalesce(top[1], 128))) AS l FROM n),
q AS (SELECT *, list_concat(list_reverse(l), t) AS line, CAST(i // 4 AS INTEGER) AS r, CAST(i % 4 AS INTEGER) AS c, i FROM nb, (SELECT unnest(range(16)) AS i))"""


def _angular(angle: int) -> str:
    at = f"(c * 32 + (r + 1) * {angle})"
    s = lambda add: f"line[greatest(-9, least(8, CAST(floor({at} / 32) AS INTEGER) + {add})) + 10]"
    part = f"(({at} % 32 + 32) % 32)"
    return f"(((32 - {part}) * {s(0)} + {part} * {s(1)} + 16) // 32)"


_MODES = {
    "dc": "CASE WHEN top IS NULL AND beside IS NULL THEN 128 WHEN top IS NULL THEN (l[1] + l[2] + l[3] + l[4] + 2) // 4 WHEN beside IS NULL THEN (t[1] + t[2] + t[3] + t[4] + 2) // 4 ELSE (l[1] + l[2] + l[3] + l[4] + t[1] + t[2] + t[3] + t[4] + 4) // 8 END",
    "planar": "((3 - c) * l[r + 1] + (c + 1) * t[5] + (3 - r) * t[c + 1] + (r + 1) * l[5] + 4) // 8", "horizontal": "l[r + 1]", "vertical": "t[c + 1]", **{m: _angular(a) for m, a in C.ANGLES.items()},
}


def _four(spark, d):
    p = clips.small_pictures(spark, d).select(F.col("picture").alias("block_id"), "width", "height", F.col("y").alias("plane"))
    corners = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for y in (0, 4) for x in (0, 4)]))
    return p.withColumn("at", corners).select("block_id", "width", "height", "plane", "at.x", "at.y", F.lit(4).alias("size"))


def _joined(df, *columns):
    return df.select(*columns, F.concat_ws(",", F.transform("predicted", lambda p: p.cast("string"))).alias("predicted"))


@query(f"WITH {_NEIGHBOURS} " + " UNION ALL ".join(f"SELECT block_id, x, y, '{m}' AS mode, string_agg(CAST({e} AS INTEGER), ',' ORDER BY i) AS predicted FROM q GROUP BY block_id, x, y" for m, e in _MODES.items()))
def intra_edges(spark, d):
    """All eight modes for blocks with both, one or no neighbours, and at the plane's edge."""
    modes = F.explode(F.array(*[F.lit(m) for m in C.INTRA_MODES]))
    return _joined(D.predicted(_four(spark, d).withColumn("mode", modes)), "block_id", "x", "y", "mode")


def _staged(samples: list[str], part: str, phases: int) -> str:
    """SQL of a stage: six samples around a place, a phase."""
    here, after = f"32 * ({samples[2]})", f"32 * ({samples[3]})"
    half = "(" + " + ".join(f"{t} * ({s})" for t, s in zip(C.FILTER_TAPS, samples, strict=True)) + ")"
    m = phases // 2
    blend = lambda a, b, w: f"CAST(floor((({a}) * ({m} - ({w})) + ({b}) * ({w}) + {m // 2}) / {float(m)}) AS BIGINT)"
    return f"CASE WHEN {part} = 0 THEN {here} WHEN {part} <= {m} THEN {blend(here, half, part)} ELSE {blend(half, after, f'{part} - {m}')} END"


def _moved(phases: int) -> str:
    flat = lambda k: _staged([f"v[greatest(0, least(7, yy + {k - 2})) * 8 + greatest(0, least(7, xx + {j - 2})) + 1]" for j in range(6)], "px", phases)
    return f"""m AS (SELECT *, block_id % 33 - 16 AS mv_x, block_id % 29 - 14 AS mv_y, i FROM corners, (SELECT unnest(range(16)) AS i)),
o AS (SELECT *, x + i % 4 + CAST(floor(mv_x / {float(phases)}) AS BIGINT) AS xx, y + i // 4 + CAST(floor(mv_y / {float(phases)}) AS BIGINT) AS yy, (mv_x % {phases} + {phases}) % {phases} AS px, (mv_y % {phases} + {phases}) % {phases} AS py FROM m),
s AS (SELECT *, {", ".join(f"{flat(k)} AS s{k}" for k in range(6))} FROM o),
z AS (SELECT *, {_staged([f"s{k}" for k in range(6)], "py", phases)} AS deep FROM s)
SELECT block_id, x, y, {phases} AS phases, string_agg(CAST(greatest(0, least(255, (deep + 512) >> 10)) AS INTEGER), ',' ORDER BY i) AS predicted FROM z GROUP BY block_id, x, y"""


@query(f"WITH {_PLANES} SELECT * FROM (WITH {_moved(4)}) UNION ALL SELECT * FROM (WITH {_moved(8)})")
def inter_predict(spark, d):
    """Quarter- and eighth-sample prediction of 4 x 4 blocks, over the plane's edge as well."""
    b = _four(spark, d).withColumns({"mode": F.lit(None).cast("string"), "mv_x": (F.col("block_id") % 33 - 16).cast("int"), "mv_y": (F.col("block_id") % 29 - 14).cast("int"), "phases": F.explode(F.array(F.lit(4), F.lit(8)))})
    return _joined(D.predicted(b), "block_id", "x", "y", "phases")


_TO_W, _TO_H = "(4 + 2 * (block_id % 6))", "(4 + 2 * (block_id % 5))"


@query(f"WITH {SAMPLES} SELECT block_id AS picture, CAST({_TO_W} AS INTEGER) AS width, CAST({_TO_H} AS INTEGER) AS height, string_agg(format('{{:02X}}', v[least(r, 7) * 8 + least(c, 7) + 1]), '' ORDER BY r, c) AS luma FROM (SELECT block_id, list(v ORDER BY i) AS v FROM samples GROUP BY block_id), (SELECT unnest(range(16)) AS r), (SELECT unnest(range(16)) AS c) WHERE r < {_TO_H} AND c < {_TO_W} GROUP BY block_id")
def crop_pad(spark, d):
    p = clips.small_pictures(spark, d)
    w, h = ((F.lit(4) + 2 * (F.col("picture") % n)).cast("int") for n in (6, 5))
    return D.resized(p, w, h).select("picture", "width", "height", F.hex("y").alias("luma"))


# -- loop filter of whole pictures --------------------------------------------------

_TILED = SAMPLES + """, p AS (SELECT DISTINCT block_id // 64 AS picture FROM samples), grid AS (SELECT picture, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM p, (SELECT unnest(range(64)) AS x), (SELECT unnest(range(64)) AS y)),
px AS (SELECT picture, grid.x, grid.y, coalesce(s.v, 128) AS v FROM grid LEFT JOIN samples s ON s.block_id = picture * 64 + grid.y // 8 * 8 + grid.x // 8 AND s.i = grid.y % 8 * 8 + grid.x % 8),
quarters AS (SELECT picture, CASE WHEN picture % 4 = 3 THEN 0 ELSE CAST(k % 2 * 32 AS INTEGER) END AS qx, CASE WHEN picture % 4 = 3 THEN 0 ELSE CAST(k // 2 * 32 AS INTEGER) END AS qy, CASE WHEN picture % 4 = 3 THEN 64 ELSE [32, 16, 8][(picture + k) % 3 + 1] END AS size FROM p, (SELECT unnest(range(4)) AS k) WHERE picture % 4 <> 3 OR k = 0),
blocks AS (SELECT picture, qx + dx * size AS x, qy + dy * size AS y, size FROM quarters, (SELECT CAST(unnest(range(4)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(4)) AS INTEGER) AS dy) WHERE dx * size < greatest(32, size) AND dy * size < greatest(32, size)),
b AS (SELECT *, (picture + x // 8 + y // 8) % 3 = 0 AS intra, (picture + x // 8) % 2 = 0 AS coded FROM blocks),
e AS (SELECT a.picture, TRUE AS vertical, a.x + a.size AS line, a.y AS start, a.size AS length, a.intra OR o.intra AS intra, a.coded OR o.coded AS coded, 'coding_block' AS kind FROM b a JOIN b o ON o.picture = a.picture AND a.x + a.size >= o.x AND a.x + a.size < o.x + o.size AND a.y >= o.y AND a.y < o.y + o.size
  UNION ALL SELECT a.picture, FALSE, a.y + a.size, a.x, a.size, a.intra OR o.intra, a.coded OR o.coded, 'coding_block' FROM b a JOIN b o ON o.picture = a.picture AND a.y + a.size >= o.y AND a.y + a.size < o.y + o.size AND a.x >= o.x AND a.x < o.x + o.size
  UNION ALL SELECT picture, vertical, CASE WHEN vertical THEN x ELSE y END + 32, CASE WHEN vertical THEN y ELSE x END, 64, intra, coded, 'derived_transform' FROM b, (VALUES (TRUE), (FALSE)) d(vertical) WHERE size = 64),
strong AS (SELECT *, CASE WHEN intra THEN 2 WHEN kind = 'coding_block' OR coded THEN 1 ELSE 0 END AS s FROM e)"""


def _pass(source: str, edges: str, vertical: bool, chroma: bool) -> str:
    """SQL of one pass: samples across every edge, filtered, put back."""
    a, b = ("x", "y") if vertical else ("y", "x")
    tables = {n: f"{_sql_table(t)}[CAST(20 + picture % 40 AS INTEGER) + 1]" for n, t in (("alpha", C.ALPHA), ("beta", C.BETA), ("tc", C.TC))}
    level = "least(s, 1)" if chroma else "s"
    names = ["p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"]
    strong = ["(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) // 8", "(p2 + p1 + p0 + q0 + 2) // 4", "(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) // 8", "(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) // 8", "(p0 + q0 + q1 + q2 + 2) // 4", "(p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) // 8"]
    return f"""SELECT o.picture, o.x, o.y, CAST(greatest(0, least(255, coalesce(f.v, o.v))) AS INTEGER) AS v FROM {source} o LEFT JOIN (
  WITH l AS (SELECT c.picture, c.line, z.{b} AS k, any_value({level}) AS s, {", ".join(f"max(z.v) FILTER (z.{a} = c.line + {i - 4}) AS {n}" for i, n in enumerate(names))} FROM {edges} c JOIN {source} z ON z.picture = c.picture AND z.{b} >= c.start AND z.{b} < c.start + c.length AND z.{a} BETWEEN c.line - 4 AND c.line + 3 WHERE c.vertical = {vertical} GROUP BY c.picture, c.line, z.{b}),
  t AS (SELECT *, least(greatest(((q0 - p0) * 4 + (p1 - q1) + 4) >> 3, -{tables["tc"]}), {tables["tc"]}) AS dl FROM l WHERE s > 0 AND abs(p0 - q0) < {tables["alpha"]} AND abs(p1 - p0) < {tables["beta"]} AND abs(q1 - q0) < {tables["beta"]})
  SELECT picture, line + d AS {a}, k AS {b}, CASE WHEN s = 2 THEN [{", ".join(strong)}][d + 4] WHEN d = -1 THEN p0 + dl WHEN d = 0 THEN q0 - dl END AS v FROM t, (SELECT CAST(unnest(range(-3, 3)) AS INTEGER) AS d)
) f ON f.picture = o.picture AND f.x = o.x AND f.y = o.y"""


_FILTERED = f"""{_TILED}, v1 AS ({_pass("px", "strong", True, False)}), v2 AS ({_pass("v1", "strong", False, False)}),
ce AS (SELECT picture, vertical, line // 2 AS line, start // 2 AS start, length // 2 AS length, s FROM strong WHERE length >= 16 AND line % 2 = 0 AND start % 2 = 0),
cpx AS (SELECT picture, x // 2 AS x, y // 2 AS y, v FROM px WHERE x % 2 = 0 AND y % 2 = 0), c1 AS ({_pass("cpx", "ce", True, True)}), c2 AS ({_pass("c1", "ce", False, True)})"""


@query(f"""WITH {_FILTERED} SELECT 'y' AS plane, picture, y AS line, string_agg(v, ',' ORDER BY x) AS samples FROM v2 GROUP BY picture, y UNION ALL SELECT 'cb', picture, y, string_agg(v, ',' ORDER BY x) FROM c2 GROUP BY picture, y""")
def deblock_frame(spark, d):
    """Whole pictures through the loop filter: mixed block sizes, inner edges of 64-pixel blocks, chroma."""
    out = D.deblocked(clips.tiled_pictures(spark, d))

    def lines(plane: str, width: int):
        at = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
        rows = out.select("picture", F.col(plane).alias("p")).select("picture", "p", at.alias("line"))
        samples = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.conv(F.hex(F.substring("p", (F.col("line") * width + x + 1).cast("int"), F.lit(1))), 16, 10))
        return rows.select(F.lit(plane).alias("plane"), "picture", "line", F.concat_ws(",", samples).alias("samples"))

    return lines("y", 64).unionByName(lines("cb", 32))


# -- reports, manifests, bits, generators ----------------------------------------------


def _documents(spark, d):
    """Campaign reports, one for each clip of the curves, as JSON texts; every third is of another format."""
    p = V.curves(spark, d)
    points = F.sort_array(F.collect_list(F.struct("quality", "rate")))
    c = p.groupBy("clip", "toolset").agg(points.alias("points"))
    curve = F.struct("clip", "toolset", F.lit(176).alias("width"), F.lit(144).alias("height"), F.lit(24).alias("frames"), F.when(F.col("toolset") == "F", F.lit("1.5")).alias("bd_rate_percent"), "points")
    r = c.groupBy("clip").agg(F.sort_array(F.collect_list(curve)).alias("curves"))
    kind = F.when(F.col("clip") == "N", "another").otherwise("key-frame-rd-campaign-v1")
    return r.select("clip", F.to_json(F.struct(kind.alias("format"), F.lit("1.0").alias("encoder_version"), "curves")).alias("text"))


@query(f"WITH {_Q.CURVES} SELECT clip, toolset, rate, quality, CASE WHEN toolset = 'F' THEN 1.5 END AS bd_rate_percent FROM points WHERE clip <> 'N'")
def campaign_points(spark, d):
    """Campaign reports read by schema; those of another format are refused."""
    rows = R.curves(R.campaigns(_documents(spark, d)))
    return rows.select("clip", "toolset", "bd_rate_percent", F.explode("points").alias("p")).select("clip", "toolset", "p.rate", "p.quality", "bd_rate_percent")


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'no points' WHEN l_linenumber = 2 THEN 'point 1 lacks a number' END AS refused, CASE WHEN l_linenumber = 1 THEN -1 WHEN l_linenumber = 2 THEN 2 ELSE 1 END AS points FROM lineitem")
def curve_files(spark, d):
    """Curve files: bare arrays, objects with points, and what is refused."""
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity")
    point = F.format_string('{"rate": %s, "quality": 30.5, "qp": 3}', F.col("l_quantity").cast("string"))
    text = F.when(F.col("n") == 1, F.lit('{"note": []}')).when(F.col("n") == 2, F.concat(F.lit("["), point, F.lit(', {"rate": 4}]'))).when(F.col("n") % 2 == 1, F.concat(F.lit('{"points": ['), point, F.lit("]}"))).otherwise(F.concat(F.lit(" ["), point, F.lit("]")))
    return R.curve_files(li.withColumn("text", text)).select("k", "n", "refused", F.coalesce(F.size("points"), F.lit(-1)).alias("points"))


@query("SELECT s_name AS name, 's' || s_suppkey || '.y4m' AS file, CAST(64 + s_suppkey % 9 * 2 AS INTEGER) AS width, CAST(64 AS INTEGER) AS height, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_nationkey AS INTEGER) END AS frames, CASE WHEN s_suppkey % 4 = 0 THEN 'frames' END AS missing FROM supplier")
def manifest_clips(spark, d):
    """Manifests, one a nation, read line by line: quoted and bare values, comments, a table that ends a clip."""
    s = V.table(spark, d, "supplier")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = F.col("s_suppkey").cast("string")
    clip = F.array(
        F.lit("[[clips]]"), F.concat(F.lit("name = "), q(F.col("s_name")), F.lit(" # the = clip")), F.concat(F.lit("  file="), q(F.concat(F.lit("s"), key, F.lit(".y4m")))), F.concat(F.lit("width = "), (64 + F.col("s_suppkey") % 9 * 2).cast("string"), F.lit("  # wide")),
        F.lit("height = 64"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("frames = "), F.col("s_nationkey").cast("string"))).otherwise("# frames = 9"), F.lit("[other]"), F.lit("width = 1"),
    )
    lines = s.select(F.col("s_nationkey").alias("path"), "s_suppkey", F.posexplode(clip).alias("i", "line")).select("path", (F.col("s_suppkey") * 8 + F.col("i")).alias("n"), "line")
    return R.pinned_clips(lines).select("name", "file", "width", "height", "frames", "missing")


@query("SELECT l_orderkey AS k, l_linenumber AS n, format('{:06X}', CAST((l_partkey % 2048 * 32 + l_suppkey % 32) * 256 + l_linenumber AS BIGINT)) AS packed, l_partkey % 2048 AS a, l_suppkey % 32 AS b, CAST(l_linenumber AS BIGINT) AS c FROM lineitem")
def bit_fields(spark, d):
    """Fields of 11, 5 and 8 bits written one after another, and read back."""
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey")
    p = li.withColumn("bytes", bits.packed([(F.col("l_partkey") % 2048, 11), (F.col("l_suppkey") % 32, 5), (F.col("n"), 8)]))
    a, b, c = bits.unpacked(F.col("bytes"), [11, 5, 8])
    return p.select("k", "n", F.hex("bytes").alias("packed"), a.alias("a"), b.alias("b"), c.alias("c"))


_WIDE, _HIGH, _LONG = 80, 64, 12


@query(f"""WITH g AS (SELECT f AS frame, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT unnest(range({_LONG})) AS f), (SELECT unnest(range({_WIDE})) AS x), (SELECT unnest(range({_HIGH})) AS y)),
v AS (SELECT *, ((x * 3 + y * 2) % 256 + CASE WHEN (x // 16 + y // 16) % 2 = 0 THEN 16 ELSE 0 END) % 256 AS r FROM g)
SELECT frame, 'fade' AS pattern, md5(string_agg(format('{{:02X}}', CAST(r * ({_LONG - 1} - frame) // {_LONG - 1} AS INTEGER)), '' ORDER BY y, x)) AS luma FROM v GROUP BY frame
UNION ALL SELECT frame, 'gradient', md5(string_agg(format('{{:02X}}', CAST(r AS INTEGER)), '' ORDER BY y, x)) FROM v GROUP BY frame
UNION ALL SELECT frame, 'flat', md5(repeat('80', {_WIDE * _HIGH})) FROM (SELECT DISTINCT frame FROM g)""")
def generated_clips(spark, d):
    """Generated clips whose samples are a rule of place and frame."""
    out = None
    for pattern in ("fade", "gradient", "flat"):
        c = synthetic.clip(spark, pattern, _WIDE, _HIGH, _LONG).select("frame", F.lit(pattern).alias("pattern"), F.md5(F.hex("y").cast("binary")).alias("luma"))
        out = c if out is None else out.unionByName(c)
    return out


_BAD = "CASE WHEN f.user_id % 5 = 0 THEN 'the clips have ' || n || ' and ' || n - 1 || ' frames' WHEN f.user_id % 5 = 1 THEN 'frame 0 is 64x64 against 64x66' END"


@query(f"WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT user_id AS clip, {_BAD} AS refused FROM f) SELECT * FROM c WHERE refused IS NOT NULL")
def check_pairs(spark, d):
    """Clips that cannot be compared, and why."""
    e = V.packets(spark, d).select(F.col("stream_id").alias("clip"), F.col("pos").alias("frame"))
    last = F.max("frame").over(Window.partitionBy("clip"))
    left = e.withColumns({"width": F.lit(64), "height": F.lit(64)})
    right = e.withColumn("last", last).where("clip % 5 <> 0 or frame < last").select("clip", "frame", F.lit(64).alias("width"), F.when((F.col("clip") % 5 == 1) & (F.col("frame") == 0), 66).otherwise(64).alias("height"))
    return quality.check_pair(left, right)


_CRC = "[" + ", ".join(str(x) for x in crc_table()) + "]"
ORACLES["crc32c_payload"] = f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, {_CRC}[(xor(c, x) & 255) + 1])) AS c FROM b)
SELECT d.doc_id, xor(c.c, 4294967295) AS crc32c FROM documents d LEFT JOIN c USING (doc_id)"""
_INNER = SAMPLES + ", b AS (SELECT block_id, list(v ORDER BY i) AS v FROM samples GROUP BY block_id), n AS (SELECT *, list_transform(range(9), lambda k: v[least(k + 1, 7) + 1]) AS t, list_transform(range(9), lambda k: v[least(k + 1, 7) * 8 + 1]) AS l FROM b), q AS (SELECT *, list_concat(list_reverse(l), t) AS line, CAST(i // 4 AS INTEGER) AS r, CAST(i % 4 AS INTEGER) AS c, v[(i // 4 + 1) * 8 + i % 4 + 2] AS own FROM n, (SELECT unnest(range(16)) AS i))"
ORACLES["intra_angular"] = f"WITH {_INNER} " + " UNION ALL ".join(
    f"SELECT block_id, '{m}' AS mode, {k} AS \"order\", CAST(sum((own - p) * (own - p)) AS BIGINT) AS cost, string_agg(p, ',' ORDER BY i) AS predicted FROM (SELECT *, CAST({_angular(a)} AS INTEGER) AS p FROM q) GROUP BY block_id" for k, (m, a) in enumerate(C.ANGLES.items())
)


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(CASE WHEN m < 0 THEN -((-m + 2) // 4 * 4) ELSE (m + 2) // 4 * 4 END AS BIGINT) AS whole, CAST(l_partkey * 1000 + ((CAST(" + _sql_table(C.LAMBDA_Q8) + "[l_suppkey % 64 + 1] AS HUGEINT) * l_partkey * 65536 + 8388608) >> 24) AS HUGEINT)::VARCHAR AS cost FROM (SELECT *, l_partkey % 513 - 256 AS m FROM lineitem)")
def rate_distortion(spark, d):
    """Vectors to whole pixels; distortion and weighted bits in one number, for every quantizer."""
    li = V.table(spark, d, "lineitem")
    weight = N.table(C.LAMBDA_Q8, F.col("l_suppkey") % 64)
    cost = N.rd_cost(F.col("l_partkey") * 1000, weight, F.col("l_partkey") * 65536)
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), N.full_pel(F.col("l_partkey") % 513 - 256).alias("whole"), cost.cast("string").alias("cost"))


@query("SELECT vec_id // 8 AS stream_id, vec_id % 8 AS frame, vec_id % 8 % 4 = 0 AS key, TRUE AS same, 'shown' AS status FROM embeddings WHERE len(embedding) = 64")
def encode_decode(spark, d):
    """Every eight blocks a clip of 64 x 64 pictures (each block enlarged), coded and decoded: the decoder shows what the encoder saw."""
    coded = saved(encoding.encode(clips.enlarged(spark, d), 37, "no-split", key_interval=4))
    # pictures are compared by digests; a stored table says its packed size, so without the hint pictures may be sent through the driver
    digest = lambda name: F.sha2(name, 256).alias(f"{name}_sha256")
    seen = coded.select("stream_id", "frame", "key", digest("y"), digest("cb"))
    shown = D.decode(PK.payloads(encoding.streams(coded))).select("stream_id", F.col("frame_index").alias("frame"), "status", digest("y").alias("y2"), digest("cb").alias("cb2"))
    same = (F.col("y_sha256") == F.col("y2")) & (F.col("cb_sha256") == F.col("cb2"))
    return seen.join(shown.hint("merge"), ["stream_id", "frame"]).select("stream_id", "frame", "key", same.alias("same"), "status")


# -- verification -------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT stream_id, pos AS frame_index, pos - nth AS entry, nth + 1 AS decoded, TRUE AS same FROM f")
def seek_equivalence(spark, d):
    """Every frame, sought alone, against decoding from the start."""
    return VF.seek_equivalence(_packets(spark, d))


@query(f"WITH {FRAMES} SELECT DISTINCT stream_id, 'refused' AS outcome, 'sequence.header' AS element FROM f")
def header_damage(spark, d):
    """One bit turned over in every stream's header: none may decode."""
    return VF.damage_outcomes(clips.element_streams(spark, d), "header_fuzz", seed=11)


_PSNR = SAMPLES + """, pair AS (SELECT a.block_id // 8 AS clip, a.block_id, sum((a.v - b.v) * (a.v - b.v)) AS sse FROM samples a JOIN samples b ON b.block_id = a.block_id // 8 * 8 + (a.block_id + 1) % 8 AND b.i = a.i GROUP BY a.block_id),
whole AS (SELECT clip FROM pair GROUP BY clip HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT block_id FROM samples) s WHERE s.block_id // 8 = clip)),
m AS (SELECT clip, count(*) AS frames, CAST(sum(sse) AS DOUBLE) AS sse FROM pair JOIN whole USING (clip) GROUP BY clip)"""


def _turned(spark, d):
    """Clips of eight small pictures, and the same with each picture in its neighbour's place."""
    p = clips.small_pictures(spark, d).select(F.floor(F.col("picture") / 8).cast("string").alias("clip"), (F.col("picture") % 8).alias("frame"), "width", "height", "y")
    whole = p.groupBy("clip").count().where("count = 8").select("clip")
    p = p.join(whole, "clip")
    return p, p.withColumn("frame", (F.col("frame") + 7) % 8)


@query(f"WITH {_PSNR} SELECT CAST(clip AS VARCHAR) AS clip, frames, FALSE AS lossless, round(10 * log10(65025.0 * 64 * frames / sse), 6) AS global, 'PSNR-Y  ' || format('{{:.4f}}', 10 * log10(65025.0 * 64 * frames / sse)) || ' dB over ' || frames || ' frames' AS line FROM m WHERE frames = 8")
def quality_reports(spark, d):
    """Reports of clips against others, and the line that a report is read as."""
    r = VF.quality_reports(*_turned(spark, d), "psnr")
    at = lambda f, kind: F.get_json_object("report", f"$.{f}").cast(kind).alias(f)
    return r.select("clip", at("frames", "bigint"), at("lossless", "boolean"), F.round(F.get_json_object("report", "$.global").cast("double"), 6).alias("global"), VF.report_line(F.col("report")).alias("line"))


@query(f"WITH {_PSNR} SELECT CAST(clip AS VARCHAR) AS clip, f AS field FROM m, (SELECT unnest(['config_sha256', 'distorted_sha256', 'global', 'lossless', 'per_frame']) AS f) WHERE frames = 8")
def moved_fields(spark, d):
    """Reports recorded for a clip against itself, reproduced against another: what moved."""
    a, b = _turned(spark, d)
    return VF.moved_fields(VF.quality_reports(a, a, "psnr"), VF.quality_reports(a, b, "psnr")).select("clip", "field")


@query("SELECT user_id, event_id, event_id % 97 AS frame, CASE WHEN event_id % 3 = 0 THEN 'partition,motion' ELSE 'qp' END AS overlays, CASE WHEN event_id % 2 = 0 THEN 'modeled' ELSE 'emitted' END AS basis, CASE WHEN event_id % 5 = 0 THEN event_id % 64 END AS x, CASE WHEN event_id % 7 = 0 THEN 'curves' ELSE 'projection' END AS tab, CASE WHEN event_id % 11 = 0 THEN repeat('ab', 32) END AS stream FROM events WHERE event_id % 22 <> 0 OR event_id % 13 <> 0")
def view_fragments(spark, d):
    """Bookmarks written and read back; bound ones with a field of their own are refused."""
    e = V.table(spark, d, "events").select("user_id", "event_id")
    k = F.col("event_id")
    overlays = F.when(k % 3 == 0, F.array(F.lit("partition"), F.lit("motion"))).otherwise(F.array(F.lit("qp")))
    x = F.when(k % 5 == 0, k % 64)
    text = FR.encoded(k % 97, overlays, F.when(k % 2 == 0, "modeled").otherwise("emitted"), x, x, F.when(k % 7 == 0, "curves").otherwise("projection"), F.when(k % 11 == 0, F.lit("AB" * 32)))
    text = F.when((k % 22 == 0) & (k % 13 == 0), F.concat(text, F.lit("&z=1"))).otherwise(text)
    # a row's bookmark is written once and read once, whatever is asked of it: nothing is moved across an exploded column
    v = e.select("user_id", "event_id", F.explode(F.array(F.concat(F.lit("#"), text))).alias("text")).select("user_id", "event_id", F.explode(F.array(FR.decoded(F.col("text")))).alias("v")).where("v is not null")
    return v.select("user_id", "event_id", "v.frame", F.array_join("v.overlays", ",").alias("overlays"), "v.basis", "v.x", "v.tab", "v.stream")


@query(f"WITH {FRAMES}, {_PARTS} SELECT stream_id, frame_index, CASE kind WHEN 'intra' THEN 'intra ' || mode WHEN 'skip' THEN 'skip ' || reference ELSE 'inter ' || reference || ' mv [' || mv_x || ', ' || mv_y || ']' END AS said FROM parts WHERE kind <> 'structure'")
def probe_lines(spark, d):
    """What predicted each block, in words; the bar and the place before it are fixed for these blocks."""
    lines = VF.probe_lines(D.probe_blocks(D.probe(_packets(spark, d))))
    return lines.select("stream_id", "frame_index", F.regexp_extract("line", r"^######## 64x64 at \(  0,  0\)  (.*)  modelled [0-9]+\.[0-9][0-9] bits$", 1).alias("said"))


@query(f"WITH {FRAMES} SELECT stream_id, pos AS frame_index, 'qp,show' AS broken FROM f WHERE nth = 1")
def probe_faults(spark, d):
    """Probe reports against the rules of their form; one in five is made to break two."""
    j = D.probe_json(D.probe(_packets(spark, d)))
    broken = F.regexp_replace(F.regexp_replace("report", '"qp":[0-9]+,"input', '"qp":99,"input'), '"show":true', '"show":false')
    j = j.withColumn("report", F.when(F.col("frame_index") % 5 == 1, broken).otherwise(F.col("report")))
    return VF.probe_faults(j, "report").select("stream_id", "frame_index", F.array_join("broken", ",").alias("broken"))


@query(f"WITH {PIXELS}, t AS (SELECT stream_id, pos, {_FATE} AS status FROM f) SELECT t.stream_id, t.pos, t.status, CASE WHEN status = 'shown' THEN luma END AS luma FROM t JOIN shown s ON s.stream_id = t.stream_id AND s.frame_index = t.pos")
def decode_stream(spark, d):
    """The streaming form of ``decode_damaged``: packets written as files and read as a stream, one batch; same rows."""
    damaged = PK.payloads(PK.damage(clips.element_streams(spark, d), every=7))
    return run_to_table(spark, damaged, streaming.decode, batch_rows=streaming.PART_ROWS).select("stream_id", "pos", "status", F.md5(F.hex("y").cast("binary")).alias("luma"))
