"""Registered queries of the codec operators, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions.hashing import crc32c_column
from .operators import coding, folds, ledger, prediction, quality, recovery
from .plans import constants as C
from .sources import packets as PK
from .sources import views as V
from .streaming import recovery as streaming

QP = 27
TARGET_BPS = 60_000

# SQL of the views over the test tables.
PACKETS = """packets AS (
  SELECT user_id AS stream_id, CAST(row_number() OVER w - 1 AS BIGINT) AS pos,
    CAST(row_number() OVER w - 1 + sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frame_index,
    event_type = 'signup' AS key, event_type = 'error' AS crc_bad, event_id % 29 = 0 AS dec_bad, CAST(floor(value * 100) AS BIGINT) AS bits
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
SAMPLES = """samples AS (
  SELECT vec_id AS block_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(i AS INTEGER) AS i,
    CAST(greatest(0, least(255, floor(CAST(embedding[i + 1] AS DOUBLE) * 128 + 128))) AS INTEGER) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) = 64)"""
PAIRS = SAMPLES + """, pairs AS (SELECT a.block_id AS frame, a.y, a.x, a.i, a.v AS ref, b.v AS dist FROM samples a JOIN samples b ON b.block_id = a.block_id + 1 AND b.i = a.i)"""
CURVES = """points AS (
  SELECT clip, toolset, pow(1.5, CAST(q AS DOUBLE)) * sqrt(CAST(n AS DOUBLE)) AS rate, 28.0::DOUBLE + q * 2.5 + (n % 7) * 0.1::DOUBLE AS quality
  FROM (SELECT l_returnflag AS clip, l_linestatus AS toolset, floor(l_quantity / 9) AS q, count(*) AS n FROM lineitem GROUP BY ALL))"""
MOTION = """blocks AS (
  SELECT frame, nth % 16 * 8 AS x, nth // 16 * 8 AS y, ref, mv_x, mv_y FROM (
    SELECT l_orderkey // 32 AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS nth,
      CASE WHEN l_partkey % 5 <> 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'golden' ELSE 'last' END END AS ref, l_partkey % 65 - 32 AS mv_x, l_suppkey % 33 - 16 AS mv_y FROM lineitem))"""
DCT = """m AS (SELECT k, x, CAST(CASE WHEN k = 0 THEN 64 ELSE round(64 * sqrt(2.0) * cos(pi() * (2 * x + 1) * k / 16)) END AS BIGINT) AS w FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(8)) AS x))"""


def _shift(e: str, bits: int) -> str:
    return f"(CASE WHEN ({e}) < 0 THEN -((abs({e}) + {1 << (bits - 1)}) >> {bits}) ELSE (abs({e}) + {1 << (bits - 1)}) >> {bits} END)"


MEANS = "means AS (SELECT block_id, CAST(floor((sum(v) + 32) / 64) AS INTEGER) AS mean FROM samples GROUP BY block_id)"
COEFS = (
    SAMPLES + ", " + DCT + ", " + MEANS
    + f""", h AS (SELECT s.block_id, s.y, m.k AS fx, {_shift("CAST(sum(m.w * (s.v - mean)) AS BIGINT)", 4)} AS t FROM samples s JOIN means USING (block_id) JOIN m ON m.x = s.x GROUP BY s.block_id, s.y, m.k),
coefs AS (SELECT block_id, m.k AS fy, fx, {_shift("CAST(sum(m.w * t) AS BIGINT)", 11)} AS c FROM h JOIN m ON m.x = h.y GROUP BY block_id, m.k, fx)"""
)
SCALE = C.QSCALE[QP]
LEVELS = COEFS + f""", levels AS (SELECT block_id, fy, fx, CAST(sign(c) * least((16 * abs(c) + {SCALE // 2}) // {SCALE}, 32767) AS BIGINT) AS level FROM coefs)"""
SCAN = "scan(pos, x, y) AS (VALUES " + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(C.diagonal_scan(8))) + ")"
SCANNED = LEVELS + ", " + SCAN + ", scanned AS (SELECT l.block_id, s.pos, s.x, s.y, l.level FROM levels l JOIN scan s ON s.x = l.fx AND s.y = l.fy)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {PACKETS}, e AS (SELECT stream_id, frame_index, last_value(CASE WHEN key THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS entry FROM packets)
SELECT stream_id, frame_index, entry, frame_index - entry + 1 AS cost FROM e""")
def seek_entry_points(spark, d):
    return recovery.seek_entries(V.packets(spark, d))


@query(f"""WITH {PACKETS}, e AS (SELECT stream_id, frame_index, last_value(CASE WHEN key THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS entry FROM packets),
t AS (SELECT stream_id, max(frame_index) AS target FROM packets GROUP BY stream_id)
SELECT p.stream_id, t.target, p.frame_index, p.key FROM packets p JOIN t USING (stream_id) JOIN e ON e.stream_id = t.stream_id AND e.frame_index = t.target WHERE p.frame_index BETWEEN e.entry AND t.target""")
def seek_last_frame(spark, d):
    p = V.packets(spark, d)
    return recovery.seek(p, p.groupBy("stream_id").agg(F.max("frame_index").alias("target")))


_EXPECTED = "e AS (SELECT *, coalesce(lag(frame_index) OVER (PARTITION BY stream_id ORDER BY pos) + 1, 0) AS expected FROM packets)"


@query(f"WITH {PACKETS}, {_EXPECTED} SELECT stream_id, pos, frame_index, expected, frame_index - expected AS missing FROM e WHERE frame_index <> expected")
def packet_index_gaps(spark, d):
    return recovery.index_gaps(V.packets(spark, d))


_STATUS = f"""{PACKETS}, {_EXPECTED}, g AS (SELECT *, frame_index <> expected AS gap FROM e),
b AS (SELECT *, max(CASE WHEN gap OR crc_bad OR dec_bad THEN pos END) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS brk,
  max(CASE WHEN key AND NOT crc_bad AND NOT dec_bad THEN pos END) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS good FROM g),
s AS (SELECT stream_id, pos, frame_index, CASE WHEN crc_bad THEN 'corrupt' WHEN key THEN CASE WHEN dec_bad THEN 'corrupt' WHEN gap THEN CASE WHEN expected = 0 THEN 'recovered_leading_loss' ELSE 'recovered_gap' END ELSE 'shown' END
  WHEN good IS NULL OR gap OR good < brk THEN 'dependency_lost' WHEN dec_bad THEN 'corrupt' ELSE 'shown' END AS status FROM b)"""
_IMAGES = "('shown', 'recovered_gap', 'recovered_leading_loss')"


@query(f"WITH {_STATUS} SELECT * FROM s")
def packet_status(spark, d):
    return recovery.classify(V.packets(spark, d))


@query(f"WITH {_STATUS} SELECT * FROM s")
def recovery_stream(spark, d):
    """The streaming form, run over packets written as files and read as a stream, one batch; same rows as packet_status."""
    from .sources.stream_run import run_to_table

    return run_to_table(spark, V.packets(spark, d), streaming.classify)


@query(f"WITH {_STATUS} SELECT status, count(*) AS n, count(*) FILTER (status IN {_IMAGES}) AS images FROM s GROUP BY status")
def status_counts(spark, d):
    return recovery.status_counts(V.packets(spark, d))


@query(f"WITH {_STATUS}, t AS (SELECT stream_id, pos, status, last_value(CASE WHEN status IN {_IMAGES} THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS image FROM s) SELECT * FROM t WHERE image IS NOT NULL")
def display_timeline(spark, d):
    return recovery.timeline(V.packets(spark, d))


_GOP = "k AS (SELECT *, CAST(sum(CASE WHEN key THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gop FROM packets)"


@query(f"WITH {PACKETS}, {_GOP} SELECT stream_id, gop, min(frame_index) AS entry, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits FROM k WHERE gop > 0 GROUP BY stream_id, gop")
def gop_segments(spark, d):
    return recovery.gops(V.packets(spark, d))


@query(f"WITH {PACKETS}, {_GOP}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, gop ORDER BY pos) - CASE WHEN gop > 0 THEN 1 ELSE 0 END AS nth FROM k) SELECT stream_id, pos, key, key OR nth % 16 = 0 AS golden FROM n")
def golden_refresh(spark, d):
    return recovery.golden_refresh(V.packets(spark, d))


@query(f"WITH {PACKETS}, g AS (SELECT stream_id, count(*) FILTER (NOT crc_bad) AS intact, count(*) FILTER (crc_bad) AS damaged FROM packets GROUP BY stream_id) SELECT *, damaged = 0 AND intact > 0 AS sound FROM g")
def damaged_streams(spark, d):
    return recovery.damaged_streams(V.packets(spark, d))


@query(f"""WITH RECURSIVE {PACKETS}, r AS (
  SELECT stream_id, pos, TRUE AS key, TRUE AS golden, FALSE AS scene_cut, 0 AS since_key, 0 AS since_golden, CAST([] AS BIGINT[]) AS h FROM packets WHERE pos = 0
  UNION ALL SELECT stream_id, pos, key, golden, scene_cut, CASE WHEN key THEN 0 ELSE since_key END, CASE WHEN golden THEN 0 ELSE since_golden END, CASE WHEN key THEN CAST([] AS BIGINT[]) ELSE list_slice(list_append(h, bits), greatest(1, len(h) - 14), len(h) + 1) END FROM (
    SELECT *, key OR since_golden = 16 AS golden FROM (SELECT *, scene_cut OR since_key = 120 AS key FROM (
      SELECT p.stream_id, p.pos, p.bits, r.h, r.since_key + 1 AS since_key, r.since_golden + 1 AS since_golden,
        p.bits > 0 AND len(r.h) >= 4 AND p.bits * len(r.h) >= 3 * coalesce(list_sum(r.h), 0) AS scene_cut FROM r JOIN packets p ON p.stream_id = r.stream_id AND p.pos = r.pos + 1))))
SELECT stream_id, pos AS frame, key, golden, scene_cut FROM r""")
def scene_cuts(spark, d):
    return folds.plan_gops(V.transitions(spark, d))


@query(f"""WITH RECURSIVE {PACKETS}, r AS (SELECT stream_id, pos, bits >> 3 AS average FROM packets WHERE pos = 0
  UNION ALL SELECT p.stream_id, p.pos, CASE WHEN p.bits >= r.average THEN r.average + ((p.bits - r.average) >> 3) ELSE r.average - ((r.average - p.bits) >> 3) END FROM r JOIN packets p ON p.stream_id = r.stream_id AND p.pos = r.pos + 1)
SELECT stream_id, pos AS frame, average FROM r""")
def ewma_complexity(spark, d):
    return folds.complexity(V.transitions(spark, d))


_BUDGET = TARGET_BPS // 25
_CAP = 16 * _BUDGET << 16
_RC = f"""SELECT stream_id, pos, used, fill, average, CASE WHEN full_ < {_CAP // 3} THEN greatest(used - 2, 0) WHEN full_ > {2 * _CAP // 3} THEN least(used + 2, 63) ELSE used END AS next FROM (
  SELECT *, least(greatest(fill + CASE WHEN average = 0 THEN 0 WHEN bits > average + average // 4 THEN {_CAP // 16} WHEN bits < average - average // 4 THEN -{_CAP // 16} ELSE 0 END, 0), {_CAP}) AS full_ FROM (
    SELECT stream_id, pos, bits, used, least(greatest(fill + bits * 65536 - {_BUDGET << 16}, 0), {_CAP}) AS fill, CASE WHEN bits >= average THEN average + ((bits - average) >> 3) ELSE average - ((average - bits) >> 3) END AS average FROM ("""


@query(f"""WITH RECURSIVE {PACKETS}, r AS (
  {_RC} SELECT stream_id, pos, bits, CAST({C.first_qp(_BUDGET)} AS BIGINT) AS used, CAST({_CAP // 2} AS BIGINT) AS fill, CAST(0 AS BIGINT) AS average FROM packets WHERE pos = 0)))
  UNION ALL {_RC} SELECT p.stream_id, p.pos, p.bits, r.next AS used, r.fill, r.average FROM r JOIN packets p ON p.stream_id = r.stream_id AND p.pos = r.pos + 1))))
SELECT stream_id, pos, used AS qp, fill AS fill_q16, average FROM r""")
def leaky_bucket_qp(spark, d):
    return folds.leaky_bucket(V.packets(spark, d).withColumn("sad", F.col("bits")), TARGET_BPS)


@query(f"""WITH RECURSIVE {PACKETS}, r AS (SELECT stream_id, pos, CAST(2048 AS BIGINT) AS p1, bits % 3 = 0 AS symbol FROM packets WHERE pos = 0
  UNION ALL SELECT p.stream_id, p.pos, least(greatest(r.p1 + CASE WHEN r.symbol THEN (4096 - r.p1) >> 5 ELSE -((r.p1 + 31) >> 5) END, 1), 4095), p.bits % 3 = 0 FROM r JOIN packets p ON p.stream_id = r.stream_id AND p.pos = r.pos + 1)
SELECT stream_id, pos, p1 FROM r""")
def adapt_probability(spark, d):
    return folds.adapt(V.packets(spark, d).withColumn("symbol", F.col("bits") % 3 == 0))


@query(f"""WITH {PACKETS} SELECT stream_id, CAST(sum(CAST(floor(-log2((CASE WHEN bits % 3 = 0 THEN p ELSE 4096 - p END) / 4096.0::DOUBLE) * 65536 + 0.5) AS BIGINT)) AS BIGINT) AS cost_q16, count(*) AS bins FROM (SELECT *, CAST(1 + bits % 4095 AS DOUBLE) AS p FROM packets) GROUP BY stream_id""")
def modeled_entropy(spark, d):
    return coding.modelled_cost(V.packets(spark, d).select("stream_id", (F.col("bits") % 4095 + 1).alias("p1"), (F.col("bits") % 3 == 0).alias("symbol")))


_PSNR = "CASE WHEN sse > 0 THEN round(log10(65025.0::DOUBLE * n / sse) * 10.0, 9) END AS psnr"


@query(f"WITH {PAIRS}, f AS (SELECT frame, CAST(sum((ref - dist) * (ref - dist)) AS BIGINT) AS sse, count(*) AS n FROM pairs GROUP BY frame) SELECT frame, sse, n, {_PSNR}, sse = 0 AS lossless FROM f")
def psnr_frame(spark, d):
    return quality.psnr_frames(V.block_pairs(spark, d)).withColumn("psnr", F.round("psnr", 9))


@query(f"WITH {PAIRS}, f AS (SELECT count(DISTINCT frame) AS frames, CAST(sum((ref - dist) * (ref - dist)) AS BIGINT) AS sse, count(*) AS n FROM pairs) SELECT frames, sse, {_PSNR} FROM f")
def psnr_clip(spark, d):
    return quality.psnr_clip(V.block_pairs(spark, d)).withColumn("psnr", F.round("psnr", 9))


@query(f"WITH {SAMPLES}, o AS (SELECT clip, block_id, i, v, lag(v) OVER (PARTITION BY clip, i ORDER BY block_id) AS b FROM (SELECT *, block_id % 8 AS clip FROM samples)) SELECT clip, block_id AS frame, CAST(sum(abs(v - b)) AS BIGINT) AS sad FROM o GROUP BY clip, block_id")
def frame_sad(spark, d):
    return quality.frame_sad(V.blocks(spark, d).select((F.col("block_id") % 8).alias("clip"), F.col("block_id").alias("frame"), "v"))


_TAPS = "taps(t, w) AS (VALUES " + ", ".join(f"({t - 5}, {w!r}::DOUBLE)" for t, w in enumerate(C.gaussian())) + ")"


def _mirror(e: str) -> str:
    return f"(CASE WHEN ((({e}) % 14) + 14) % 14 >= 8 THEN 14 - ((({e}) % 14) + 14) % 14 ELSE ((({e}) % 14) + 14) % 14 END)"


_SSIM = f"""{PAIRS}, {_TAPS}, g AS (SELECT x, {_mirror("x + t")} AS s, sum(w) AS w FROM (SELECT unnest(range(8)) AS x), taps GROUP BY ALL),
h AS (SELECT frame, y, g.x, sum(w * ref) AS a, sum(w * dist) AS b, sum(w * (ref * ref)) AS aa, sum(w * (dist * dist)) AS bb, sum(w * (ref * dist)) AS ab FROM pairs p JOIN g ON g.s = p.x GROUP BY frame, y, g.x),
v AS (SELECT frame, g.x AS y, h.x, sum(w * a) AS a, sum(w * b) AS b, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM h JOIN g ON g.s = h.y GROUP BY frame, g.x, h.x),
q AS (SELECT frame, avg((2 * a * b + {C.SSIM_C1!r}) * (2 * (ab - a * b) + {C.SSIM_C2!r}) / ((a * a + b * b + {C.SSIM_C1!r}) * ((aa - a * a) + (bb - b * b) + {C.SSIM_C2!r}))) AS ssim FROM v GROUP BY frame)"""


@query(f"WITH {_SSIM} SELECT frame, round(ssim, 7) AS ssim, CAST(64 AS BIGINT) AS n FROM q")
def ssim_block(spark, d):
    return quality.ssim_frames(V.block_pairs(spark, d), 8, 8).withColumn("ssim", F.round("ssim", 7))


@query(f"WITH {_SSIM} SELECT count(*) AS frames, round(avg(ssim), 7) AS ssim FROM q")
def ssim_clip(spark, d):
    return quality.ssim_clip(V.block_pairs(spark, d), 8, 8).withColumn("ssim", F.round("ssim", 7))


_SLOPES = f"""{CURVES}, u AS (SELECT clip, toolset, quality, ln(min(rate)) AS y FROM points GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY clip, toolset) AS k FROM u),
h AS (SELECT *, lead(quality) OVER w - quality AS h, (lead(y) OVER w - y) / (lead(quality) OVER w - quality) AS d FROM c WHERE k >= 4 WINDOW w AS (PARTITION BY clip, toolset ORDER BY quality)),
n AS (SELECT *, lag(h) OVER w AS h0, lag(d) OVER w AS d0, lead(h) OVER w AS h2, lead(d) OVER w AS d2, lag(h, 2) OVER w AS h1, lag(d, 2) OVER w AS d1 FROM h WINDOW w AS (PARTITION BY clip, toolset ORDER BY quality)),
e AS (SELECT *, CASE WHEN h0 IS NULL THEN ((2 * h + h2) * d - h * d2) / (h + h2) WHEN h IS NULL THEN ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1) END AS est, CASE WHEN h0 IS NULL THEN d ELSE d0 END AS near, CASE WHEN h0 IS NULL THEN d2 ELSE d1 END AS far FROM n),
s AS (SELECT clip, toolset, quality, y, h, CASE WHEN h0 IS NOT NULL AND h IS NOT NULL THEN CASE WHEN d0 * d <= 0 THEN 0.0 ELSE (3 * h + 3 * h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END
  WHEN est * near <= 0 THEN 0.0 WHEN near * far <= 0 AND abs(est) > abs(3 * near) THEN 3 * near ELSE est END AS slope FROM e)"""


@query(f"WITH {_SLOPES} SELECT clip, toolset, round(quality, 9) AS quality, round(slope, 9) AS slope FROM s")
def pchip_slopes(spark, d):
    return quality.slopes(V.curves(spark, d)).select("clip", "toolset", F.round("quality", 9).alias("quality"), F.round("slope", 9).alias("slope"))


def _hermite(t: str) -> str:
    return f"h * (y * (pow({t}, 4) / 2 - pow({t}, 3) + {t}) + h * slope * (pow({t}, 4) / 4 - pow({t}, 3) * 2 / 3 + pow({t}, 2) / 2) + y1 * (pow({t}, 3) - pow({t}, 4) / 2) + h * slope1 * (pow({t}, 4) / 4 - pow({t}, 3) / 3))"


@query(f"""WITH {_SLOPES}, p AS (SELECT *, lead(y) OVER w AS y1, lead(slope) OVER w AS slope1 FROM s WINDOW w AS (PARTITION BY clip, toolset ORDER BY quality)),
r AS (SELECT clip, toolset, min(quality) AS lo, max(quality) AS hi FROM s GROUP BY ALL),
o AS (SELECT t.clip, t.toolset, greatest(t.lo, b.lo) AS a, least(t.hi, b.hi) AS b FROM r t JOIN r b ON b.clip = t.clip AND b.toolset = 'F' WHERE t.toolset <> 'F'),
k AS (SELECT o.clip, o.toolset, o.a, o.b, p.toolset AS side, p.*, greatest(p.quality, o.a) AS x0, least(p.quality + p.h, o.b) AS x1 FROM o JOIN p ON p.clip = o.clip AND (p.toolset = o.toolset OR p.toolset = 'F') WHERE p.h IS NOT NULL),
i AS (SELECT clip, toolset, a, b, CASE WHEN x1 > x0 THEN ({_hermite("((x1 - quality) / h)")} - {_hermite("((x0 - quality) / h)")}) ELSE 0 END * CASE WHEN side = 'F' THEN -1 ELSE 1 END AS area FROM k)
SELECT clip, toolset, round((exp(sum(area) / (any_value(b) - any_value(a))) - 1) * 100, 6) AS bd_rate_percent, CAST(NULL AS VARCHAR) AS refused FROM i GROUP BY clip, toolset""")
def bd_rate(spark, d):
    return quality.bd_rate(V.curves(spark, d), "F").withColumn("bd_rate_percent", F.round("bd_rate_percent", 6))


@query(f"""WITH {PACKETS}, g AS (SELECT stream_id, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits FROM packets GROUP BY stream_id), a AS (SELECT *, bits * 25 / CAST(frames AS DOUBLE) AS achieved FROM g)
SELECT stream_id, frames, round(achieved, 6) AS achieved_bps, round((achieved - {TARGET_BPS}) / {TARGET_BPS} * 100, 6) AS error_percent, abs((achieved - {TARGET_BPS}) / {TARGET_BPS} * 100) <= 5 AS within FROM a""")
def abr_error_summary(spark, d):
    return quality.rate_errors(V.packets(spark, d), TARGET_BPS).withColumns({"achieved_bps": F.round("achieved_bps", 6), "error_percent": F.round("error_percent", 6)})


def _flat(df: DataFrame, column: str, name: str) -> DataFrame:
    # outer: else a filter on the array's size is inferred and pushed through the projections that make it
    return df.select("block_id", F.posexplode_outer(column).alias("i", name)).withColumn(name, F.col(name).cast("bigint"))


@query(f"WITH {COEFS} SELECT block_id, CAST(fy * 8 + fx AS INTEGER) AS i, c AS coef FROM coefs")
def dct8_forward(spark, d):
    return _flat(coding.coefficients(V.blocks(spark, d)), "coef", "coef")


@query(f"WITH {LEVELS} SELECT block_id, CAST(fy * 8 + fx AS INTEGER) AS i, level FROM levels")
def quantize(spark, d):
    return _flat(coding.levels(V.blocks(spark, d), QP), "level", "level")


@query(f"WITH {LEVELS} SELECT block_id, CAST(fy * 8 + fx AS INTEGER) AS i, (level * {SCALE} + 8) >> 4 AS coef FROM levels")
def dequantize(spark, d):
    lv = coding.levels(V.blocks(spark, d), QP)
    return _flat(lv.withColumn("coef", F.transform("level", lambda x: N.dequantize(x, F.lit(SCALE).cast("bigint")))), "coef", "coef")


@query(f"""WITH {LEVELS}, q AS (SELECT block_id, fy, fx, (level * {SCALE} + 8) >> 4 AS c FROM levels),
ih AS (SELECT block_id, fy, m.x, {_shift("CAST(sum(m.w * c) AS BIGINT)", 7)} AS t FROM q JOIN m ON m.k = q.fx GROUP BY block_id, fy, m.x),
iv AS (SELECT block_id, m.x AS y, ih.x, least(greatest({_shift("CAST(sum(m.w * t) AS BIGINT)", 10)}, -32768), 32767) AS r FROM ih JOIN m ON m.k = ih.fy GROUP BY block_id, m.x, ih.x)
SELECT block_id, CAST(y * 8 + x AS INTEGER) AS i, CAST(least(greatest(r + mean, 0), 255) AS BIGINT) AS v FROM iv JOIN means USING (block_id)""")
def dct8_inverse(spark, d):
    return _flat(coding.reconstructed(V.blocks(spark, d), QP), "v", "v")


@query(f"""WITH {SCANNED}, a AS (SELECT block_id, max(CASE WHEN level <> 0 THEN pos END) AS last, count(*) FILTER (level <> 0) AS nonzero FROM scanned GROUP BY block_id)
SELECT a.block_id, CAST(last AS INTEGER) AS last, CAST(s.x AS BIGINT) AS x, CAST(s.y AS BIGINT) AS y, nonzero FROM a LEFT JOIN scan s ON s.pos = a.last""")
def diagonal_scan_last(spark, d):
    return coding.last_significant(coding.levels(V.blocks(spark, d), QP))


@query(f"""WITH {SCANNED}, c AS (SELECT *, coalesce(sum(CASE WHEN level <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, max(CASE WHEN level <> 0 THEN pos END) OVER (PARTITION BY block_id) AS last FROM scanned)
SELECT block_id, CAST(11 + least(seen, 10) AS BIGINT) AS context, count(*) AS uses FROM c WHERE pos < last GROUP BY ALL""")
def sig_context_ids(spark, d):
    return coding.significance_contexts(coding.levels(V.blocks(spark, d), QP))


@query(f"WITH {LEVELS} SELECT block_id, CAST(sum(2 * len(bin(abs(level) + 1)) - 1 + CASE WHEN level <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS bits FROM levels GROUP BY block_id")
def exp_golomb_bits(spark, d):
    return coding.level_bits(coding.levels(V.blocks(spark, d), QP))


@query(f"""WITH {MOTION}, u AS (SELECT * FROM blocks WHERE ref = 'last')
SELECT c.frame, c.x, c.y, {", ".join(f"greatest(least(coalesce(l.mv_{k}, 0), coalesce(a.mv_{k}, 0)), least(greatest(coalesce(l.mv_{k}, 0), coalesce(a.mv_{k}, 0)), CASE WHEN r.frame IS NOT NULL THEN r.mv_{k} ELSE coalesce(e.mv_{k}, 0) END)) AS mv_{k}" for k in "xy")}
FROM blocks c LEFT JOIN u l ON l.frame = c.frame AND l.x = c.x - 8 AND l.y = c.y LEFT JOIN u a ON a.frame = c.frame AND a.x = c.x AND a.y = c.y - 8
LEFT JOIN u r ON r.frame = c.frame AND r.x = c.x + 8 AND r.y = c.y - 8 LEFT JOIN u e ON e.frame = c.frame AND e.x = c.x - 8 AND e.y = c.y - 8""")
def median_mv(spark, d):
    return prediction.median_vectors(V.motion_blocks(spark, d))


_COSTS = SAMPLES + ", costs AS (" + " UNION ALL ".join(
    f"SELECT block_id AS frame, {s} AS size, CAST(x * 8 // {s} * {s} AS INTEGER) AS x, CAST(y * 8 // {s} * {s} AS INTEGER) AS y, CAST(sum(v * v) - floor(sum(v) * sum(v) / count(*)) + 900 AS BIGINT) AS cost FROM samples GROUP BY 1, 2, 3, 4" for s in (8, 16, 32, 64)
) + ")"
_TREE = _COSTS + ", b8 AS (SELECT *, TRUE AS keeps FROM costs WHERE size = 8)"
for _s, _p in ((16, 8), (32, 16), (64, 32)):
    _TREE += f", b{_s} AS (SELECT c.frame, c.size, c.x, c.y, least(c.cost, s.split) AS cost, c.cost <= s.split AS keeps FROM costs c JOIN (SELECT frame, x // {_s} * {_s} AS x, y // {_s} * {_s} AS y, CAST(sum(cost) AS BIGINT) AS split FROM b{_p} GROUP BY 1, 2, 3) s USING (frame, x, y) WHERE c.size = {_s})"
_TREE += ", k AS (SELECT frame, size, x, y FROM (FROM b8 UNION ALL FROM b16 UNION ALL FROM b32 UNION ALL FROM b64) WHERE keeps), leaves AS (SELECT * FROM k b WHERE NOT EXISTS (SELECT 1 FROM k a WHERE a.frame = b.frame AND a.size > b.size AND a.x = b.x // a.size * a.size AND a.y = b.y // a.size * a.size))"


@query(f"WITH {_TREE} SELECT frame, size, x, y FROM leaves")
def quadtree_choice(spark, d):
    return coding.quadtree(V.leaf_costs(spark, d))


_INTRA = SAMPLES + """, b AS (SELECT block_id, list(v ORDER BY i) AS v FROM samples GROUP BY block_id), p AS (SELECT block_id, v, i, CAST(i // 4 AS INTEGER) AS r, CAST(i % 4 AS INTEGER) AS c FROM b, (SELECT unnest(range(16)) AS i)),
q AS (SELECT block_id, i, v[(r + 1) * 8 + c + 2] AS own,
  CAST(floor((v[2] + v[3] + v[4] + v[5] + v[9] + v[17] + v[25] + v[33] + 4) / 8) AS INTEGER) AS dc,
  CAST(floor(((3 - c) * v[(r + 1) * 8 + 1] + (c + 1) * v[6] + (3 - r) * v[c + 2] + (r + 1) * v[41] + 4) / 8) AS INTEGER) AS planar, v[(r + 1) * 8 + 1] AS horizontal, v[c + 2] AS vertical FROM p),
e AS (""" + " UNION ALL ".join(f"SELECT block_id, '{m}' AS mode, {k} AS \"order\", CAST(sum((own - {m}) * (own - {m})) AS BIGINT) AS cost, string_agg({m}, ',' ORDER BY i) AS predicted FROM q GROUP BY block_id" for k, m in enumerate(("dc", "planar", "horizontal", "vertical"))) + ")"


@query(f"WITH {_INTRA} SELECT * FROM e")
def intra_dc_planar_hv(spark, d):
    return prediction.intra_candidates(V.blocks(spark, d))


@query()
def intra_angular(spark, d):
    return prediction.intra_candidates(V.blocks(spark, d), modes=("d45", "d135", "d117", "d153"))


@query(f"""WITH {_INTRA} SELECT block_id, mode, "order", cost, predicted FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY cost, "order") AS n FROM e) WHERE n = 1""")
def candidate_argmin(spark, d):
    return coding.cheapest(prediction.intra_candidates(V.blocks(spark, d)), ["block_id"])


def _sql_table(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


_LINES = SAMPLES + f""", l AS (SELECT block_id, y, max(v) FILTER (x = 0) AS p3, max(v) FILTER (x = 1) AS p2, max(v) FILTER (x = 2) AS p1, max(v) FILTER (x = 3) AS p0, max(v) FILTER (x = 4) AS q0, max(v) FILTER (x = 5) AS q1, max(v) FILTER (x = 6) AS q2, max(v) FILTER (x = 7) AS q3, block_id % 64 AS qp, (block_id + y) % 3 AS s FROM samples GROUP BY block_id, y),
t AS (SELECT *, abs(p0 - q0) < {_sql_table(C.ALPHA)}[qp + 1] AND abs(p1 - p0) < {_sql_table(C.BETA)}[qp + 1] AND abs(q1 - q0) < {_sql_table(C.BETA)}[qp + 1] AS calm, {_sql_table(C.TC)}[qp + 1] AS tc FROM l),
f AS (SELECT *, least(greatest(CAST(floor(((q0 - p0) * 4 + (p1 - q1) + 4) / 8) AS INTEGER), -tc), tc) AS dl FROM t),
o AS (SELECT block_id, y, CASE WHEN s = 0 OR NOT calm THEN [p3, p2, p1, p0, q0, q1, q2, q3] WHEN s = 1 THEN [p3, p2, p1, least(greatest(p0 + dl, 0), 255), least(greatest(q0 - dl, 0), 255), q1, q2, q3]
  ELSE [p3, (2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) // 8, (p2 + p1 + p0 + q0 + 2) // 4, (p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) // 8, (p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) // 8, (p0 + q0 + q1 + q2 + 2) // 4, (p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) // 8, q3] END AS line FROM f)"""


@query(f"WITH {_LINES} SELECT block_id, y, array_to_string(line, ',') AS line FROM o")
def deblock_line(spark, d):
    b = V.blocks(spark, d).select("block_id", F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.slice("v", y * 8 + 1, 8).alias("s")) for y in range(8)])).alias("r"))
    line = prediction.deblock_line(F.col("r.s"), F.col("block_id") % 64, (F.col("block_id") + F.col("r.y")) % 3)
    return b.select("block_id", "r.y", F.concat_ws(",", F.transform(line, lambda x: x.cast("string"))).alias("line"))


_EDGES = f"""{_TREE}, b AS (SELECT frame, size, x, y, (frame + x // 8 + y // 8) % 3 = 0 AS intra, (frame + x // 8) % 2 = 0 AS coded FROM leaves),
e AS (SELECT a.frame, TRUE AS vertical, a.x + a.size AS line, a.y AS start, a.size AS length, 'coding_block' AS kind, a.intra OR o.intra AS intra, a.coded OR o.coded AS coded FROM b a JOIN b o ON o.frame = a.frame AND a.x + a.size >= o.x AND a.x + a.size < o.x + o.size AND a.y >= o.y AND a.y < o.y + o.size
  UNION ALL SELECT a.frame, FALSE, a.y + a.size, a.x, a.size, 'coding_block', a.intra OR o.intra, a.coded OR o.coded FROM b a JOIN b o ON o.frame = a.frame AND a.y + a.size >= o.y AND a.y + a.size < o.y + o.size AND a.x >= o.x AND a.x < o.x + o.size
  UNION ALL SELECT frame, vertical, CASE WHEN vertical THEN x ELSE y END + 32, CASE WHEN vertical THEN y ELSE x END, 64, 'derived_transform', intra, coded FROM b, (VALUES (TRUE), (FALSE)) d(vertical) WHERE size = 64)"""


def _leaves(spark, d):
    at = F.col("frame") + F.floor(F.col("x") / 8)
    return coding.quadtree(V.leaf_costs(spark, d)).withColumns({"intra": (at + F.floor(F.col("y") / 8)) % 3 == 0, "coded": at % 2 == 0})


@query(f"WITH {_EDGES} SELECT frame, vertical, line, start, length, kind, intra, coded FROM e")
def deblock_edges(spark, d):
    return prediction.block_edges(_leaves(spark, d), 64, 64)


@query("WITH e AS (SELECT l_orderkey AS frame, l_linenumber AS vertical, l_partkey % 64 AS line, l_suppkey % 32 AS start, CAST(l_quantity AS BIGINT) AS length FROM lineitem) SELECT frame, vertical, line // 2 AS line, start // 2 AS start, length // 2 AS length FROM e WHERE length >= 16 AND line % 2 = 0 AND start % 2 = 0 AND length // 2 >= 8")
def chroma_edges(spark, d):
    e = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("vertical"), (F.col("l_partkey") % 64).alias("line"), (F.col("l_suppkey") % 32).alias("start"), F.col("l_quantity").cast("bigint").alias("length"))
    return prediction.chroma_edges(e)


_KIND = "CASE WHEN l_returnflag = 'R' THEN 'derived_transform' ELSE 'coding_block' END"


@query(f"SELECT kind, intra, coded, CASE WHEN kind = 'coding_block' THEN CASE WHEN intra THEN 2 ELSE 1 END WHEN NOT intra THEN CASE WHEN coded THEN 1 ELSE 0 END ELSE 2 END AS strength, count(*) AS n FROM (SELECT {_KIND} AS kind, l_partkey % 3 = 0 AS intra, l_suppkey % 2 = 0 AS coded FROM lineitem) GROUP BY ALL")
def edge_strengths(spark, d):
    e = V.table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "derived_transform").otherwise("coding_block").alias("kind"), (F.col("l_partkey") % 3 == 0).alias("intra"), (F.col("l_suppkey") % 2 == 0).alias("coded"))
    return e.withColumn("strength", prediction.edge_strength(F.col("kind"), F.col("intra"), F.col("coded"))).groupBy("kind", "intra", "coded", "strength").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT user_id AS stream_id, event_id % 151 AS id FROM events), g AS (SELECT stream_id, list(id) AS ids FROM s WHERE id < 144 GROUP BY stream_id)
SELECT stream_id, CAST(len(ids) AS BIGINT) AS recorded, len(ids) = 144 AS complete, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT unnest(range(144)) AS i) WHERE NOT list_contains(ids, i)), '') AS missing FROM g""")
def coverage_missing(spark, d):
    return ledger.coverage(V.table(spark, d, "events").select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 151).alias("id")))


@query("SELECT count(DISTINCT event_id % 151) FILTER (event_id % 151 < 144) AS recorded, 144 - count(DISTINCT event_id % 151) FILTER (event_id % 151 < 144) AS missing FROM events")
def coverage_union(spark, d):
    return ledger.total_coverage(V.table(spark, d, "events").select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 151).alias("id")))


_RECEIPT = f"""{CURVES}, fresh AS (SELECT clip, toolset, floor(quality) AS q, sum(rate) AS rate FROM points GROUP BY ALL), rec AS (SELECT clip, toolset, q, CASE WHEN q % 2 = 0 THEN rate * 1.01 ELSE rate END AS rate FROM fresh WHERE q <> 33)"""


@query(f"""WITH {_RECEIPT} SELECT f.clip, f.toolset, f.q, round(f.rate, 6) AS fresh, round(r.rate, 6) AS recorded, CASE WHEN r.clip IS NULL THEN 'absent' ELSE 'unequal' END AS why FROM fresh f LEFT JOIN rec r USING (clip, toolset, q)
WHERE r.clip IS NULL OR abs(f.rate - r.rate) > 1e-9 * greatest(abs(f.rate), abs(r.rate))""")
def receipt_diff(spark, d):
    fresh = V.curves(spark, d).groupBy("clip", "toolset", F.floor("quality").cast("double").alias("q")).agg(F.sum("rate").alias("rate"))
    rec = fresh.where("q <> 33").withColumn("rate", F.when(F.col("q") % 2 == 0, F.col("rate") * 1.01).otherwise(F.col("rate")))
    return ledger.receipt_diff(fresh, rec, ["clip", "toolset", "q"], "rate").withColumns({"fresh": F.round("fresh", 6), "recorded": F.round("recorded", 6)})


@query("""WITH n AS (SELECT strftime(l_shipdate, '%Y-%m') AS clip, sum(CAST(l_quantity AS BIGINT)) AS rate FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), b AS (SELECT strftime(l_shipdate, '%Y-%m') AS clip, sum(CAST(l_quantity AS BIGINT)) AS rate FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT n.clip, round((n.rate / b.rate - 1) * 100, 9) AS change, CASE WHEN b.clip IS NULL THEN 'unmatched' WHEN (n.rate / b.rate - 1) * 100 > 2 THEN 'regressed' ELSE 'ok' END AS verdict FROM n LEFT JOIN b USING (clip)""")
def regression_check(spark, d):
    li = V.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("clip"), F.col("l_quantity").cast("bigint").alias("q"), "l_returnflag", "l_linestatus")
    total = lambda x: x.groupBy("clip").agg(F.sum("q").alias("rate"))
    return ledger.regressions(total(li.where("l_returnflag <> 'A'")), total(li.where("l_linestatus = 'O'"))).withColumn("change", F.round("change", 9))


def _report(spark: SparkSession, d: str) -> DataFrame:
    p = V.block_pairs(spark, d)
    sse = quality.psnr_frames(p).select("frame", "sse", "n")
    sad = p.select("frame", F.aggregate(F.zip_with("ref", "dist", lambda a, b: F.abs(a - b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x * 4096).alias("cost_q16"))
    f = F.col("frame")
    return sse.join(sad, "frame").select(F.floor(f / 16).alias("frame"), (f % 16 % 4).alias("x"), F.floor(f % 16 / 4).alias("y"), "sse", "n", "cost_q16")


_BLOCKS = PAIRS + ", w AS (SELECT frame AS f, CAST(sum((ref - dist) * (ref - dist)) AS BIGINT) AS sse, count(*) AS n, CAST(sum(abs(ref - dist)) * 4096 AS BIGINT) AS cost_q16 FROM pairs GROUP BY frame), b AS (SELECT f // 16 AS frame, f % 16 % 4 AS x, f % 16 // 4 AS y, sse, n, cost_q16 FROM w)"


_CODED = "y // 64, x // 64, " + " + ".join(f"({c} // {8 << k}) % 2 * {(1 if c == 'x' else 2) << 2 * k}" for k in range(3) for c in "xy")


@query(f"WITH {_BLOCKS} SELECT frame, x, y, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, {_CODED}) AS k FROM (SELECT *, sse / CAST(n AS DOUBLE) / greatest(1.0, cost_q16 / 65536.0::DOUBLE) AS score FROM b WHERE sse > 0)) WHERE k = 1")
def worst_block(spark, d):
    return ledger.worst_block(_report(spark, d)).withColumn("score", F.round("score", 9))


@query(f"WITH {_BLOCKS}, m AS (SELECT *, max(cost_q16) OVER (PARTITION BY frame) AS peak FROM b) SELECT frame, x, y, CASE WHEN peak > 0 THEN round(cost_q16 / CAST(peak AS DOUBLE), 9) ELSE 0.0 END AS share FROM m")
def heat_share(spark, d):
    return ledger.heat(_report(spark, d), "cost_q16").withColumn("share", F.round("share", 9))


@query(f"WITH {_BLOCKS}, g AS (SELECT frame, CAST(sum(cost_q16 // 524288) AS BIGINT) AS emitted FROM b GROUP BY frame) SELECT frame, emitted + 12 AS parts, emitted + 12 + CASE WHEN frame % 3 = 0 THEN 1 ELSE 0 END AS total, frame % 3 <> 0 AS agrees FROM g")
def probe_reconcile(spark, d):
    b = _report(spark, d).withColumn("emitted", F.floor(F.col("cost_q16") / 524288))
    frames = b.groupBy("frame").agg((F.sum("emitted") + 12 + F.when(F.col("frame") % 3 == 0, 1).otherwise(0)).alias("payload_len")).withColumns({"structure": F.lit(7), "flush": F.lit(5)})
    return ledger.reconcile(b, frames)


@query("WITH a AS (SELECT l_orderkey % 50 AS k, l_partkey % 40 AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey % 50 AS k, l_partkey % 40 AS v FROM lineitem WHERE l_returnflag = 'R') SELECT k, v, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT k, v, 'right' FROM (FROM b EXCEPT ALL FROM a)")
def set_differences(spark, d):
    li = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), (F.col("l_partkey") % 40).alias("v"), "l_returnflag")
    return ledger.set_differences(li.where("l_returnflag = 'A'").drop("l_returnflag"), li.where("l_returnflag = 'R'").drop("l_returnflag"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def content_hash(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query()
def crc32c_payload(spark, d):
    return V.table(spark, d, "documents").select("doc_id", crc32c_column(F.col("text").cast("binary")).alias("crc32c"))


def _streams(spark: SparkSession, d: str) -> DataFrame:
    p = V.packets(spark, d).withColumn("payload", F.encode(F.format_string("%08d", "bits"), "utf-8"))
    return PK.build_streams(p)


@query(f"WITH {PACKETS} SELECT stream_id, pos, 'packet' AS event, frame_index, key FROM packets")
def packet_scan(spark, d):
    return PK.scan(_streams(spark, d)).select("stream_id", "pos", "event", "frame_index", "key")


@query(f"WITH {PACKETS} SELECT stream_id, pos, CASE WHEN pos % 7 = 6 THEN 'payload_corrupt' ELSE 'packet' END AS event, frame_index, key FROM packets")
def packet_scan_damaged(spark, d):
    return PK.scan(PK.damage(_streams(spark, d), every=7)).select("stream_id", "pos", "event", "frame_index", "key")


@query("SELECT DISTINCT user_id AS stream_id, CAST(64 AS BIGINT) AS width, CAST(64 AS BIGINT) AS height, CAST(25 AS BIGINT) AS fps_num, CAST(120 AS BIGINT) AS kf_interval FROM events")
def stream_headers(spark, d):
    h = _streams(spark, d)
    return h.select("stream_id", *[c for c in PK.header_columns(F.col("data"))]).select("stream_id", "width", "height", "fps_num", "kf_interval")


@query("SELECT flags, flags & 1 <> 0 AS key, flags & 2 <> 0 AS golden_refresh, flags & 4 <> 0 AS show, (flags & 248) = 0 AND flags & 4 <> 0 AND (flags & 1 = 0 OR flags & 2 <> 0) AS legal, count(*) AS n FROM (SELECT event_id % 16 AS flags FROM events) GROUP BY ALL")
def packet_flags(spark, d):
    e = V.table(spark, d, "events").select((F.col("event_id") % 16).cast("int").alias("flags"))
    return e.select(F.col("flags").cast("bigint").alias("flags"), *PK.flag_columns(F.col("flags"))).groupBy("flags", "key", "golden_refresh", "show", "legal").agg(F.count("*").alias("n"))


@query(f"WITH {LEVELS} SELECT block_id, TRUE AS same, 64 AS n FROM (SELECT DISTINCT block_id FROM levels)")
def range_roundtrip(spark, d):
    from .operators.entropy import roundtrip

    return roundtrip(coding.levels(V.blocks(spark, d), QP)).select("block_id", "same", "n")


@query("SELECT block_id, i, CAST(greatest(0, least(255, floor(y + (cr - 128) * 1.402 + 0.5))) AS INTEGER) AS r, CAST(greatest(0, least(255, floor(y - (cb - 128) * 0.344136 - (cr - 128) * 0.714136 + 0.5))) AS INTEGER) AS g, CAST(greatest(0, least(255, floor(y + (cb - 128) * 1.772 + 0.5))) AS INTEGER) AS b FROM (WITH " + SAMPLES + " SELECT block_id, i, CAST(v AS DOUBLE) AS y, CAST((v * 7) % 256 AS DOUBLE) AS cb, CAST((v * 13) % 256 AS DOUBLE) AS cr FROM samples)")
def ycbcr_rgb(spark, d):
    s = V.blocks(spark, d).select("block_id", F.posexplode("v").alias("i", "v"))
    r, g, b = N.ycbcr_to_rgb(F.col("v").cast("double"), (F.col("v") * 7 % 256).cast("double"), (F.col("v") * 13 % 256).cast("double"))
    return s.select("block_id", "i", r.alias("r"), g.alias("g"), b.alias("b"))
