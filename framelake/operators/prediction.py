"""Intra prediction, motion-vector prediction and the loop filter's line rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..plans import constants as C


def intra(top: Column, left: Column, n: int, mode: str) -> Column:
    """n x n prediction from the 2n + 1 samples above and to the left (both there)."""
    place = F.sequence(F.lit(0), F.lit(n * n - 1))
    row, col = (lambda i: F.floor(i / n).cast("int")), (lambda i: (i % n).cast("int"))
    if mode == "dc":
        total = F.aggregate(F.concat(F.slice(top, 1, n), F.slice(left, 1, n)), F.lit(0), lambda s, x: s + x)
        return F.transform(place, lambda i: F.floor((total + n) / (2 * n)).cast("int"))
    if mode == "horizontal":
        return F.transform(place, lambda i: F.get(left, row(i)))
    if mode == "vertical":
        return F.transform(place, lambda i: F.get(top, col(i)))
    if mode == "planar":
        tr, bl = F.get(top, F.lit(n)), F.get(left, F.lit(n))
        return F.transform(place, lambda i: F.floor(((n - 1 - col(i)) * F.get(left, row(i)) + (col(i) + 1) * tr + (n - 1 - row(i)) * F.get(top, col(i)) + (row(i) + 1) * bl + n) / (2 * n)).cast("int"))
    angle = C.ANGLES[mode]

    def angular(i: Column) -> Column:
        at = col(i) * 32 + (row(i) + 1) * angle
        k, f = F.floor(at / 32).cast("int"), F.pmod(at, F.lit(32))
        # places before the top row run down the left column
        main = lambda j: F.when(j >= 0, F.get(top, F.least(j, F.lit(2 * n)))).otherwise(F.get(left, F.least(-j - 1, F.lit(2 * n))))
        return F.floor(((32 - f) * main(k) + f * main(k + 1) + 16) / 32).cast("int")

    return F.transform(place, angular)


def intra_candidates(blocks: DataFrame, n: int = 4, modes: tuple[str, ...] = ("dc", "planar", "horizontal", "vertical")) -> DataFrame:
    """block_id, mode, order, cost: error of predicting an n x n part of a block from the samples around it.

    The part starts at (n-1, n-1)+1 of an 8x8 block; its neighbours lie inside the block.
    """
    w = 8
    x = y = 1
    top = F.transform(F.sequence(F.lit(0), F.lit(2 * n)), lambda i: F.get("v", ((y - 1) * w + F.least(F.lit(x) + i, F.lit(w - 1))).cast("int")))
    left = F.transform(F.sequence(F.lit(0), F.lit(2 * n)), lambda i: F.get("v", (F.least(F.lit(y) + i, F.lit(w - 1)) * w + (x - 1)).cast("int")))
    own = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.get("v", ((F.floor(i / n) + y) * w + i % n + x).cast("int")))
    b = blocks.select("block_id", top.alias("top"), left.alias("left"), own.alias("own"))
    found = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("order"), intra(F.col("top"), F.col("left"), n, m).alias("p")) for k, m in enumerate(modes)])
    e = b.select("block_id", "own", F.explode(found).alias("c"))
    sse = F.aggregate(F.zip_with("own", "c.p", lambda a, p: ((a - p) * (a - p)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, d: s + d)
    return e.select("block_id", "c.mode", "c.order", sse.alias("cost"), F.concat_ws(",", F.transform("c.p", lambda p: p.cast("string"))).alias("predicted"))


def median_vectors(blocks: DataFrame, reference: str = "last") -> DataFrame:
    """frame, x, y and the vector predicted from the left, above and above-right (else above-left) blocks.

    ``blocks`` (frame, x, y, size, ref, mv_x, mv_y) cover whole 8-pixel cells.
    Each block asks for the cells beside its corners; all four questions meet the
    cells in one equi-join.  A neighbour of another reference counts as none.
    """
    step = F.sequence(F.lit(0), F.col("size") - C.CELL, F.lit(C.CELL))
    cell = lambda c, d: F.floor((F.col(c) + d) / C.CELL)
    use = blocks.where(F.col("ref") == reference).select("*", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy"))
    use = use.select("frame", cell("x", F.col("dx")).alias("cx"), cell("y", F.col("dy")).alias("cy"), F.col("mv_x").alias("x_near"), F.col("mv_y").alias("y_near"))
    corners = {"l": (F.lit(-1), F.lit(0)), "a": (F.lit(0), F.lit(-1)), "r": (F.col("size"), F.lit(-1)), "d": (F.lit(-1), F.lit(-1))}
    asked = blocks.select("frame", "x", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), cell("x", dx).alias("cx"), cell("y", dy).alias("cy")) for n, (dx, dy) in corners.items()])).alias("q")).select("frame", "x", "y", "q.*")
    met = asked.join(use, ["frame", "cx", "cy"], "left").groupBy("frame", "x", "y")
    near = lambda side, c: F.max(F.when(F.col("side") == side, F.col(f"{c}_near"))).alias(f"{side}_{c}")
    out = met.agg(*[near(side, c) for side in corners for c in ("x", "y")])
    zero = F.lit(0).cast("bigint")
    third = lambda c: F.when(F.col("r_x").isNotNull(), F.col(f"r_{c}")).otherwise(F.coalesce(f"d_{c}", zero))
    return out.select("frame", "x", "y", *[N.median3(F.coalesce(f"l_{c}", zero), F.coalesce(f"a_{c}", zero), third(c)).alias(f"mv_{c}") for c in ("x", "y")])


def deblock_line(s: Column, qp: Column, strength: Column) -> Column:
    """Eight samples across an edge after the filter: an activity test, then 4 or 6 samples change."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (F.get(s, F.lit(i)).cast("bigint") for i in range(8))
    alpha, beta, tc = (N.table(t, qp) for t in (C.ALPHA, C.BETA, C.TC))
    calm = (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)
    delta = F.least(F.greatest(F.shiftright((q0 - p0) * 4 + (p1 - q1) + 4, 3), -tc), tc)
    weak = F.array(p3, p2, p1, N.clamp_sample(p0 + delta), N.clamp_sample(q0 - delta), q1, q2, q3)
    smooth = [
        p3, F.shiftright(p3 * 2 + p2 * 3 + p1 + p0 + q0 + 4, 3), F.shiftright(p2 + p1 + p0 + q0 + 2, 2), F.shiftright(p2 + p1 * 2 + p0 * 2 + q0 * 2 + q1 + 4, 3),
        F.shiftright(p1 + p0 * 2 + q0 * 2 + q1 * 2 + q2 + 4, 3), F.shiftright(p0 + q0 + q1 + q2 + 2, 2), F.shiftright(p0 + q0 + q1 + q2 * 3 + q3 * 2 + 4, 3), q3,
    ]
    strong = F.array(*[N.clamp_sample(x) for x in smooth])
    same = F.array(p3, p2, p1, p0, q0, q1, q2, q3)
    return F.when((strength == 0) | ~calm, same).when(strength == 1, weak).otherwise(strong)


def edge_strength(kind: Column, intra: Column, coded: Column) -> Column:
    """Decision table; a combination that is not in it takes the coding-block row, else none."""
    own = coding = F.lit(None).cast("int")
    for k, i, c, s in C.STRENGTH:
        fits = (intra == i) & (coded == c)
        own = F.when((kind == k) & fits, s).otherwise(own)
        if k == "coding_block":
            coding = F.when(fits, s).otherwise(coding)
    return F.coalesce(own, coding, F.lit(0))


def chroma_edges(edges: DataFrame) -> DataFrame:
    """Edges (line, start, length) of a half-size plane: long enough, on even lines from even starts, halved, and still long enough."""
    e = edges.where(f"length >= {2 * C.LEAST_EDGE} and line % 2 = 0 and start % 2 = 0")
    return e.select(*[c for c in e.columns if c not in ("line", "start", "length")], *[F.floor(F.col(c) / 2).cast("bigint").alias(c) for c in ("line", "start", "length")]).where(f"length >= {C.LEAST_EDGE}")


def block_edges(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """frame, vertical, line, start, length, kind, intra, coded: edges of coded blocks (frame, x, y, size, intra, coded).

    Every block gives its right and its lower edge, whole, where they lie inside
    the frame, and meets the block that holds their first sample; a 64-pixel
    block gives the two edges of its transforms as well.  Blocks cover whole
    8-pixel cells, so the neighbour is found by one equi-join.
    """
    step = F.sequence(F.lit(0), F.col("size") - C.CELL, F.lit(C.CELL))
    cells = blocks.select("frame", "x", "y", F.col("intra").alias("near_intra"), F.col("coded").alias("near_coded"), F.explode(step).alias("dx"), "size")
    cells = cells.select("*", F.explode(step).alias("dy")).select("frame", (F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy"), "near_intra", "near_coded")
    right, low = F.col("x") + F.col("size"), F.col("y") + F.col("size")
    side = lambda vertical, line, start, cx, cy: F.struct(F.lit(vertical).alias("vertical"), line.alias("line"), start.alias("start"), cx.alias("cx"), cy.alias("cy"))
    outer = blocks.select("frame", "size", "intra", "coded", F.explode(F.array(side(True, right, F.col("y"), right, F.col("y")), side(False, low, F.col("x"), F.col("x"), low))).alias("e"))
    outer = outer.select("frame", "e.*", F.col("size").alias("length"), "intra", "coded").where(F.col("line") < F.when(F.col("vertical"), F.lit(width)).otherwise(F.lit(height)))
    both = lambda c: (F.col(c) | F.coalesce(f"near_{c}", F.lit(False))).alias(c)
    met = outer.join(cells, ["frame", "cx", "cy"], "left").select("frame", "vertical", "line", "start", "length", F.lit("coding_block").alias("kind"), both("intra"), both("coded"))
    half = C.SUPERBLOCK // 2
    inner = blocks.where(F.col("size") == C.SUPERBLOCK).select("frame", "intra", "coded", F.explode(F.array(side(True, F.col("x") + half, F.col("y"), F.col("x"), F.col("y")), side(False, F.col("y") + half, F.col("x"), F.col("x"), F.col("y")))).alias("e"))
    return met.unionByName(inner.select("frame", "e.vertical", "e.line", "e.start", F.lit(C.SUPERBLOCK).alias("length"), F.lit("derived_transform").alias("kind"), "intra", "coded"))
