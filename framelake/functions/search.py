"""Choosing how a picture is coded: partition, prediction and motion by rate and distortion.

A block's trial is what it would write into the picture (a patch a plane), the
elements it would code and what they cost from the contexts at hand.  Trials of
one block share the picture as it is; only the winner is laid into it, and a
split that loses to its parent is taken back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..plans import constants as C
from . import codec as K
from . import pictures as P
from .payload import Port, leaves


def rd_cost(distortion: int, cost_q16: int, qp: int) -> int:
    return distortion + ((C.LAMBDA_Q8[qp] * cost_q16 + (1 << 23)) >> 24)


def full_pel(v: int) -> int:
    """Nearest whole pixel of a quarter-pixel value, halves away from zero."""
    whole = (abs(v) + 2) // 4 * 4
    return whole if v >= 0 else -whole


def motion(source: np.ndarray, reference: np.ndarray, x: int, y: int, n: int, predictor: tuple[int, int], subpel: bool = True) -> tuple[tuple[int, int], int]:
    """Vector and its absolute error: zero first, then a diamond of whole pixels from the predictor, then halves and quarters."""
    own = source[y : y + n, x : x + n].astype(np.int64)
    seen: dict[tuple[int, int], int] = {}

    def error(vector: tuple[int, int]) -> tuple[tuple[int, int], int]:
        vector = P.legal_vector(reference, x, y, n, vector)
        if vector not in seen:
            seen[vector] = int(np.abs(own - P.inter(reference, x, y, n, vector)).sum())
        return vector, seen[vector]

    def better(a, b):
        return b if b[1] < a[1] else a

    best = error((0, 0))
    centre = error(tuple(full_pel(v) for v in predictor))
    best = better(best, centre)
    while True:
        ring = centre
        for dx, dy in C.FULL_PATTERN:
            got = error((centre[0][0] + 4 * dx, centre[0][1] + 4 * dy))
            ring, best = better(ring, got), better(best, got)
        if ring[0] == centre[0]:
            break
        centre = ring
    for step in C.SUB_STEPS if subpel else ():
        at = best[0]
        for dx, dy in C.SUB_PATTERN:
            best = better(best, error((at[0] + dx * step, at[1] + dy * step)))
    return best


@dataclass
class Trial:
    x: int
    y: int
    n: int
    prediction: tuple
    vector: tuple[int, int] | None
    patches: list[np.ndarray]
    levels: list[tuple[bool, int, list[int]]]
    distortion: int
    cost: int = 0
    contexts: list[int] = field(default_factory=list)

    @property
    def coded(self) -> bool:
        return any(any(v) for _, _, v in self.levels)

    def write(self, port: Port, key: bool) -> None:
        port.prediction(key, self.prediction)
        for chroma, size, values in self.levels:
            port.coefficients(chroma, size, values)


@dataclass
class Choice:
    tree: object
    trials: list[Trial]
    distortion: int
    cost: int
    contexts: list[int]


class Search:
    """One picture's choices, superblock by superblock."""

    def __init__(self, source: P.Picture, qp: int, key: bool, state: K.State, without: str | None = None):
        self.source, self.qp, self.key, self.state, self.without = source, qp, key, state, without
        height, width = source[0].shape
        self.picture = P.filled(width, height)
        self.field = P.MotionField(width, height)

    def _residual(self, plane: int, x: int, y: int, guess: np.ndarray) -> tuple[np.ndarray, list, int]:
        side = guess.shape[0]
        n = min(side, 32)
        own = self.source[plane][y : y + side, x : x + side].astype(np.int64)
        out, levels = np.empty_like(guess), []
        for ty in range(0, side, n):
            for tx in range(0, side, n):
                at = np.s_[ty : ty + n, tx : tx + n]
                q = P.quantize(P.forward(own[at] - guess[at]), self.qp)
                out[at] = np.clip(guess[at] + P.inverse(P.dequantize(q, self.qp)), 0, 255)
                levels.append((plane > 0, n, q.ravel().tolist()))
        return out, levels, int(((own - out) ** 2).sum())

    def _trial(self, x: int, y: int, n: int, prediction: tuple, vector: tuple[int, int] | None) -> Trial:
        patches, levels, distortion = [], [], 0
        for plane, c in enumerate((0, 1, 1)):
            px, py, side = x >> c, y >> c, n >> c
            if prediction[0] == "intra":
                guess = P.intra(self.picture[plane], px, py, side, prediction[1])
            else:
                guess = P.inter(self.state.reference(prediction[1])[plane], px, py, side, vector, 8 if c else 4)
            if prediction[0] == "skip":
                own = self.source[plane][py : py + side, px : px + side].astype(np.int64)
                patch, more, error = guess, [], int(((own - guess) ** 2).sum())
            else:
                patch, more, error = self._residual(plane, px, py, guess)
            patches.append(patch)
            levels.extend(more)
            distortion += error
        return Trial(x, y, n, prediction, vector, patches, levels, distortion)

    def _candidates(self, x: int, y: int, n: int):
        if not self.key and self.without != "inter":
            references = C.REFERENCES if self.without != "golden" else C.REFERENCES[:1]
            guess = {r: self.field.predictor(x, y, n, r) for r in references}
            luma = {r: self.state.reference(r)[0] for r in references}
            if self.without != "skip":
                for r in references:
                    yield ("skip", r), P.legal_vector(luma[r], x, y, n, guess[r])
            for r in references:
                vector, _ = motion(self.source[0], luma[r], x, y, n, guess[r], self.without != "subpel")
                yield ("inter", r, vector[0] - guess[r][0], vector[1] - guess[r][1]), vector
        for mode in C.INTRA_MODES:
            yield ("intra", mode), None

    def block(self, x: int, y: int, n: int, contexts: list[int]) -> Trial:
        """The cheapest prediction; of equal ones the first."""
        best = None
        for prediction, vector in self._candidates(x, y, n):
            t = self._trial(x, y, n, prediction, vector)
            port = Port(None, contexts)
            t.write(port, self.key)
            t.cost, t.contexts = port.coder.cost, port.contexts
            if best is None or rd_cost(t.distortion, t.cost, self.qp) < rd_cost(best.distortion, best.cost, self.qp):
                best = t
        return best

    def _lay(self, t: Trial) -> None:
        for plane, patch, c in zip(self.picture, t.patches, (0, 1, 1), strict=True):
            plane[t.y >> c : (t.y + t.n) >> c, t.x >> c : (t.x + t.n) >> c] = patch
        self.field.record(t.x, t.y, t.n, t.prediction[1] if t.vector is not None else None, t.vector or (0, 0))

    def _decision(self, n: int, split: bool, contexts: list[int]) -> tuple[list[int], int]:
        if n == C.CELL:
            return contexts, 0
        port = Port(None, contexts)
        port.bit(C.CONTEXT_OF["partition_tree"] + 3 * C.BLOCK_SIZES.index(n), int(split))
        return port.contexts, port.coder.cost

    def partition(self, x: int, y: int, n: int, contexts: list[int]) -> Choice:
        """Whole or in four, each part as cheap as it can be; of equal costs whole.  The choice is laid into the picture."""
        after, cost = self._decision(n, False, contexts)
        leaf = self.block(x, y, n, after)
        whole = Choice(n, [leaf], leaf.distortion, cost + leaf.cost, leaf.contexts)
        if n == C.CELL or self.without == "split":
            self._lay(leaf)
            return whole
        # what lies under the block: parts see each other's samples and vectors
        before = [p[y >> c : (y + n) >> c, x >> c : (x + n) >> c].copy() for p, c in zip(self.picture, (0, 1, 1), strict=True)]
        cells = np.s_[y // C.CELL : (y + n) // C.CELL, x // C.CELL : (x + n) // C.CELL]
        moved = self.field.reference[cells].copy(), self.field.vector[cells].copy()
        now, cost = self._decision(n, True, contexts)
        parts, half = [], n // 2
        for dy in (0, half):
            for dx in (0, half):
                parts.append(self.partition(x + dx, y + dy, half, now))
                now = parts[-1].contexts
        split = Choice([p.tree for p in parts], [t for p in parts for t in p.trials], sum(p.distortion for p in parts), cost + sum(p.cost for p in parts), now)
        if rd_cost(split.distortion, split.cost, self.qp) < rd_cost(whole.distortion, whole.cost, self.qp):
            return split
        for plane, patch, c in zip(self.picture, before, (0, 1, 1), strict=True):
            plane[y >> c : (y + n) >> c, x >> c : (x + n) >> c] = patch
        self.field.reference[cells], self.field.vector[cells] = moved
        self._lay(leaf)
        return whole


@dataclass
class Encoded:
    payload: bytes
    picture: P.Picture  # padded, after the loop filter
    contexts: list[int]
    cost: int
    blocks: list[Trial]


def encode_picture(source: P.Picture, qp: int, key: bool, state: K.State, without: str | None = None) -> Encoded:
    """Payload and reconstruction of one picture of any legal size; ``state`` is read and not changed."""
    if not key and not state.ready:
        raise K.CodecFault("reference.missing")
    height, width = source[0].shape
    source = P.pad(source, P.padded_size(width), P.padded_size(height))
    search = Search(source, qp, key, state, without)
    port, blocks = Port(None, None if key else state.contexts), []
    for x, y in K.superblocks(width, height):
        choice = search.partition(x, y, C.SUPERBLOCK, list(port.contexts))
        port.partition(choice.tree)
        assert [(t.x, t.y, t.n) for t in choice.trials] == leaves(choice.tree, x, y)
        for t in choice.trials:
            t.write(port, key)
        blocks += choice.trials
    P.deblock(search.picture, qp, [P.Block(t.x, t.y, t.n, t.prediction[0] == "intra", t.coded) for t in blocks])
    cost = port.coder.cost
    return Encoded(port.finish(), search.picture, port.contexts, cost, blocks)
