"""Payloads to pictures: the state of a group of pictures, and a payload's blocks.

A keyframe needs nothing from before it, so a group of pictures (a keyframe and
what follows it) is decoded on its own, packet by packet, with two reference
pictures and the contexts in hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..plans import constants as C
from . import pictures as P
from .payload import Port, leaves, transforms


class CodecFault(ValueError):
    """A packet that cannot be decoded; ``element`` says why."""

    def __init__(self, element: str):
        super().__init__(element)
        self.element = element


@dataclass
class State:
    """What a group of pictures carries from one packet to the next."""

    last: P.Picture | None = None
    golden: P.Picture | None = None
    contexts: list[int] | None = None

    def reference(self, name: str) -> P.Picture:
        return self.last if name == "last" else self.golden

    @property
    def ready(self) -> bool:
        return self.last is not None and self.golden is not None and self.contexts is not None

    def forget(self) -> None:
        self.last = self.golden = self.contexts = None

    def install(self, picture: P.Picture, golden: bool, contexts: list[int]) -> None:
        self.last, self.contexts = picture, contexts
        if golden:
            self.golden = picture


@dataclass
class Decoded:
    picture: P.Picture
    port: Port
    blocks: list[P.Block] = field(default_factory=list)
    predictions: list[tuple] = field(default_factory=list)
    checkpoints: list[list[int]] = field(default_factory=list)


def superblocks(width: int, height: int) -> Iterator[tuple[int, int]]:
    for y in range(0, P.padded_size(height), C.SUPERBLOCK):
        for x in range(0, P.padded_size(width), C.SUPERBLOCK):
            yield x, y


def _residual(port: Port, plane: np.ndarray, x: int, y: int, prediction: np.ndarray, qp: int, chroma: bool) -> bool:
    """Reads a plane's coefficients and writes what they and the prediction give; whether any was not zero."""
    side = prediction.shape[0]
    n, coded = min(side, 32), False
    out = prediction.copy()
    for ty in range(0, side, n):
        for tx in range(0, side, n):
            levels = np.array(port.coefficients(chroma, n), np.int64).reshape(n, n)
            if levels.any():
                coded = True
                out[ty : ty + n, tx : tx + n] += P.inverse(P.dequantize(levels, qp))
    plane[y : y + side, x : x + side] = np.clip(out, 0, 255)
    return coded


def decode_payload(width: int, height: int, payload: bytes, qp: int, key: bool, state: State) -> Decoded:
    """One picture, of padded size, after the loop filter; ``state`` is read and not changed."""
    if not key and not state.ready:
        raise CodecFault("reference.missing")
    wide, high = P.padded_size(width), P.padded_size(height)
    picture = P.filled(wide, high)
    field_ = P.MotionField(wide, high)
    try:
        port = Port(payload, None if key else state.contexts)
        out = Decoded(picture, port)
        for sx, sy in superblocks(width, height):
            for x, y, n in leaves(port.partition(), sx, sy):
                p = port.prediction(key)
                coded = False
                if p[0] == "intra":
                    for plane, c in zip(picture, (0, 1, 1), strict=True):
                        guess = P.intra(plane, x >> c, y >> c, n >> c, p[1])
                        coded |= _residual(port, plane, x >> c, y >> c, guess, qp, bool(c))
                    field_.record(x, y, n, None)
                else:
                    reference, vector = state.reference(p[1]), field_.predictor(x, y, n, p[1])
                    if p[0] == "inter":
                        vector = vector[0] + p[2], vector[1] + p[3]
                    vector = P.legal_vector(reference[0], x, y, n, vector)
                    for plane, source, c in zip(picture, reference, (0, 1, 1), strict=True):
                        guess = P.inter(source, x >> c, y >> c, n >> c, vector, 8 if c else 4)
                        if p[0] == "skip":
                            plane[y >> c : (y + n) >> c, x >> c : (x + n) >> c] = guess
                        else:
                            coded |= _residual(port, plane, x >> c, y >> c, guess, qp, bool(c))
                    field_.record(x, y, n, p[1], vector)
                out.blocks.append(P.Block(x, y, n, p[0] == "intra", coded))
                out.predictions.append(p)
            out.checkpoints.append(list(port.contexts))
    except EOFError as e:
        raise CodecFault("payload.end") from e
    P.deblock(picture, qp, out.blocks)
    return out


@dataclass
class Replay:
    """A payload written again from what was read in it."""

    payload: bytes
    contexts: list[int]
    flushed: int
    rows: list[tuple]  # one for each superblock's structure and for each block


def replay(width: int, height: int, payload: bytes, key: bool, contexts: list[int] | None) -> Replay:
    """Reads a payload's syntax and writes it anew, with modelled cost and emitted bytes of each part.

    rows: (x, y, size, kind, mode, reference, dx, dy, cost_q16, bytes, dc_energy);
    the structure of a superblock has kind ``structure``.
    """
    source, sink, rows = Port(payload, contexts), Port(None, contexts), []

    def spent(since: tuple[int, int] = (0, 0)) -> tuple[int, int]:
        return sink.coder.cost - since[0], len(sink.coder.out) - since[1]

    for sx, sy in superblocks(width, height):
        before = spent()
        tree = sink.partition(source.partition())
        rows.append((sx, sy, C.SUPERBLOCK, "structure", None, None, None, None, *spent(before), 0))
        for x, y, n in leaves(tree, sx, sy):
            before, energy = spent(), 0
            p = sink.prediction(key, source.prediction(key))
            if p[0] != "skip":
                for chroma, size, count in transforms(n):
                    for _ in range(count):
                        levels = sink.coefficients(chroma, size, source.coefficients(chroma, size))
                        energy += abs(levels[0])
            mode, reference = (p[1], None) if p[0] == "intra" else (p[0], p[1])
            dx, dy = p[2:] if p[0] == "inter" else (None, None)
            rows.append((x, y, n, p[0], mode, reference, dx, dy, *spent(before), energy))
    if source.contexts != sink.contexts:
        raise CodecFault("probe.context_lockstep")
    data = sink.finish()
    return Replay(data, sink.contexts, sink.coder.flushed, rows)
