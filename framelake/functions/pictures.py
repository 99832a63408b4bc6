"""Pictures as NumPy planes: geometry, prediction, residuals and the loop filter.

A picture is three uint8 planes, the two chroma ones of half size.  Blocks are
predicted and filtered as whole arrays; only the order of blocks is sequential.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..plans import constants as C

Picture = tuple[np.ndarray, np.ndarray, np.ndarray]


def padded_size(n: int) -> int:
    return -(-n // C.SUPERBLOCK) * C.SUPERBLOCK


def pad(picture: Picture, width: int, height: int) -> Picture:
    """Grown to the given luma size; the last column and row are repeated."""
    if width < picture[0].shape[1] or height < picture[0].shape[0]:
        raise ValueError("padding cannot shrink a picture")
    return tuple(np.pad(p, ((0, (height >> c) - p.shape[0]), (0, (width >> c) - p.shape[1])), mode="edge") for p, c in zip(picture, (0, 1, 1), strict=True))


def crop(picture: Picture, width: int, height: int) -> Picture:
    """The top left of the given luma size."""
    if width % 2 or height % 2 or not 0 < width <= picture[0].shape[1] or not 0 < height <= picture[0].shape[0]:
        raise ValueError("crop outside the picture or of odd size")
    return tuple(p[: height >> c, : width >> c] for p, c in zip(picture, (0, 1, 1), strict=True))


def filled(width: int, height: int, value: int = 0) -> Picture:
    return tuple(np.full((height >> c, width >> c), value, np.uint8) for c in (0, 1, 1))


def packed(picture: Picture) -> bytes:
    """The planes one after another, without stride."""
    return b"".join(np.ascontiguousarray(p).tobytes() for p in picture)


def unpacked(data: bytes, width: int, height: int) -> Picture:
    raw, size = np.frombuffer(data, np.uint8), width * height
    if len(raw) != size * 3 // 2:
        raise ValueError("bytes do not fit the picture's size")
    cut = np.split(raw, [size, size + size // 4])
    return cut[0].reshape(height, width), cut[1].reshape(height // 2, width // 2), cut[2].reshape(height // 2, width // 2)


# -- residuals ---------------------------------------------------------------


def _round(v: np.ndarray, bits: int) -> np.ndarray:
    half = (np.abs(v) + (1 << bits >> 1)) >> bits
    return np.where(v < 0, -half, half)


def _matrix(n: int) -> np.ndarray:
    return np.array(C.dct_matrix(n), np.int64)


def forward(residual: np.ndarray) -> np.ndarray:
    """Integer DCT of n x n blocks (the last two axes)."""
    n, m = residual.shape[-1], _matrix(residual.shape[-1])
    rows = _round(residual.astype(np.int64) @ m.T, n.bit_length())
    return _round(m @ rows, n.bit_length() + 7)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    n, m = coefficients.shape[-1], _matrix(coefficients.shape[-1])
    rows = np.clip(_round(coefficients.astype(np.int64) @ m, 7), -(1 << 31), (1 << 31) - 1)
    return np.clip(_round(m.T @ rows, 14 - n.bit_length()), -32768, 32767)


def quantize(coefficients: np.ndarray, qp: int) -> np.ndarray:
    scale = C.QSCALE[qp]
    return np.sign(coefficients) * np.minimum((np.abs(coefficients) * 16 + scale // 2) // scale, C.LEVEL_MAX)


def dequantize(levels: np.ndarray, qp: int) -> np.ndarray:
    return (levels.astype(np.int64) * C.QSCALE[qp] + 8) >> 4


# -- prediction --------------------------------------------------------------


def intra(plane: np.ndarray, x: int, y: int, n: int, mode: str) -> np.ndarray:
    """n x n prediction from the row above and the column to the left.

    Both reach 2n + 1 samples, the plane's last one repeated; a missing side
    takes the other's first sample, and without any all are the middle grey.
    """
    height, width = plane.shape
    reach = np.arange(2 * n + 1)
    top = plane[y - 1, np.minimum(x + reach, width - 1)].astype(np.int64) if y else None
    left = plane[np.minimum(y + reach, height - 1), x - 1].astype(np.int64) if x else None
    if mode == "dc":
        known = [side[:n] for side in (top, left) if side is not None]
        mean = (sum(int(s.sum()) for s in known) + len(known) * n // 2) // (len(known) * n) if known else C.UNAVAILABLE_SAMPLE
        return np.full((n, n), mean, np.int64)
    other = lambda side: np.full(2 * n + 1, C.UNAVAILABLE_SAMPLE if side is None else side[0])
    above, beside = top if top is not None else other(left), left if left is not None else other(top)
    if mode == "horizontal":
        return np.repeat(beside[:n, None], n, 1)
    if mode == "vertical":
        return np.repeat(above[None, :n], n, 0)
    row, col = np.mgrid[0:n, 0:n]
    if mode == "planar":
        return ((n - 1 - col) * beside[row] + (col + 1) * above[n] + (n - 1 - row) * above[col] + (row + 1) * beside[n] + n) // (2 * n)
    line = np.concatenate([beside[::-1], above])  # left column upwards, then the row above
    at = col * 32 + (row + 1) * C.ANGLES[mode]
    whole, part = at >> 5, at & 31
    sample = lambda k: line[np.clip(k, -(2 * n + 1), 2 * n) + 2 * n + 1]
    return ((32 - part) * sample(whole) + part * sample(whole + 1) + 16) >> 5


def legal_component(value: int, at: int, n: int, extent: int, phases: int) -> int:
    """A vector's component, limited, then moved towards zero until its filter stays within the virtual edge."""
    value = max(-C.MV_LIMIT_Q4, min(C.MV_LIMIT_Q4, value))
    while value:
        whole, part = divmod(value, phases)
        first, last = at + whole - (2 if part else 0), at + n - 1 + whole + (3 if part else 0)
        if first >= -C.EDGE_EXTENSION and last < extent + C.EDGE_EXTENSION:
            break
        value -= 1 if value > 0 else -1
    return value


def legal_vector(plane: np.ndarray, x: int, y: int, n: int, vector: tuple[int, int], phases: int = 4) -> tuple[int, int]:
    height, width = plane.shape
    return legal_component(vector[0], x, n, width, phases), legal_component(vector[1], y, n, height, phases)


def _stage(v: np.ndarray, n: int, part: int, phases: int) -> np.ndarray:
    """Samples between columns, at 32 times their scale: ``v`` has two columns before the first and three after the last."""
    here = v[..., 2 : 2 + n] * 32
    if not part:
        return here
    half = sum(t * v[..., k : k + n] for k, t in enumerate(C.FILTER_TAPS))
    middle = phases // 2
    a, b, weight = (here, half, part) if part <= middle else (half, v[..., 3 : 3 + n] * 32, part - middle)
    return (a * (middle - weight) + b * weight + middle // 2) // middle


def inter(plane: np.ndarray, x: int, y: int, n: int, vector: tuple[int, int], phases: int = 4) -> np.ndarray:
    """n x n prediction from a reference plane, rows first, then columns; samples outside are those of its edge."""
    height, width = plane.shape
    dx, dy = legal_vector(plane, x, y, n, vector, phases)
    cols = np.clip(np.arange(-2, n + 3) + x + dx // phases, 0, width - 1)
    rows = np.clip(np.arange(-2, n + 3) + y + dy // phases, 0, height - 1)
    flat = _stage(plane[np.ix_(rows, cols)].astype(np.int64), n, dx % phases, phases)
    both = _stage(flat.T, n, dy % phases, phases).T
    return np.clip((both + 512) >> 10, 0, 255)


class MotionField:
    """Vectors of 8-pixel cells: which reference (-1: intra or not yet coded) and where to."""

    def __init__(self, width: int, height: int):
        self.reference = np.full((height // C.CELL, width // C.CELL), -1, np.int8)
        self.vector = np.zeros((*self.reference.shape, 2), np.int32)

    def record(self, x: int, y: int, n: int, reference: str | None, vector: tuple[int, int] = (0, 0)) -> None:
        own = np.s_[y // C.CELL : (y + n) // C.CELL, x // C.CELL : (x + n) // C.CELL]
        self.reference[own] = -1 if reference is None else C.REFERENCES.index(reference)
        self.vector[own] = vector

    def _at(self, x: int, y: int, reference: int) -> tuple[int, int] | None:
        row, col = y // C.CELL, x // C.CELL
        inside = 0 <= row < self.reference.shape[0] and 0 <= col < self.reference.shape[1]
        return tuple(self.vector[row, col].tolist()) if inside and self.reference[row, col] == reference else None

    def predictor(self, x: int, y: int, n: int, reference: str) -> tuple[int, int]:
        """Median of left, above and above right (else above left), of the same reference; a missing one is zero."""
        r = C.REFERENCES.index(reference)
        corner = self._at(x + n, y - 1, r)
        corner = self._at(x - 1, y - 1, r) if corner is None else corner
        near = [self._at(x - 1, y, r), self._at(x, y - 1, r), corner]
        return tuple(sorted(v[i] if v is not None else 0 for v in near)[1] for i in range(2))


# -- loop filter -------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """A coded block: its square, whether it is intra, whether it has coefficients."""

    x: int
    y: int
    size: int
    intra: bool
    coded: bool


_STRENGTH = {(k, i, c): s for k, i, c, s in C.STRENGTH}


def strength(kind: str, is_intra: bool, coded: bool) -> int:
    return _STRENGTH.get((kind, is_intra, coded), _STRENGTH.get(("coding_block", is_intra, coded), 0))


def edges(blocks: list[Block], width: int, height: int) -> list[tuple[bool, int, int, int, int]]:
    """(vertical, line, start, length, strength): every block's right and lower edge, and the inner ones of 64-pixel blocks."""
    owner = {(x, y): b for b in blocks for x in range(b.x, b.x + b.size, C.CELL) for y in range(b.y, b.y + b.size, C.CELL)}
    out = []
    for b in blocks:
        for vertical, line, start, limit in ((True, b.x + b.size, b.y, width), (False, b.y + b.size, b.x, height)):
            if line < limit:
                near = owner.get((line, start) if vertical else (start, line))
                out.append((vertical, line, start, b.size, strength("coding_block", b.intra or bool(near and near.intra), b.coded or bool(near and near.coded))))
        if b.size == C.SUPERBLOCK:
            inner = strength("derived_transform", b.intra, b.coded)
            out += [(True, b.x + 32, b.y, 64, inner), (False, b.y + 32, b.x, 64, inner)]
    return out


def chroma_edges(luma: list[tuple[bool, int, int, int, int]]) -> list[tuple[bool, int, int, int, int]]:
    return [(v, line // 2, start // 2, length // 2, s) for v, line, start, length, s in luma if length >= 2 * C.LEAST_EDGE and line % 2 == 0 and start % 2 == 0]


def filter_lines(s: np.ndarray, qp: int, level: np.ndarray) -> np.ndarray:
    """Rows of eight samples across an edge, filtered by strength where they are calm."""
    p3, p2, p1, p0, q0, q1, q2, q3 = s.T.astype(np.int64)
    calm = (np.abs(p0 - q0) < C.ALPHA[qp]) & (np.abs(p1 - p0) < C.BETA[qp]) & (np.abs(q1 - q0) < C.BETA[qp])
    delta = np.clip(((q0 - p0) * 4 + (p1 - q1) + 4) >> 3, -C.TC[qp], C.TC[qp])
    weak = np.stack([p3, p2, p1, p0 + delta, q0 - delta, q1, q2, q3], 1)
    near = p1 + p0 + q0 + q1
    strong = np.stack([p3, (2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3, (p2 + p1 + p0 + q0 + 2) >> 2, (p2 + near + p0 + q0 + p1 + 4) >> 3, (near + p0 + q0 + q1 + q2 + 4) >> 3, (p0 + q0 + q1 + q2 + 2) >> 2, (p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) >> 3, q3], 1)
    out = np.where((level == 2)[:, None], strong, weak)
    return np.clip(np.where((calm & (level > 0))[:, None], out, s), 0, 255).astype(np.uint8)


def deblock_plane(plane: np.ndarray, qp: int, every: list[tuple[bool, int, int, int, int]], chroma: bool) -> None:
    """Filters in place, vertical edges first.  Edges of one direction lie eight samples apart, so they do not meet."""
    for vertical in (True, False):
        view = plane if vertical else plane.T
        mine = [e for e in every if e[0] == vertical and e[4]]
        if not mine:
            continue
        row = np.concatenate([np.arange(start, start + length // 8 * 8) for _, _, start, length, _ in mine])
        count = [length // 8 * 8 for _, _, _, length, _ in mine]
        line, level = np.repeat([e[1] for e in mine], count), np.repeat([e[4] for e in mine], count)
        cols = line[:, None] + np.arange(-4, 4)
        view[row[:, None], cols] = filter_lines(view[row[:, None], cols], qp, np.minimum(level, 1) if chroma else level)


def deblock(picture: Picture, qp: int, blocks: list[Block]) -> None:
    """The loop filter over a whole picture, in place."""
    height, width = picture[0].shape
    luma = edges(blocks, width, height)
    deblock_plane(picture[0], qp, luma, False)
    for plane in picture[1:]:
        deblock_plane(plane, qp, chroma_edges(luma), True)
