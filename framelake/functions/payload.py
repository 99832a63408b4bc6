"""Payload syntax: partition, prediction and coefficient elements over the range coder.

Both directions share one description: what an element is made of is a list of
decisions, each with a context or even odds, and a *port* either writes a given
decision or reads the next one.  So an element is described once, with the value
known (writing) or ``None`` (reading), and the two directions cannot drift.

A partition is a nested list: a block size, or four partitions of half of it.
A prediction is ``("intra", mode)``, ``("skip", reference)`` or ``("inter",
reference, dx, dy)`` with a vector difference in quarter pixels.
"""

from __future__ import annotations

from ..plans import constants as C
from . import rangecoder as R

#: Largest vector difference, in quarter pixels: the width of the whole-pixel range.
MVD_MAX = 2 * C.MV_LIMIT_Q4
_GROUP = {4: 0, 8: 1, 16: 2, 32: 3}


class SyntaxFault(ValueError):
    """A payload that breaks a rule; ``element`` says which."""

    def __init__(self, element: str):
        super().__init__(element)
        self.element = element


class Port:
    """One payload, written (without ``data``) or read, with its contexts and what was met."""

    def __init__(self, data: bytes | None = None, contexts: list[int] | None = None):
        self.reads = data is not None
        self.coder = R.Decoder(data) if data is not None else R.Encoder()
        self.contexts = list(contexts) if contexts is not None else [C.PROBABILITY_TOTAL // 2] * C.CONTEXTS
        self.used: set[int] = set()
        self.elements: set[str] = set()

    def bit(self, context: int | None, symbol: int | None) -> int:
        if context is not None:
            self.used.add(context)
            if self.reads:
                return self.coder.context(self.contexts, context)
            self.coder.context(int(symbol), self.contexts, context)
        elif self.reads:
            return self.coder.bin(C.PROBABILITY_TOTAL // 2)
        else:
            self.coder.bin(int(symbol))
        return int(symbol)

    def bits(self, count: int, value: int | None, context=lambda i: None) -> int:
        """An unsigned number of ``count`` bits, highest first."""
        out = 0
        for i in range(count):
            out = out << 1 | self.bit(context(i), None if value is None else value >> (count - 1 - i) & 1)
        return out

    def golomb(self, value: int | None, longest: int, element: str, context=lambda i: None) -> int:
        """An unsigned number: as many zeros as its length needs, a one, then the rest."""
        code = None if value is None else value + 1
        length = 0
        while not self.bit(context(length), None if code is None else int(length == code.bit_length() - 1)):
            length += 1
            if length > longest:
                raise SyntaxFault(element)
        return (1 << length | self.bits(length, None if code is None else code & ((1 << length) - 1))) - 1

    def partition(self, tree=None, size: int = C.SUPERBLOCK):
        """A superblock's partition; the one written, or the one read."""
        if size == C.CELL:
            if isinstance(tree, list):
                raise SyntaxFault("partition.split_at_minimum")
            return size
        if tree is not None and not isinstance(tree, list) and tree != size:
            raise SyntaxFault("partition.child_size")
        self.elements.add("partition_tree")
        depth = C.BLOCK_SIZES.index(size)
        if not self.bit(C.CONTEXT_OF["partition_tree"] + 3 * depth, None if tree is None else int(isinstance(tree, list))):
            return size
        return [self.partition(None if tree is None else tree[i], size // 2) for i in range(4)]

    def prediction(self, key: bool, value: tuple | None = None) -> tuple:
        kind = value[0] if value is not None else None
        if key:
            if kind not in (None, "intra"):
                raise SyntaxFault("prediction.key_inter")
            return ("intra", self._mode(value))
        self.elements.add("skip")
        if self.bit(C.CONTEXT_OF["skip"], None if kind is None else int(kind == "skip")):
            return ("skip", self._reference(value))
        self.elements.add("is_inter")
        if not self.bit(C.CONTEXT_OF["is_inter"], None if kind is None else int(kind == "inter")):
            return ("intra", self._mode(value))
        reference = self._reference(value)
        self.elements.add("mvd")
        return ("inter", reference, *[self._difference(None if value is None else value[2 + i], C.CONTEXT_OF["mvd"] + 3 * i) for i in range(2)])

    def _mode(self, value: tuple | None) -> str:
        self.elements.add("intra_mode")
        first = C.CONTEXT_OF["intra_mode"]
        return C.INTRA_MODES[self.bits(3, None if value is None else C.INTRA_MODES.index(value[1]), lambda i: first + (0, 3, 4)[i])]

    def _reference(self, value: tuple | None) -> str:
        self.elements.add("ref_select")
        return C.REFERENCES[self.bit(C.CONTEXT_OF["ref_select"], None if value is None else C.REFERENCES.index(value[1]))]

    def _difference(self, value: int | None, first: int) -> int:
        if value is not None and abs(value) > MVD_MAX:
            raise SyntaxFault("prediction.mvd_magnitude")
        size = self.golomb(None if value is None else abs(value), 10, "prediction.mvd_prefix", lambda i: first + i if i < 3 else None)
        if size > MVD_MAX:
            raise SyntaxFault("prediction.mvd_magnitude")
        return -size if size and self.bit(None, None if value is None else int(value < 0)) else size

    def coefficients(self, chroma: bool, n: int, levels: list[int] | None = None) -> list[int]:
        """Levels of an n x n transform block, row by row."""
        group, scan = _GROUP[n], C.diagonal_scan(n)
        if levels is not None and len(levels) != n * n:
            raise SyntaxFault("coefficient.block_length")
        if levels is not None and any(abs(v) > C.LEVEL_MAX for v in levels):
            raise SyntaxFault("coefficient.level_cap")
        out = [0] * (n * n)
        self.elements.add("has_coeff")
        if not self.bit(C.CONTEXT_OF["has_coeff"] + (4 if chroma else 0) + group, None if levels is None else int(any(levels))):
            return out
        end = None if levels is None else max(k for k, (x, y) in enumerate(scan) if levels[y * n + x])
        place = []
        for axis, name in enumerate(("last_x", "last_y")):
            self.elements.add(name)
            first = C.CONTEXT_OF[name] + 4 * group
            place.append(self.bits(n.bit_length() - 1, None if end is None else scan[end][axis], lambda i, first=first: first + i if i < 4 else None))
        end, seen = scan.index(tuple(place)), 0
        for k in range(end + 1):
            x, y = scan[k]
            value = None if levels is None else levels[y * n + x]
            if k < end:
                self.elements.add("sig")
                if not self.bit(C.CONTEXT_OF["sig"] + 11 * group + min(seen, 10), None if value is None else int(value != 0)):
                    continue
            out[y * n + x] = self._level(value, group, seen)
            seen += 1
        return out

    def _level(self, value: int | None, group: int, seen: int) -> int:
        size = None if value is None else abs(value)
        self.elements.add("gt1")
        got = 1
        if self.bit(C.CONTEXT_OF["gt1"] + 4 * group + min(seen, 3), None if size is None else int(size > 1)):
            self.elements.add("gt2")
            got = 2
            if self.bit(C.CONTEXT_OF["gt2"] + 2 * group + min(seen, 1), None if size is None else int(size > 2)):
                self.elements.add("magnitude_remainder")
                got = 3 + self.golomb(None if size is None else size - 3, 15, "coefficient.remainder_prefix")
        if got > C.LEVEL_MAX:
            raise SyntaxFault("coefficient.level_cap")
        self.elements.add("nonzero_sign")
        return -got if self.bit(None, None if value is None else int(value < 0)) else got

    def finish(self) -> bytes:
        return self.coder.finish()


def leaves(tree, x: int = 0, y: int = 0, size: int = C.SUPERBLOCK) -> list[tuple[int, int, int]]:
    """(x, y, size) of a partition's blocks, in coding order."""
    if not isinstance(tree, list):
        return [(x, y, tree)]
    half = size // 2
    return [b for k, part in enumerate(tree) for b in leaves(part, x + half * (k % 2), y + half * (k // 2), half)]


def transforms(size: int) -> list[tuple[bool, int, int]]:
    """(chroma, transform size, how many) of a block's planes, in coding order."""
    luma, chroma = min(size, 32), min(size // 2, 32)
    return [(False, luma, (size // luma) ** 2), (True, chroma, 1), (True, chroma, 1)]
