"""Adaptive binary range coder: a sequential kernel, one payload at a time.

The interval is 32 bits wide and renews a byte at a time; a carry may still
reach bytes already due, so those wait as a count until it is settled.
"""

from __future__ import annotations

from ..plans import constants as C

_TOP, _FULL = 1 << 24, (1 << 32) - 1


def adapted(p1: int, symbol: int) -> int:
    """Probability of 1 (of 4096) after a decision."""
    return min(max(p1 + (((C.PROBABILITY_TOTAL if symbol else 0) - p1) >> C.ADAPTATION_SHIFT), 1), C.PROBABILITY_TOTAL - 1)


class Encoder:
    """Takes decisions one by one and counts what they cost and which bytes came of them."""

    def __init__(self) -> None:
        self.out = bytearray()
        self.low, self.width = 0, _FULL
        self.waiting, self.held = 0, 0  # the byte due, and how many 0xFF are due after it
        self.bins = self.renewals = self.cost = self.flushed = 0

    def _push(self) -> None:
        carry, top = self.low >> 32, (self.low >> 24) & 0xFF
        if carry or top != 0xFF:
            self.out.append((self.waiting + carry) & 0xFF)
            self.out.extend([(0xFF + carry) & 0xFF] * self.held)
            self.waiting, self.held = top, 0
        else:
            self.held += 1
        self.low = (self.low << 8) & _FULL

    def bin(self, symbol: int, p1: int = C.PROBABILITY_TOTAL // 2) -> None:
        self.cost += C.bin_cost_q16(p1, symbol)
        zero = (self.width >> 12) * (C.PROBABILITY_TOTAL - p1)
        if symbol:
            self.low, self.width = self.low + zero, self.width - zero
        else:
            self.width = zero
        self.bins += 1
        while self.width < _TOP:
            self.width = (self.width << 8) & _FULL
            self.renewals += 1
            self._push()

    def context(self, symbol: int, contexts: list[int], i: int) -> None:
        self.bin(symbol, contexts[i])
        contexts[i] = adapted(contexts[i], symbol)

    def finish(self) -> bytes:
        before = len(self.out)
        for _ in range(5):
            self._push()
        self.flushed = len(self.out) - before
        return bytes(self.out)


def encode(bins: list[tuple[int, int | None]], contexts: list[int]) -> tuple[bytes, int]:
    """Bytes and modelled cost of (symbol, context or None for even odds); ``contexts`` adapt in place."""
    coder = Encoder()
    for symbol, context in bins:
        if context is None:
            coder.bin(symbol)
        else:
            coder.context(symbol, contexts, context)
    return coder.finish(), coder.cost


class Decoder:
    """Reads decisions back; running past the end is an error with its place."""

    def __init__(self, data: bytes):
        self.data, self.at, self.width, self.code = data, 0, _FULL, 0
        for _ in range(5):
            self._byte()

    def _byte(self) -> None:
        if self.at >= len(self.data):
            raise EOFError(f"range payload ends at byte {self.at}")
        self.code = (self.code << 8 | self.data[self.at]) & _FULL
        self.at += 1

    def bin(self, p1: int) -> int:
        zero = (self.width >> 12) * (C.PROBABILITY_TOTAL - p1)
        symbol = int(self.code >= zero)
        if symbol:
            self.code, self.width = self.code - zero, self.width - zero
        else:
            self.width = zero
        while self.width < _TOP:
            self.width = (self.width << 8) & _FULL
            self._byte()
        return symbol

    @property
    def rest(self) -> bytes:
        """What is left unread: bytes that only ended the payload."""
        return self.data[self.at :]

    def context(self, contexts: list[int], i: int) -> int:
        symbol = self.bin(contexts[i])
        contexts[i] = adapted(contexts[i], symbol)
        return symbol


def exp_golomb_bins(v: int) -> list[int]:
    """Signed order-0 code: as many ones as the length needs, a zero, the rest, and a sign unless zero."""
    m = abs(v) + 1
    n = m.bit_length() - 1
    return [1] * n + [0] + [m >> i & 1 for i in range(n - 1, -1, -1)] + ([int(v < 0)] if v else [])


def read_exp_golomb(next_bin) -> int:
    n = 0
    while next_bin():
        n += 1
    m = 1
    for _ in range(n):
        m = m << 1 | next_bin()
    return -(m - 1) if m > 1 and next_bin() else m - 1
