"""Rules that feed on their own output: scene cuts, complexity average, leaky bucket, adaptation.

Such a rule has no window form.  Streams are dealt by key and sorted, and a task
walks its rows once with the state of the current stream, so a stream of any
length needs no more memory than one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..plans import constants as C


def fold(df: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, tuple], tuple], inputs: list[str], outputs: str) -> DataFrame:
    """``key`` and ``order`` of every row with what ``step(state, row)`` returns for it; ``outputs`` is DDL."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for b in batches:
            rows = []
            for k, o, *x in zip(*(b[c].tolist() for c in (key, order, *inputs)), strict=True):
                if k != now:
                    now, state = k, start()
                rows.append((k, o, *step(state, tuple(x))))
            yield pd.DataFrame(rows, columns=names)

    schema = f"{key} bigint, {order} bigint, {outputs}"
    names = [p.split()[0] for p in schema.split(", ")]
    return df.select(key, order, *inputs).repartition(key).sortWithinPartitions(key, order).mapInPandas(walk, schema)


class GopPlanner:
    """Keyframes on interval or scene cut; the history of changes restarts at each."""

    def __init__(self, interval: int = C.KEY_INTERVAL, golden: int = C.GOLDEN_INTERVAL):
        self.interval, self.golden = interval, golden
        self.first, self.since_key, self.since_golden, self.history = True, 0, 0, []

    def step(self, row: tuple) -> tuple[bool, bool, bool]:
        sad = row[0]
        if self.first:
            self.first = False
            return True, True, False
        self.since_key += 1
        h = self.history
        cut = sad > 0 and len(h) >= C.SCENE_HISTORY_LEAST and sad * len(h) >= C.SCENE_FACTOR * sum(h)
        if cut or self.since_key == self.interval:
            self.since_key = self.since_golden = 0
            h.clear()
            return True, True, cut
        h.append(sad)
        if len(h) > C.SCENE_HISTORY:
            del h[0]
        self.since_golden += 1
        refresh = self.since_golden == self.golden
        if refresh:
            self.since_golden = 0
        return False, refresh, False


class RateControl:
    """Leaky bucket of coded bits with a bias for pictures harder or easier than the average."""

    def __init__(self, bits_per_second: int, fps_num: int, fps_den: int):
        budget = bits_per_second * fps_den // fps_num
        self.budget = budget << 16
        self.capacity = (C.BUCKET_MULTIPLE * C.RATE_WINDOW * budget) << 16
        self.fill, self.qp = self.capacity // 2, C.first_qp(budget)
        self.average = self.last = 0

    def observe(self, sad: int) -> None:
        self.last = sad
        up = sad >= self.average
        change = abs(sad - self.average) >> C.EWMA_SHIFT
        self.average += change if up else -change

    def bias(self) -> int:
        if not self.average:
            return 0
        margin = self.average // 4
        return self.capacity // 16 * ((self.last > self.average + margin) - (self.last < self.average - margin))

    def commit(self, bits: int) -> None:
        self.fill = min(max(self.fill + (bits << 16) - self.budget, 0), self.capacity)
        full = min(max(self.fill + self.bias(), 0), self.capacity)
        if full < self.capacity // 3:
            self.qp = max(self.qp - C.QP_STEP, 0)
        elif full > 2 * self.capacity // 3:
            self.qp = min(self.qp + C.QP_STEP, C.QP_MAX)

    def step(self, row: tuple) -> tuple[int, int, int]:
        sad, bits = row
        self.observe(sad)
        used = self.qp
        self.commit(bits)
        return used, self.fill, self.average


def plan_gops(transitions: DataFrame, interval: int = C.KEY_INTERVAL, golden: int = C.GOLDEN_INTERVAL) -> DataFrame:
    """stream_id, frame, key, golden, scene_cut."""
    return fold(transitions, "stream_id", "frame", lambda: GopPlanner(interval, golden), lambda s, r: s.step(r), ["sad"], "key boolean, golden boolean, scene_cut boolean")


def complexity(transitions: DataFrame) -> DataFrame:
    """stream_id, frame and the integer moving average of the picture change."""

    def step(state: list, row: tuple) -> tuple:
        state[0] += (row[0] - state[0]) >> C.EWMA_SHIFT if row[0] >= state[0] else -((state[0] - row[0]) >> C.EWMA_SHIFT)
        return (state[0],)

    return fold(transitions, "stream_id", "frame", lambda: [0], step, ["sad"], "average bigint")


def leaky_bucket(frames: DataFrame, bits_per_second: int, fps_num: int = 25, fps_den: int = 1) -> DataFrame:
    """stream_id, pos, qp used, fill (1/65536 bits) and complexity after each frame of (sad, bits)."""
    return fold(frames, "stream_id", "pos", lambda: RateControl(bits_per_second, fps_num, fps_den), lambda s, r: s.step(r), ["sad", "bits"], "qp bigint, fill_q16 bigint, average bigint")


def adapt(bins: DataFrame, initial: int = 2048) -> DataFrame:
    """stream_id, pos and the adaptive probability (of 4096) before each binary decision."""

    def step(state: list, row: tuple) -> tuple:
        p = state[0]
        state[0] = min(max(p + (((C.PROBABILITY_TOTAL if row[0] else 0) - p) >> C.ADAPTATION_SHIFT), 1), C.PROBABILITY_TOTAL - 1)
        return (p,)

    return fold(bins, "stream_id", "pos", lambda: [initial], step, ["symbol"], "p1 bigint")
