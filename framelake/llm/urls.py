"""URL rules looked up in a Bloom filter cascade.

A rule is a host and a path; it fits that host and its subdomains where the
url's path starts with the rule's, and the longest fitting rule decides.  For a
url every key that could be a rule is formed (as many of the last labels of the
host, and as much of the path, as some rule has), and keys are looked up in two
cascades, of blocking and of allowing rules.

A cascade is built against all keys the corpus can form.  Level 1 holds the
listed keys; level 2 the corpus keys that level 1 wrongly holds; level 3 the
listed keys that level 2 wrongly holds; and so on until nothing is wrong.  The
first level that lacks a key tells exactly whether it is listed, with no join
and no list at hand.  Level 1 gets so many bits that about as many corpus keys
as there are rules pass it, so all levels together grow with the rules (and the
logarithm of the corpus): a few bytes a rule, which tasks are sent once.

Keys are 64-bit hashes of their bytes; a batch's keys of one shape (labels of
the host, bytes of the path) are hashed and looked up together, so the work of a
url grows with the shapes and not with the rules.

Cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; a port or user name is part of the host as it stands; with equal
lengths the rule with the longer host decides; a key listed as both is blocked;
repeated urls are judged row by row, an empty table gives no rows, and other
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .graph import fresh
from .storage import saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class Keys:
    """The keys of a batch of urls, by shape."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, host_bytes: np.ndarray):
        n = len(data)
        self.data, self.first, self.last, self.host_end = data, bounds[:-1], bounds[1:], bounds[:-1] + host_bytes
        dots = np.flatnonzero(data == ord("."))
        owner = np.searchsorted(bounds, dots, "right") - 1
        inside = dots < self.host_end[owner]
        self.dots, owner = dots[inside], owner[inside]
        self.n_dots = np.bincount(owner, minlength=len(self.first))
        self.dots_end = np.cumsum(self.n_dots)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(X._BYTE_VALUE[data] * X._power("up", n), out=self.total[1:])
        self.down = X._power("down", n + 1)
        self.more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that are no characters of their own

    def of(self, labels: int, path_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, hash) of the key of each url that has so many labels and so long a path."""
        row = np.flatnonzero((self.n_dots >= labels - 1) & (self.host_end + path_bytes <= self.last))
        whole = self.n_dots[row] == labels - 1
        start = self.first[row].copy()
        start[~whole] = self.dots[self.dots_end[row[~whole]] - labels] + 1
        end = self.host_end[row] + path_bytes
        return row, start, end, X.mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def characters(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return end - start - (self.more[end] - self.more[start])


def _keys(host_path: pa.Array, host_bytes: np.ndarray) -> Iterator[tuple[int, int, Keys]]:
    for lo, hi, data, bounds in X.slices(host_path):
        yield lo, hi, Keys(data, bounds, host_bytes[lo:hi])


def _listed_keys(rules: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The shapes of rules, and the hash of each."""
    hosts = [r.partition("/")[0] for r in rules]
    n_host = np.array([len(h.encode()) for h in hosts], np.int64)
    shape = [(h.count(".") + 1, len(r.encode()) - n) for r, h, n in zip(rules, hosts, n_host.tolist(), strict=True)]
    out = np.zeros(len(rules), np.uint64)
    shapes = sorted(set(shape))
    number = {s: i for i, s in enumerate(shapes)}
    by = np.array([number[s] for s in shape], np.int64)
    for lo, hi, keys in _keys(pa.array(rules, pa.string()), n_host):
        for i in np.unique(by[lo:hi]).tolist():
            row, _, _, h = keys.of(*shapes[i])
            own = by[lo:hi][row] == i
            out[lo + row[own]] = h[own]
    return shapes, out


@dataclass
class Level:
    """A Bloom filter of hashes, with hash functions of its own."""

    bits: int
    hashes: int
    seed: int
    words: np.ndarray

    @staticmethod
    def sized(n: int, bits_per_key: float, seed: int) -> Level:
        bits = max(64, -(-int(n * bits_per_key) // 64) * 64)
        return Level(bits, max(1, min(16, round(bits_per_key * 0.69))), seed, np.zeros(bits // 64, np.uint64))

    def positions(self, h: np.ndarray) -> Iterator[np.ndarray]:
        one, two = X.mix(h + np.uint64(2 * self.seed + 1)), X.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (self.seed + 1) & (1 << 64) - 1))
        for i in range(self.hashes):
            yield (one + np.uint64(i) * two) % np.uint64(self.bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.positions(h):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    def add(self, h: np.ndarray) -> None:
        for p in self.positions(h):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with all of ``keys`` (h): tasks fill a copy each, and the words that they set are merged."""

    def run(batches: X.Batches) -> X.Batches:
        mine = Level(level.bits, level.hashes, level.seed, np.zeros_like(level.words))
        for b in batches:
            mine.add(b.column(0).to_numpy().view(np.uint64))
        at = np.flatnonzero(mine.words)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(mine.words[part].view(np.int64))], names=["w", "b"])

    got = keys.select("h").transform(X.streamed(run, "w bigint, b bigint")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    if got.num_rows:
        level.words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: X.Batches) -> X.Batches:
        for b in batches:
            yield b.filter(pa.array(level.holds(b.column(0).to_numpy().view(np.uint64))))

    return keys.select("h").transform(X.streamed(run, "h bigint"))


def cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int, seed: int = 1) -> list[Level]:
    """Levels that tell exactly which keys of ``universe`` are in ``listed`` (both: a bigint column ``h``).

    The universe is read once; what passes level 1 without being listed is saved
    and is all that later levels need.
    """
    if not n_listed:
        return []
    levels = [_filled(listed, Level.sized(n_listed, max(4.0, 1.44 * math.log2(max(2.0, n_universe / n_listed))), seed))]
    wrong = saved(_passing(universe, levels[0]).distinct().join(listed, "h", "left_anti"))
    right = listed
    while n := wrong.count():
        levels.append(_filled(wrong, Level.sized(n, 4.0, seed + len(levels))))
        # those of the other side that the new level wrongly holds
        wrong, right = saved(_passing(right, levels[-1])), wrong
    return levels


def listed(levels: list[Level], h: np.ndarray) -> np.ndarray:
    """Whether each key is listed: decided by the first level that lacks it."""
    out, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for depth, level in enumerate(levels):
        held = level.holds(h[open_])
        out[open_[~held]] = depth % 2 == 1
        open_ = open_[held]
    out[open_] = len(levels) % 2 == 1
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict; ``rules``: (block or allow, rule).

    A url that fits no rule gets the ``default`` verdict.
    """
    spark = pages.sparkSession
    X.bounded(spark)
    kind: dict[str, str] = {}
    for action, rule in rules:
        kind[rule] = "block" if "block" in (action, kind.get(rule)) else action
    host, path = host_and_path(F.col("url"))
    # looked up once for both kinds; the shapes of each are its own
    sides = []
    urls = pages.select(F.concat(host, path).alias("hp"), F.octet_length(host).alias("n")) if kind else None
    n_urls = (pages.agg(F.approx_count_distinct("url").alias("n")).first()["n"] or 0) if kind else 0
    for action in ("block", "allow"):
        own = [r for r, a in kind.items() if a == action]
        if not own:
            continue
        shapes, hashes = _listed_keys(own)

        def every(batches: X.Batches, shapes=shapes) -> X.Batches:
            for b in batches:
                for _, _, keys in _keys(b.column(0), b.column(1).to_numpy()):
                    h = [keys.of(*s)[3] for s in shapes]
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(h)).view(np.int64))], names=["h"])

        known = spark.createDataFrame(pa.table({"h": np.unique(hashes).view(np.int64)}))
        sides.append((action == "block", shapes, cascade(known, urls.transform(X.streamed(every, "h bigint")), len(own), n_urls * len(shapes), seed=1000 * (1 + (action == "allow")))))
    shared = spark.sparkContext.broadcast(sides)

    @F.pandas_udf("struct<rule:string,blocks:boolean>")
    def best(host_path: pd.Series, host_bytes: pd.Series) -> pd.DataFrame:
        rule: list[str | None] = [None] * len(host_path)
        blocks = np.zeros(len(host_path), bool)
        for lo, hi, keys in _keys(pa.Array.from_pandas(host_path, type=pa.string()), host_bytes.to_numpy()):
            rank = np.full(hi - lo, -1, np.int64)  # characters of the rule, then of its host, then whether it blocks
            begin, end = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            for is_block, shapes, levels in shared.value:
                for s in shapes:
                    row, a, b, h = keys.of(*s)
                    hit = listed(levels, h)
                    row, a, b = row[hit], a[hit], b[hit]
                    own = (keys.characters(a, b) << 32) + (keys.characters(a, keys.host_end[row]) << 1) + is_block
                    better = own > rank[row]
                    row = row[better]
                    rank[row], begin[row], end[row] = own[better], a[better], b[better]
                    blocks[lo + row] = is_block
            for k in np.flatnonzero(rank >= 0).tolist():
                rule[lo + k] = keys.data[begin[k] : end[k]].tobytes().decode()
        return pd.DataFrame({"rule": rule, "blocks": blocks})

    names = [fresh(pages.columns, n) for n in ("host_", "path_", "best_")]
    out = pages.withColumns({names[0]: host, names[1]: path})
    found = best(F.concat(names[0], names[1]), F.octet_length(names[0])) if sides else F.lit(None).cast("struct<rule:string,blocks:boolean>")
    out = out.withColumn(names[2], found)
    rule = F.col(f"{names[2]}.rule")
    verdict = F.when(rule.isNull(), F.lit(default)).when(F.col(f"{names[2]}.blocks"), F.lit("block")).otherwise("allow")
    given = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*given, F.col(names[0]).alias("host"), F.col(names[1]).alias("path"), rule.alias("rule"), verdict.alias("verdict"))
