"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of ``window`` consecutive words; an item of
fewer words, but not none, gives its whole sequence as one window.  Windows of
one length form one search: a shift table over hashed blocks of two words tells
how far a reader may jump, a jump of zero opens the bucket of patterns that end
in that block, and the words themselves are compared before a place counts.

Documents are read in many lanes at once, so the jumps are array operations.

Cases: null or empty text has no words and no hits; a benchmark without words
(or an empty table) hits nothing; repeated items, windows that several items
share and repeated document rows each keep their own results; an item without
id marks words as hit but adds no item; other columns of ``docs`` are not looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .storage import saved

#: Characters of benchmark text searched for in one pass; larger benchmarks take several.
BLOCK_CHARS = 4_000_000
_TABLE = 1 << 18
_LANE = 256

SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, starts array<bigint>, ends array<bigint>, items array<string>"


class WuManber:
    """Search for many word sequences of one length, given by their first places in a text's words."""

    def __init__(self, w: X.Words, m: int, at: np.ndarray, item: np.ndarray, names: list[str | None]):
        self.m, self.names = m, names
        self.block = min(2, m)
        # equal windows are one pattern; its items follow one another
        every = w.hash[at[:, None] + np.arange(m)]
        order = np.lexsort((item, *every.T[::-1]))
        at, item, every = at[order], item[order], every[order]
        fresh = np.concatenate([[True], (every[1:] != every[:-1]).any(1)])
        first = np.flatnonzero(fresh)
        self.words, self.item = every[first], item
        self.first_item = np.append(first, len(item))
        begin, end = w.start[at[first, None] + np.arange(m)], w.end[at[first, None] + np.arange(m)]
        self.begin, self.size = begin.astype(np.int32), (end - begin).astype(np.int32)
        self.data = w.data
        self.shift = np.full(_TABLE, m - self.block + 1, np.int32)
        for stop in range(self.block - 1, m):
            np.minimum.at(self.shift, (self._blocks(self.words, stop) & np.uint64(_TABLE - 1)).astype(np.int64), m - 1 - stop)
        last = self._blocks(self.words, m - 1)
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def items(self, pattern: int) -> list[str]:
        """Names of the items that have a pattern; one without a name adds none."""
        return [n for i in set(self.item[self.first_item[pattern] : self.first_item[pattern + 1]].tolist()) if (n := self.names[i]) is not None]

    def _equal(self, w: X.Words, start: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the words from ``start`` on are, byte by byte, those of the pattern."""
        ok = np.ones(len(start), bool)
        for j in range(self.m):
            ok &= w.end[start + j] - w.start[start + j] == self.size[which, j]
        for j in range(self.m):
            live = np.flatnonzero(ok)
            size = self.size[which[live], j].astype(np.int64)
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            differ = w.data[np.repeat(w.start[start[live] + j], size) + within] != self.data[np.repeat(self.begin[which[live], j].astype(np.int64), size) + within]
            ok[live[np.repeat(np.arange(len(live)), size)[differ]]] = False
        return ok

    def _blocks(self, words: np.ndarray, end: int) -> np.ndarray:
        return words[:, end] if self.block == 1 else self._pair(words[:, end - 1], words[:, end])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return X.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)

    def places(self, w: X.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence inside one text."""
        m, n = self.m, len(w.hash)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < m:
            return none
        blocks = w.hash if self.block == 1 else np.concatenate([w.hash[:1], self._pair(w.hash[:-1], w.hash[1:])])
        jump = self.shift[(blocks & np.uint64(_TABLE - 1)).astype(np.int64)]
        lo, hi = w.first[:-1] + m - 1, w.first[1:]
        lanes = np.maximum(0, -(-(hi - lo) // _LANE))
        text = np.repeat(np.arange(len(lo)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = lo[text] + nth * _LANE
        stop = np.minimum(at + _LANE, hi[text])
        found = []
        while len(at):
            step = jump[at]
            stopped = step == 0
            if stopped.any():
                found.append(at[stopped])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not found:
            return none
        end = np.sort(np.concatenate(found))
        left = np.searchsorted(self.suffix, blocks[end], "left")
        many = np.searchsorted(self.suffix, blocks[end], "right") - left
        end_of = np.repeat(end, many)
        which = self.order[np.repeat(left, many) + np.arange(len(end_of)) - np.repeat(np.cumsum(many) - many, many)]
        start = end_of - m + 1
        ok = np.ones(len(start), bool)
        for j in range(m):
            ok &= w.hash[start + j] == self.words[which, j]
        start, which = start[ok], which[ok]
        same = self._equal(w, start, which)
        return start[same], which[same]


def searches(items: pa.Table, window: int) -> list[WuManber]:
    """One search for each window length that the items (item, text) give."""
    if not items.num_rows:
        return []
    (_, _, data, bounds), = X.slices(items["text"], 1 << 40)
    w = X.words(data, bounds, X.ALNUM, lower=True)
    count = np.diff(w.first)
    size, owner = np.minimum(count, window), w.owner
    starts = np.arange(len(owner)) + size[owner] <= w.first[1:][owner] if len(owner) else np.zeros(0, bool)
    names = items["item"].to_pylist()
    out = []
    for m in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(starts & (size[owner] == m))
        out.append(WuManber(w, m, at, owner[at], names))
    return out


def _batch(batch: pa.RecordBatch, finders: list[WuManber]) -> Iterator[pa.RecordBatch]:
    ids = batch.column(0)
    for lo, hi, data, bounds in X.slices(batch.column(1)):
        w = X.words(data, bounds, X.ALNUM, lower=True)
        n, k = len(w.hash), hi - lo
        cover = np.zeros(n + 1, np.int64)
        items: dict[int, set[str]] = {}
        for f in finders:
            start, which = f.places(w)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + f.m, -1)
            text = np.searchsorted(w.first, start, "right") - 1
            for t, p in set(zip(text.tolist(), which.tolist(), strict=True)):
                items.setdefault(t, set()).update(f.items(p))
        hit = np.cumsum(cover[:n]) > 0
        owner = w.owner
        n_hit = np.bincount(owner[hit], minlength=k)
        starts, ends = [[] for _ in range(k)], [[] for _ in range(k)]
        fresh = hit & ~np.concatenate([[False], hit[:-1]]) if n else hit
        first = np.isin(np.arange(n), w.first[:-1]) if n else hit
        fresh |= hit & first
        last = hit & ~np.concatenate([hit[1:], [False]]) if n else hit
        last |= hit & np.concatenate([first[1:], [True]]) if n else hit
        for i, j in zip(np.flatnonzero(fresh).tolist(), np.flatnonzero(last).tolist(), strict=True):
            t = int(owner[i])
            starts[t].append(i - int(w.first[t]))
            ends[t].append(j + 1 - int(w.first[t]))
        yield pa.RecordBatch.from_arrays(
            [ids.slice(lo, k), *(c.slice(lo, k) for c in batch.columns[2:]), pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(items.get(t, ())) for t in range(k)], pa.list_(pa.string()))],
            names=["doc_id", *batch.schema.names[2:], "n_words", "n_hit", "starts", "ends", "items"],
        )


def _parts(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[tuple[bool, Broadcast]]:
    """The searches for each part of the benchmark, and whether it is all of it; the driver holds one part at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // block_chars))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else rows
        shared = spark.sparkContext.broadcast(searches(own.toArrow(), window))
        yield parts == 1, shared
        if parts > 1:
            shared.destroy()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, without any window of the benchmark; each is judged where it stands."""
    at = docs.columns.index("text")

    for whole, shared in _parts(benchmark, window, block_chars):

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, data, bounds in X.slices(b.column(at)):
                    w = X.words(data, bounds, X.ALNUM, lower=True)
                    good = np.ones(hi - lo, bool)
                    for f in shared.value:
                        good[np.searchsorted(w.first, f.places(w)[0], "right") - 1] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(good))

        docs = docs.transform(X.streamed(judge, docs.schema))
        docs = docs if whole else saved(docs)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: word count, words hit, hit spans [start, end) and items found.

    The benchmark is measured first; beyond ``block_chars`` it is searched for
    in several passes, each with a part that small, and the parts are joined by
    id and the text's hash: what is found hangs on the text alone.
    """
    rows_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed, schema = rows_of.withColumn("own", F.xxhash64("text")), SCHEMA.replace("n_words", "own bigint, n_words", 1)
    out = None
    for whole, shared in _parts(benchmark, window, block_chars):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _batch(b, shared.value)

        if whole:
            return rows_of.transform(X.streamed(scan, SCHEMA))
        found = saved(keyed.transform(X.streamed(scan, schema)).where("n_hit > 0"))
        out = found if out is None else out.unionByName(found)
    spans = out.select("doc_id", "own", F.explode(F.arrays_zip("starts", "ends")).alias("s")).groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    items = out.select(F.col("doc_id").alias("i_id"), F.col("own").alias("i_own"), F.explode("items").alias("i")).groupBy("i_id", "i_own").agg(F.sort_array(F.collect_set("i")).alias("items"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= s["starts"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(s))),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batch(b, [])

    base = keyed.transform(X.streamed(count, schema)).select("doc_id", "own", "n_words")
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("own").alias("s_own"), merged.alias("m"))
    same = lambda a, b: F.col(f"{a}_id" if a else "doc_id").eqNullSafe(F.col(f"{b}_id")) & (F.col(f"{a}_own" if a else "own") == F.col(f"{b}_own"))
    n_hit = F.aggregate("m", F.lit(0).cast("bigint"), lambda a, s: a + s["ends"] - s["starts"])
    return base.join(spans.join(items, same("s", "i"), "left"), same("", "s"), "left").select(
        "doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce(F.col("m.starts"), F.expr("cast(array() as array<bigint>)")).alias("starts"), F.coalesce(F.col("m.ends"), F.expr("cast(array() as array<bigint>)")).alias("ends"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )
