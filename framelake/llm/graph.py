"""Helpers on links between documents: connected components and small membership filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import text as X
from .storage import dropped, saved

#: Bits of the largest membership filter that is sent to tasks.
MOST_BITS = 1 << 27
#: Shares into which the rows of a frequent key are dealt, and from how many rows on a key may be one.
SHARES, FREQUENT = 64, 5_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) for every node of ``links`` (a, b).

    Alternating large-star and small-star steps: every step replaces links by
    links to smaller neighbours, and links of one node are first merged where
    they stand.  Nodes with very many links lose them in the small-star steps,
    as everything they hold points to their smallest neighbour afterwards.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour, or to the node
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours, and the node, are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, edges = edges, saved(small.where("a <> b").distinct())
        dropped(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Filter:
    """A Bloom filter of 64-bit values in an array of bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, np.uint64(len(words) * 64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for p in positions(values, int(self.bits)):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


class Everything(Filter):
    """What stands for a filter that would let nearly all through."""

    def __init__(self) -> None:
        super().__init__(np.zeros(1, np.uint64))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return np.ones(len(values), bool)


def positions(values: np.ndarray, bits: int) -> list[np.ndarray]:
    v = values.view(np.uint64) if values.dtype != np.uint64 else values
    return [(v * np.uint64(f) >> np.uint64(20)) % np.uint64(bits) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def membership(values: DataFrame, column: str, n: int, most_bits: int = MOST_BITS) -> Filter:
    """A filter that holds all values of a bigint column; at most ``most_bits`` bits come to the driver.

    It lets through some others, more of them once the values outgrow the
    largest filter, and all where it would be full; whoever uses it must stay
    right whatever passes.
    """
    if n > most_bits:
        return Everything()
    bits = 1 << 16
    while bits < min(n * 16, most_bits):
        bits *= 2

    def run(batches):
        mine = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for p in positions(b.column(0).to_numpy(), bits):
                np.bitwise_or.at(mine, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        for lo in range(0, len(mine), 1 << 12):
            part = mine[lo : lo + (1 << 12)]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at + lo, pa.int32()), pa.array(part[at].view(np.int64))], names=["w", "b"])

    got = values.select(F.col(column).cast("bigint")).transform(X.streamed(run, "w int, b bigint")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    if got.num_rows:
        words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return Filter(words)


def split(rows: DataFrame, column: str, values: Filter) -> tuple[DataFrame, DataFrame]:
    """Rows whose bigint ``column`` may be among the values, and rows where it surely is not (null never is); all columns stay.

    The rows are read once for each part.
    """

    def part(side: bool):
        def run(batches: X.Batches) -> X.Batches:
            for b in batches:
                if b.num_rows:
                    v = b.column(b.schema.get_field_index(column))
                    mark = values.value(v.fill_null(0).to_numpy()) & v.is_valid().to_numpy(zero_copy_only=False)
                    yield b.filter(pa.array(mark == side))

        return rows.transform(X.streamed(run, rows.schema))

    values = rows.sparkSession.sparkContext.broadcast(values)
    return part(True), part(False)


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows whose bigint ``column`` is not in the like column of ``gone``; only rows that a filter of those lets through are dealt."""
    name = fresh(rows.columns, "gone")
    gone = gone.select(F.col(column).alias(name)).distinct()
    doubtful, sure = split(rows, column, membership(gone, name, gone.count()))
    return sure.unionByName(doubtful.join(gone, F.col(column) == F.col(name), "left_anti"))


def frequent(rows: int) -> int:
    """From how many rows on a key is frequent, among ``rows`` rows: at most 4096 keys are."""
    return max(FREQUENT, rows >> 12)


def joined(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame, n_hot: int) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key), where the keys in ``hot`` are frequent among the rows.

    Rows of a frequent key are dealt in shares by the bigint column ``by``, each
    meeting its own copy of the key's row.  Which keys are spread a filter tells,
    the same for both sides, so what it lets through by mistake is only spread.
    """
    if not n_hot:
        return rows.join(table, key)
    share = fresh([*rows.columns, *table.columns], "share")
    shared = rows.sparkSession.sparkContext.broadcast(membership(hot, key, n_hot))

    def deal(batches: X.Batches) -> X.Batches:
        for b in batches:
            spread = shared.value(b.column(b.schema.get_field_index(key)).to_numpy())
            mixed = X.mix(b.column(b.schema.get_field_index(by)).to_numpy().view(np.uint64)) % np.uint64(SHARES)
            yield b.append_column(share, pa.array(np.where(spread, mixed, np.uint64(0)).astype(np.int32)))

    def copy(batches: X.Batches) -> X.Batches:
        for b in batches:
            times = np.where(shared.value(b.column(b.schema.get_field_index(key)).to_numpy()), SHARES, 1)
            at = np.repeat(np.arange(b.num_rows), times)
            yield b.take(pa.array(at)).append_column(share, pa.array((np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)))

    wide = lambda df: StructType([*df.schema.fields, StructField(share, IntegerType())])
    return rows.transform(X.streamed(deal, wide(rows))).join(table.transform(X.streamed(copy, wide(table))), [key, share]).drop(share)


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of ``taken`` has, in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
