"""Exact top-k search by integer inner product: MaxScore over vector shards.

A query's terms are its components.  Each shard of vectors knows the largest
and smallest value of every component, hence a bound on what a term can add to
any score.  Terms are ordered by that bound; the shortest run of leading terms
whose remainder cannot lift a vector over the query's k-th score is essential.
Essential terms are read for the whole shard, the others only for vectors that
are still competitive.  Shards are then merged.

Cases: vectors that are null, empty or hold null, NaN or infinite components
take no part; a query meets only vectors of its own length; equal scores go to
the smaller ``vec_id``; repeated ids are separate rows, a query's own rows
are those with its id, and queries with one id share one ranking.  An empty table gives no rows.
A component that a long cannot hold after scaling, or a score among the best
that it cannot hold, is an error and never a wrong number: scores whose bound
is beyond 64 bits are added up in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X

#: Queries that are sent to every shard in one round; more take further rounds.
ROUND = 65_536
#: Vectors of one shard that are scored together.
SHARD = 8_192
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def vectors(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and integer components; rows with unusable components are left out."""
    most = float(1 << 63)

    def whole(v):
        scaled = F.floor(v * F.lit(scale))
        large = F.abs(v * F.lit(scale)) >= most
        return F.when(large, F.raise_error(F.lit("a component is too large for a long"))).otherwise(scaled.cast("bigint"))

    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v"))


def _by_length(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield int(d), ids[rows], values[offsets[rows][:, None] + np.arange(d)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Shard:
    """Vectors of one length and the bounds of their components."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids = ids
        big = int(max(abs(int(v.max())), abs(int(v.min())))) if v.size else 0
        self.big, self.exact = big, v
        self.v = v.astype(np.float64) if big < 1 << 24 else v
        self.top, self.low = v.max(0), v.min(0)

    def search(self, query: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best other vectors; with ``floor``, only those that may reach it."""
        v, qq = self.v, q
        bound = max(abs(int(q.max())), abs(int(q.min()))) * self.big * len(q)
        if bound >= 1 << 62:
            return self._wide(query, q, k)
        if v.dtype == np.float64 and bound < 1 << 52:
            qq = q.astype(np.float64)
        else:
            v = self.exact
        most = np.maximum(qq * self.top, qq * self.low)
        order = np.argsort(-(most - np.minimum(qq * self.top, qq * self.low)), kind="stable")
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # rest[i]: at most what terms from i on add
        if floor is None or rest[0] >= floor and len(v) < 64:
            score, alive = v @ qq, np.arange(len(v))
        elif rest[0] < floor:
            return self.ids[:0], np.zeros(0, np.int64)
        else:
            essential = max(len(q) // 4, int(np.argmax(rest < floor)) if (rest < floor).any() else len(q))
            head = order[:essential]
            score = v[:, head] @ qq[head]
            alive = np.flatnonzero(score + rest[essential] >= floor)
            score = score[alive]
            for a in range(essential, len(q), 8):
                if not len(alive):
                    break
                part = order[a : a + 8]
                score = score + v[np.ix_(alive, part)] @ qq[part]
                keep = score + rest[min(a + 8, len(q))] >= floor
                alive, score = alive[keep], score[keep]
        other = self.ids[alive] != query
        return _best(self.ids[alive][other], score[other].astype(np.int64), k)


    def _wide(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every score as a whole number of any size; one beyond a long becomes its end, which no result may show."""
        score = self.exact.astype(object) @ q.astype(object)
        best = sorted((-s, i) for s, i in zip(score.tolist(), self.ids.tolist(), strict=True) if i != query)[:k]
        return np.array([i for _, i in best], np.int64), np.array([max(_LEAST, min(_MOST, -s)) for s, _ in best], np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined until they fill a shard."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SHARD:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _search(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in _gathered(batches):
        every = batch.column(0).to_numpy()
        for lo in range(0, len(every), SHARD):
            for d, ids, v in _by_length(every[lo : lo + SHARD], batch.column(1).slice(lo, SHARD)):
                if d not in queries:
                    continue
                shard = Shard(ids, v)
                for row, (query, q) in enumerate(zip(queries[d][0].tolist(), queries[d][1], strict=True)):
                    have = best.get((d, row))
                    floor = int(have[1][-1]) if have is not None and len(have[0]) == k else None
                    ids2, score2 = shard.search(query, q, k, floor)
                    if len(ids2):
                        best[d, row] = _best(np.concatenate([have[0], ids2]), np.concatenate([have[1], score2]), k) if have is not None else (ids2, score2)
    if best:
        query = np.concatenate([np.full(len(x[0]), queries[d][0][row]) for (d, row), x in best.items()])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate([x[0] for x in best.values()]), pa.int64()), pa.array(np.concatenate([x[1] for x in best.values()]), pa.int64())], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, is_query, k: int = 5, round_size: int = ROUND) -> DataFrame:
    """The ``k`` best other vectors of every row where ``is_query`` holds: query_id, rank, vec_id, score.

    Queries go to the shards in rounds of at most about ``round_size``, so what
    is broadcast stays bounded however many there are.
    """
    spark = table.sparkSession
    v = vectors(table)
    asked = v.where(is_query).distinct()
    rounds = max(1, -(-asked.count() // round_size))
    out = None
    for r in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r) if rounds > 1 else asked
        got = rows.orderBy("vec_id").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        packed = {d: (ids, m) for d, ids, m in _by_length(got["vec_id"].to_numpy(), got["v"].combine_chunks() if isinstance(got["v"], pa.ChunkedArray) else got["v"])}
        shared = spark.sparkContext.broadcast(packed)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _search(batches, shared.value, k)

        found = v.transform(X.streamed(search, SCHEMA))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    score = F.when(F.col("score").isin(_LEAST, _MOST), F.raise_error(F.lit("a score is too large for a long"))).otherwise(F.col("score"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
