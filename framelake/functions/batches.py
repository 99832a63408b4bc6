"""Batches of bounded size: Spark bounds an Arrow batch by rows, and pictures and streams are long rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that are looked at, or given back, together; one longer row is a part alone.
PART_ROWS, PART_BYTES = 256, 1 << 20

Batches = Iterator[pa.RecordBatch]


def parts(batches: Iterable[pa.RecordBatch]) -> Batches:
    """The same rows in the same order, in slices of bounded rows and bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(PART_ROWS, b.num_rows * PART_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def packed(rows: Iterable[tuple], schema: pa.Schema) -> Batches:
    """Rows as batches, each sent as soon as it holds enough."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) if isinstance(x, bytes) else 200 * len(x) for x in row if isinstance(x, (bytes, list)))
        if len(out) >= PART_ROWS or size >= PART_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def release() -> None:
    """Gives freed memory back, so that a reused worker does not keep what an earlier task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` over slices of bounded size; its memory is given back at the end of each task."""

    def over(batches: Batches) -> Batches:
        try:
            yield from run(parts(batches))
        finally:
            release()

    return over


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as the session deals to.

    The number is given, as rows of few bytes may be much work (a payload is a
    picture), and Spark would gather them into one task by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
