"""Document quality by kernel ridge regression on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised
statistics of a text (lengths, character classes, repetition).  Ridge weights
solve normal equations that are summed over partitions; scores become
probabilities by isotonic regression over their distribution on the training
rows.  Both are gathered in tables whose size does not depend on the corpus.

Cases: null or empty text has all statistics zero and is scored like any other;
label rows with a null label, and documents without labels, teach nothing; a
document labelled several times counts as often; without training rows of both
kinds every score is the training rate (0.5 if there are none); an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .storage import dropped, saved

#: Random features, kernel width (in standard deviations a statistic), ridge per training row.
FEATURES, WIDTH, RIDGE = 192, 1.2, 1e-3
#: Bins of the raw score in which calibration counts.
BINS = 1000

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!?", "|", "$%&#*@", "'\"-;:()[]/"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g.encode())] = _i
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
_LINES = X.word_bytes("\n\r")

STATISTICS = [
    "log_words", "log_chars", "word_length", "distinct_words", "lines_per_word", "line_repeats", "word_repeats",
    *(f"class_{i}" for i in range(_CLASSES)),
]


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice."""
    k = len(bounds) - 1
    w = X.words(data, bounds, X.SPACED)
    n_words, n_bytes = np.diff(w.first), np.diff(bounds)
    counts = np.bincount(np.repeat(np.arange(k) * _CLASSES, n_bytes) + _CLASS[data], minlength=k * _CLASSES).reshape(k, _CLASSES)
    words, chars = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    owner = w.owner
    pairs = np.unique(X.mix(w.hash + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(owner[pairs], minlength=k)
    lines = X.words(data, bounds, _LINES)
    line_owner = lines.owner
    line_pairs = np.unique(X.mix(lines.hash + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_lines = np.diff(lines.first)
    line_distinct = np.bincount(line_owner[line_pairs], minlength=k)
    same = np.zeros(len(w.hash), bool)
    if len(same) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    columns = [
        np.log1p(n_words), np.log1p(n_bytes), np.log1p((w.end - w.start).astype(float).sum() and np.bincount(owner, weights=w.end - w.start, minlength=k) / words),
        distinct / words, n_lines / words, (n_lines - line_distinct) / np.maximum(n_lines, 1), np.bincount(owner[same], minlength=k) / words,
    ]
    # shares are skewed towards zero: the root spreads them
    return np.column_stack([np.broadcast_to(c, (k,)) for c in columns] + [np.sqrt(counts / chars[:, None])])


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of ``docs``, as columns."""
    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in X.slices(b.column(1)):
                m = statistics(data, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(m[:, j]) for j in range(m.shape[1]))], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(X.streamed(run, schema))


class Kernel:
    """Standardisation and random Fourier features."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1.0 / np.where(deviation > 1e-9, deviation, 1.0)
        d = len(mean)
        self.w = rng.normal(size=(d, features)) / (width * np.sqrt(d))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.root = np.sqrt(2.0 / features)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STATISTICS])
        z = self.root * np.cos(np.clip((x - self.mean) * self.scale, -6, 6) @ self.w + self.phase)
        return np.column_stack([np.ones(len(z)), z])


def _summed(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """The matrix of the normal equations: partitions sum their own, then rows of it are summed by their number."""
    schema = "i int, v array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            z = kernel(b)
            y = b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            m = np.column_stack([z, y]).T @ np.column_stack([z, y])
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.stack([np.asarray(v) for v in table["v"].to_pylist()])
        return pa.table({"i": table["i"][:1], "v": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    got = rows.transform(X.streamed(part, schema)).groupBy("i").applyInArrow(add, schema).toArrow()
    n = FEATURES + 2
    out = np.zeros((n, n))
    for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist(), strict=True):
        out[i] = v
    return out


def isotonic(value: np.ndarray, count: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins: knots of a rising curve from raw score to rate."""
    blocks: list[list[float]] = []  # weight, positives, sum of values
    for v, c, p in zip(value, count, positive, strict=True):
        blocks.append([c, p, v * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, p2, v2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + p2, blocks[-1][2] + v2]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


@dataclass
class Model:
    """What training gives: the kernel, its weights and the calibration curve; or one rate, where there is nothing to tell apart."""

    rate: float
    kernel: Kernel | None = None
    weights: np.ndarray | None = None
    raw: np.ndarray | None = None
    risen: np.ndarray | None = None

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """Scores of rows of STATISTICS."""
        if self.kernel is None:
            return np.full(batch.num_rows, self.rate)
        return np.interp(self.kernel(batch) @ self.weights, self.raw, self.risen)


def _fit(rows: DataFrame, labels: DataFrame, learn_from: Column, label: str) -> Model:
    """A model from the statistics of all documents, standardised over all of them, and the labels that may teach."""
    moments = rows.agg(*[F.avg(c) for c in STATISTICS], *[F.stddev_pop(c) for c in STATISTICS]).first()
    values = np.array([0.0 if v is None else v for v in moments], float)
    kernel = Kernel(values[: len(STATISTICS)], values[len(STATISTICS) :])
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label")).where(learn_from)
    known = saved(rows.join(told, "doc_id"))
    m = _summed(known, kernel)
    n, ones = m[0, 0], m[0, -1]
    if not 0 < ones < n:
        dropped(known)
        return Model(float(ones / n) if n else 0.5)
    a = m[:-1, :-1] + np.diag([1e-9, *([RIDGE * n / FEATURES] * FEATURES)])
    weights = np.linalg.solve(a, m[:-1, -1])

    def raw(batches: X.Batches) -> X.Batches:
        for b in batches:
            y = b.column(b.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([pa.array(kernel(b) @ weights), y], names=["raw", "label"])

    bin_of = F.floor((F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)).cast("int")
    got = known.transform(X.streamed(raw, "raw double, label double")).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.sum("raw").alias("s")).orderBy("bin").collect()
    dropped(known)
    count = np.array([r["n"] for r in got], float)
    return Model(float(ones / n), kernel, weights, *isotonic(np.array([r["s"] for r in got]) / count, count, np.array([r["p"] for r in got])))


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for every row of ``docs``.

    ``learn_from`` says, by ``doc_id``, which labelled documents may teach.
    """
    rows = saved(features_of(docs), narrow=True)
    model = _fit(rows, labels, learn_from, label)

    def final(batches: X.Batches) -> X.Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(model(b))], names=["doc_id", "score"])

    return rows.transform(X.streamed(final, "doc_id bigint, score double"))


def keep(docs: DataFrame, labels: DataFrame, learn_from: Column, least: float, label: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` at least.

    Every row is judged where it stands, on its text alone, so nothing is
    joined or dealt: rows that share an id, or have none, are judged each.
    """
    rows = saved(features_of(docs), narrow=True)
    model = _fit(rows, labels, learn_from, label)
    dropped(rows)

    def judge(batches: X.Batches) -> X.Batches:
        for b in batches:
            for lo, hi, data, bounds in X.slices(b.column(b.schema.get_field_index("text"))):
                m = statistics(data, bounds)
                good = model(pa.RecordBatch.from_arrays([pa.array(m[:, j]) for j in range(m.shape[1])], names=STATISTICS)) >= least
                yield b.slice(lo, hi - lo).filter(pa.array(good))

    return docs.transform(X.streamed(judge, docs.schema))
