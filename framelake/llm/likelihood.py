"""Language-model scores: marginal likelihood over a subword lattice.

The vocabulary of pieces is an existing one; its scores rank the pieces and are
the prior of their probabilities, to which the training words' own piece counts
are added.  Every path through a word's lattice of pieces is a segmentation; a
forward recursion in log space sums them all.  Words are cut at white space, so
a document's lattice is the chain of its words' lattices and its marginal is the
sum of theirs, each computed once for each distinct word.

The lattice of a word also has one arc that spans it whole, with the word's
share of the training tokens.  ``held`` is the mass left to the pieces: the
share of training tokens that stand there once (Good-Turing).  With it,
P(word) = (1 - held) * c / N + held * P(pieces), which sums to one.

Words are known by 64-bit hashes.  The commonest words, at most ``COMMON``, are
sent to every task; all others are joined by hash, so none is left out and none
of the joined keys is frequent.

Cases: null or empty text is its end token only; without training documents
everything is unknown and the pieces have all the mass; very long words run
through the same recursion; repeated rows count and are scored each, rows that
share an id or have none each by their own text; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .storage import saved

#: Words whose scores every task holds; the others are joined.
COMMON = 500_000
#: Distinct words that a task gathers before it passes their counts on.
GATHER = 400_000
#: Pseudo-counts of the prior, over all pieces.
PRIOR = 20_000.0
_SPACE = "▁".encode()
_LONGEST = 32  # bytes of a piece


class Pieces:
    """Log probabilities of the pieces of a vocabulary, looked up by hash."""

    def __init__(self, names: list[bytes], logp: np.ndarray, byte_logp: np.ndarray):
        first = [(n[len(_SPACE) :], p) for n, p in zip(names, logp.tolist(), strict=True) if n.startswith(_SPACE)]
        self.space = next((p for n, p in first if not n), -30.0)
        self.tables = [self._table([x for x in first if x[0]]), self._table([(n, p) for n, p in zip(names, logp.tolist(), strict=True) if not n.startswith(_SPACE)])]
        self.bytes = byte_logp
        self.longest = min(_LONGEST, max(len(n) for n in names))

    @staticmethod
    def _table(items: list[tuple[bytes, float]]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(n for n, _ in items), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(n) for n, _ in items])])
        h = hashes(data, bounds[:-1], bounds[1:])
        order = np.argsort(h)
        return h[order], np.array([p for _, p in items])[order]

    def find(self, which: int, h: np.ndarray) -> np.ndarray:
        keys, values = self.tables[which]
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.where(keys[at] == h, values[at], -np.inf)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges [start, end)."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(X._BYTE_VALUE[data] * X._power("up", len(data)), out=total[1:])
    return (total[end] - total[start]) * X._power("down", len(data) + 1)[start] + (end - start).astype(np.uint64)


def marginals(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of the summed probability of all segmentations of each word.

    Words of one length go through the recursion together; position j adds up,
    over the pieces that end there, the mass at their start times their own.
    """
    size = np.array([len(w) for w in words], np.int64)
    out = np.full(len(words), -np.inf)
    data = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        if not n:
            continue
        for lo in range(0, len(rows), 1 << 14):
            part = rows[lo : lo + (1 << 14)]
            m = data[begin[part][:, None] + np.arange(n)]
            flat = np.ascontiguousarray(m).reshape(-1)
            base = np.arange(len(part)) * n
            total = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(X._BYTE_VALUE[flat] * X._power("up", len(flat)), out=total[1:])
            down = X._power("down", len(flat) + 1)
            alpha = np.full((n + 1, len(part)), -np.inf)
            alpha[0] = pieces.space
            for j in range(1, n + 1):
                terms = [alpha[j - 1] + pieces.bytes[m[:, j - 1]]]
                for i in range(max(0, j - pieces.longest), j):
                    h = (total[base + j] - total[base + i]) * down[base + i] + np.uint64(j - i)
                    terms.append(alpha[i] + pieces.find(1, h))
                    if i == 0:
                        terms.append(pieces.find(0, h))
                t = np.stack(terms)
                top = t.max(0)
                alpha[j] = top + np.log(np.exp(t - top).sum(0))
            out[part] = alpha[n]
    return out


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """h, word, c (training tokens) and every (all tokens) for each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            names = [w for x in held for w in x[1]]
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            c, every = (np.bincount(inverse, weights=np.concatenate([x[j] for x in held]), minlength=len(u)).astype(np.int64) for j in (2, 3))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array([names[i] for i in first.tolist()], pa.binary()), pa.array(c), pa.array(every)], names=["h", "word", "c", "every"])

        for b in batches:
            train = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            for lo, hi, data, bounds in X.slices(b.column(0)):
                w = X.words(data, bounds, X.SPACED, lower=True)
                if not len(w.hash):
                    continue
                u, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                c = np.bincount(inverse, weights=train[lo:hi][w.owner], minlength=len(u))
                held.append((u, [w.word(i) for i in first.tolist()], c, np.bincount(inverse, minlength=len(u))))
                if sum(len(x[0]) for x in held) > GATHER:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select("text", F.coalesce(training, F.lit(False)).alias("t")).transform(X.streamed(run, "h bigint, word binary, c bigint, every bigint"))
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def piece_counts(words: DataFrame, model_path: str) -> np.ndarray:
    """How often each piece stands in the training words, as the vocabulary's own segmentation cuts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        total = np.zeros(sp.get_piece_size())
        for b in batches:
            c = b.column(1).to_numpy().astype(float)
            ids = sp.encode([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], num_threads=1)
            n = [len(x) for x in ids]
            total += np.bincount(np.concatenate([np.array(x, np.int64) for x in ids] + [np.zeros(0, np.int64)]), weights=np.repeat(c, n), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

    got = words.where("c > 0").select("word", "c").transform(X.streamed(run, "piece int, n double")).groupBy("piece").agg(F.sum("n").alias("n")).collect()
    import sentencepiece

    out = np.zeros(sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size())
    for r in got:
        out[r["piece"]] = r["n"]
    return out


def vocabulary(model_path: str, counts: np.ndarray) -> Pieces:
    """Piece probabilities: training counts over a prior that falls with the vocabulary's own scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i).encode() for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)])
    ordinary = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and not names[i].startswith(_SPACE * 2) and len(names[i]) <= _LONGEST for i in range(n)])
    is_byte = np.array([sp.is_byte(i) for i in range(n)])
    prior = np.where(ordinary, 1.0 / (10.0 - score.clip(-1e6, 0)), 0.0)
    prior[is_byte] = 1e-5
    p = np.where(ordinary | is_byte, counts, 0.0) + PRIOR * prior / prior.sum()
    logp = np.log(p / p.sum(), where=p > 0, out=np.full(n, -np.inf))
    byte = np.full(256, -np.inf)
    for i in np.flatnonzero(is_byte).tolist():
        byte[int(names[i][3:5], 16)] = logp[i]
    use = np.flatnonzero(ordinary)
    return Pieces([names[i] for i in use], logp[use], byte)


def lattice(words: DataFrame, pieces) -> DataFrame:
    """h, c and ``sub``: log10 of the pieces' marginal, for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(marginals(b.column(1).to_pylist(), pieces.value) / math.log(10))], names=["h", "c", "sub"])

    return words.select("h", "word", "c").transform(X.streamed(run, "h bigint, c bigint, sub double"))


def score(docs: DataFrame, training: Column, model_path: str, common: int = COMMON) -> DataFrame:
    """Counts and log10 scores of every row of ``docs``; ``training`` says which rows teach.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark = docs.sparkSession
    words = saved(word_counts(docs, training))
    n_train = docs.where(training).count()
    total = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("bigint")).alias("v"), F.sum((F.col("c") == 1).cast("bigint")).alias("once")).first()
    n, v = (total["n"] or 0) + n_train, (total["v"] or 0) + (n_train > 0)
    once = (total["once"] or 0) + (n_train == 1)
    held = min(1.0, max(1e-6, (once + 0.5) / (n + 1))) if n else 1.0
    unseen = math.log10(n + 0.1 * (v + 1))
    pieces = spark.sparkContext.broadcast(vocabulary(model_path, piece_counts(words, model_path)))

    base = F.log10(F.col("c") + F.lit(0.1)) - F.lit(unseen)
    by_pieces = F.col("sub") + F.lit(math.log10(held))
    whole = F.log10(F.col("c").cast("double") * F.lit((1 - held) / n if n else 0.0))
    most = F.greatest(whole, by_pieces)
    both = most + F.log10(F.pow(F.lit(10.0), whole - most) + F.pow(F.lit(10.0), by_pieces - most))
    model = F.when((F.col("c") > 0) & F.lit(held < 1), both).otherwise(by_pieces)
    scored = lambda part: lattice(part, pieces).select("h", (F.col("c") > 0).alias("known"), base.alias("base"), model.alias("model"))

    # the commonest words: the lowest power-of-two-step count that at most ``common`` words reach
    steps = words.groupBy(F.floor(F.log2(F.col("every").cast("double")) * 4).alias("step")).count().orderBy(F.desc("step")).collect()
    cut, have = math.inf, 0
    for r in steps:
        if have + r["count"] > common:
            break
        cut, have = r["step"], have + r["count"]
    step = F.floor(F.log2(F.col("every").cast("double")) * 4)
    kept = (scored(words.where(step >= cut)) if have else scored(words).limit(0)).toArrow()
    h = kept["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    table = (h[order], *(kept[c].to_numpy()[order] for c in ("known", "base", "model")))
    shared = spark.sparkContext.broadcast(table)
    # the end token of every document
    end_base = math.log10(n_train + 0.1) - unseen
    end_model = math.log10(max(1e-12, (1 - held) * n_train / n)) if n else 0.0

    def look(w: X.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
        keys = shared.value[0]
        at = np.searchsorted(keys, w.hash)
        at[at == len(keys)] = 0
        return at, (keys[at] == w.hash) if len(keys) else np.zeros(len(w.hash), bool)

    # a row is known by its id and its text's hash; ``n_rare`` counts its words that are joined
    def commons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known, base, model = shared.value
        for b in batches:
            for lo, hi, data, bounds in X.slices(b.column(1)):
                w, k = X.words(data, bounds, X.SPACED, lower=True), hi - lo
                at, hit = look(w, k)
                n_rare = np.bincount(w.owner[~hit], minlength=k)
                at, owner = at[hit], w.owner[hit]
                add = lambda x: np.bincount(owner, weights=x[at].astype(float), minlength=k)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, k), b.column(2).slice(lo, k), pa.array(n_rare, pa.int64()), pa.array(np.diff(w.first) + 1), pa.array(add(known).astype(np.int64) + (n_train > 0)), pa.array(add(base) + end_base), pa.array(add(model) + end_model)],
                    names=["row", "own", "n_rare", "n_tokens", "n_known", "base", "model"],
                )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in X.slices(b.column(1)):
                w = X.words(data, bounds, X.SPACED, lower=True)
                _, hit = look(w, hi - lo)
                if not hit.all():
                    owner = pa.array(w.owner[~hit] + lo)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(2).take(owner), pa.array(w.hash[~hit].view(np.int64))], names=["row", "own", "h"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("row"), "text", F.xxhash64("text").alias("own"))
    sums = text.transform(X.streamed(commons, "row bigint, own bigint, n_rare bigint, n_tokens bigint, n_known bigint, base double, model double"))
    if cut > (steps[-1]["step"] if steps else math.inf):
        rare = text.transform(X.streamed(others, "row bigint, own bigint, h bigint")).join(scored(words.where(step < F.lit(cut)) if cut != math.inf else words), "h")
        rare = rare.groupBy(F.col("row").alias("r2"), F.col("own").alias("o2")).agg(F.count("*").alias("all_rare"), F.sum(F.col("known").cast("bigint")).alias("k2"), F.sum("base").alias("b2"), F.sum("model").alias("m2"))
        # equal rows are one group here, that holds the words of each of them
        copies = F.col("all_rare") / F.col("n_rare")
        k2, b2, m2 = (F.coalesce(F.col(c) / copies, F.lit(0.0)) for c in ("k2", "b2", "m2"))
        sums = sums.join(rare, F.col("row").eqNullSafe(F.col("r2")) & (F.col("own") == F.col("o2")), "left")
        sums = sums.select("row", "n_tokens", (F.col("n_known") + F.round(k2).cast("bigint")).alias("n_known"), (F.col("base") + b2).alias("base"), (F.col("model") + m2).alias("model"))
    return sums.select(F.col("row").alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))
