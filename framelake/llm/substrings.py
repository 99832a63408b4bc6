"""Substring deduplication: long passages that an earlier document has are removed.

A window is ``length`` consecutive words; a word goes if a window over it also
stands in a document with a smaller id.  Suffix automata of reference passages
decide: a document's words are streamed through the automaton of the document
that has the passage first, which tells at every word the longest run ending
there that the reference holds (matching statistics); runs of ``length`` words
and more are removed.

Which passages to hold against which references is found first, over all
documents, without looking at pairs:

1. Every window picks one anchor, the shorter run of words in it with the least
   hash, so equal windows pick equal anchors.  Anchors are counted; those of
   one document alone are out.
2. Consecutive windows with one anchor are a span.  Where all spans of an
   anchor are equal, the span is one row; where they differ, each of its windows
   is.  Rows are grouped by hash, and the least id of each group is its
   reference.  Groups are reduced before they are dealt; rows of groups without
   a partner stay where they are, and those of a frequent one are dealt in
   shares when they are joined back.
3. Rows that touch and have one reference become passages.  The passages of a
   reference, in shards of bounded length that overlap by a window, give the
   automata; passages meet their reference by its id, in shares of bounded
   size with a copy of the reference each.

Membership filters of bounded size only spare rows; what they let through by
mistake finds no partner later.  Where more anchors are shared than the largest
filter can tell, all spans are dealt once: about half the input's size more.

Cases: null or empty text has no words; documents shorter than a window keep
everything; a passage repeated inside one document stays; rows that repeat an
id must repeat its text and keep and lose the same words; rows without an id
keep everything; an empty table gives no rows; columns other than the id and
the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .graph import Filter, fresh, frequent, joined, membership, split
from .storage import dropped, saved

#: Words of a reference in one automaton.
SHARD_WORDS = 50_000
#: Passages checked against one copy of a reference.
SHARE = 128
#: Rows held as Python strings at a time.
PIECE = 400


def _value_ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of words, from the words' hashes."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * X._power("up", n), out=total[1:])
    return X.mix((total[end] - total[start]) * X._power("down", n + 1)[start] + (end - start).astype(np.uint64))


def spans(w: X.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, span hash, text, first window, windows) of every span of every text."""
    k = length // 2 + 1
    many = length - k + 1
    none = np.zeros(0, np.int64)
    n = len(w.hash)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    g = X.grams(w.hash, k)
    pick = np.lib.stride_tricks.sliding_window_view(g, many).argmin(1) + np.arange(len(g) - many + 1)
    at = np.arange(len(pick))
    owner = w.owner[: len(pick)]
    inside = w.first[1:][owner] - at >= length
    at, pick, owner = at[inside], pick[inside], owner[inside]
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    fresh = np.concatenate([[True], (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(fresh)
    start, count = at[first], np.diff(np.append(first, len(at)))
    anchor = g[pick[first]]
    whole = _value_ranges(w.hash, start, start + count - 1 + length)
    return anchor, X.mix(whole + (pick[first] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner[first], start, count


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, X.Words]]:
    ids = b.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, bounds in X.slices(b.column(1)):
        yield ids[lo:hi], X.words(data, bounds, X.SPACED)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, for passes that hold texts as Python strings."""
    for b in batches:
        for lo in range(0, b.num_rows, PIECE):
            yield b.slice(lo, PIECE)


def shared_anchors(docs: DataFrame, length: int) -> DataFrame:
    """Anchors that stand in several documents, and whether their spans differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, w in _read(b):
                anchor, whole, owner, _, _ = spans(w, length)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[owner].astype(np.int64))], names=["anchor", "span", "doc"])

    rows = docs.transform(X.streamed(run, "anchor bigint, span bigint, doc bigint"))
    found = rows.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("span").alias("s1"), F.max("span").alias("s2"))
    return saved(found.where("low < high").select("anchor", (F.col("s1") != F.col("s2")).alias("differ")))


def anchor_filters(docs: DataFrame, length: int) -> tuple[Filter, Filter]:
    """Anchors that several documents have, and those of them whose spans differ."""
    anchors = shared_anchors(docs, length)
    sizes = anchors.agg(F.count("*").alias("n"), F.sum(F.col("differ").cast("bigint")).alias("d")).first()
    filters = membership(anchors, "anchor", sizes["n"]), membership(anchors.where("differ"), "anchor", sizes["d"] or 0)
    dropped(anchors)
    return filters


def candidate_rows(docs: DataFrame, length: int, *filters: Filter) -> DataFrame:
    """key, doc, pos, n: spans, or their windows, whose anchor several documents have; with a third filter, only keys in it."""
    filters = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, differ, *wanted = filters.value
        for b in batches:
            for ids, w in _read(b):
                anchor, whole, owner, start, count = spans(w, length)
                keep = shared(anchor)
                apart = differ(anchor) & keep
                one = keep & ~apart
                at = np.repeat(start[apart], count[apart]) + np.arange(int(count[apart].sum())) - np.repeat(np.cumsum(count[apart]) - count[apart], count[apart])
                who = np.repeat(owner[apart], count[apart])
                windows = _value_ranges(w.hash, at, at + length) if len(at) else np.zeros(0, np.uint64)
                key = np.concatenate([X.mix(whole[one] ^ np.uint64(0x5555555555555555)), windows])
                place, texts = np.concatenate([start[one], at]), np.concatenate([owner[one], who])
                n = np.concatenate([count[one], np.ones(len(at), np.int64)])
                for f in wanted:
                    use = f(key)
                    key, place, texts, n = key[use], place[use], texts[use], n[use]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[texts].astype(np.int64)), pa.array((place - w.first[texts]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "doc", "pos", "n"])

    return docs.transform(X.streamed(run, "key bigint, doc bigint, pos int, n int"))


def passages(docs: DataFrame, length: int) -> DataFrame:
    """doc, ref, start, stop: passages (in words) and the first document that has them; its own too, as its reference."""
    filters = anchor_filters(docs, length)
    seen = candidate_rows(docs, length, *filters).groupBy("key").agg(F.min("doc").alias("ref"), F.max("doc").alias("high"), F.count("*").alias("rows"))
    low = saved(seen.where("ref < high").select("key", "ref", "rows"))
    sizes = low.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    hot = low.where(F.col("rows") >= frequent(sizes["rows"] or 0)).select("key")
    rows = candidate_rows(docs, length, *filters, membership(low, "key", sizes["n"]))
    met = joined(rows, low.select("key", "ref"), "key", "doc", hot, hot.count())
    found = met.select("doc", "pos", "n", "ref").repartition("doc").sortWithinPartitions("doc", "pos")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            doc, pos, n, ref = (b.column(i).to_numpy().astype(np.int64) for i in range(4))
            stop = pos + n
            if held is not None:
                doc, pos, stop, ref = (np.append(h, x) for h, x in zip(held, (doc, pos, stop, ref), strict=True))
            if not len(doc):
                continue
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (pos[1:] > stop[:-1])])
            first = np.flatnonzero(fresh)
            out = doc[first], pos[first], np.maximum.reduceat(stop, first), ref[first]
            held = tuple(x[-1:] for x in out)
            yield to([x[:-1] for x in out])
        if held is not None:
            yield to(held)

    def to(x) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[3]), pa.array(x[1]), pa.array(x[2] + (length - 1))], names=["doc", "ref", "start", "stop"])

    out = saved(found.transform(X.streamed(merge, "doc bigint, ref bigint, start bigint, stop bigint")))
    dropped(low)
    return out


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, sequence: list[str]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in sequence:
            if c in nxt[last]:
                last = self._split(last, c)
                continue
            new = len(link)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, c)
            last = new

    def _split(self, p: int, c: str) -> int:
        nxt, link, size = self.next, self.link, self.size
        q = nxt[p][c]
        if size[q] == size[p] + 1:
            return q
        copy = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def long_runs(self, sequence: list[str], length: int) -> list[tuple[int, int]]:
        """Maximal stretches covered by runs of at least ``length`` words that the reference holds."""
        nxt, link, size = self.next, self.link, self.size
        out: list[list[int]] = []
        state = n = 0
        for i, c in enumerate(sequence):
            arcs = nxt[state]
            if c in arcs:
                state = arcs[c]
                n += 1
            else:
                while state > 0 and c not in nxt[state]:
                    state = link[state]
                if c in nxt[state]:
                    n = size[state] + 1
                    state = nxt[state][c]
                else:
                    n = 0
            if n >= length:
                if out and i + 1 - n <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([i + 1 - n, i + 1])
        return [(a, b) for a, b in out]


def _shards(texts: list[str], length: int) -> Iterator[list[list[str]]]:
    """Sequences of words in shards of about SHARD_WORDS; every window lies whole in one."""
    shard, held = [], 0
    for t in texts:
        words = t.split(" ")
        for lo in range(0, max(1, len(words) - length + 1), SHARD_WORDS):
            part = words[lo : lo + SHARD_WORDS + length - 1]
            if held and held + len(part) > SHARD_WORDS:
                yield shard
                shard, held = [], 0
            shard.append(part)
            held += len(part)
    if shard:
        yield shard


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """doc, start, stop: the stretches of words to remove."""
    runs = passages(docs, length)
    wanted = docs.sparkSession.sparkContext.broadcast(membership(runs.select("doc").distinct(), "doc", runs.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(wanted.value(b.column(0).to_numpy())))

    texts = docs.transform(X.streamed(pick, "doc bigint, text string"))
    listed = runs.groupBy("doc").agg(F.collect_list(F.struct("ref", "start", "stop")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            out = []
            for doc, text, its in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode().split()
                out.extend((doc, r["ref"], r["start"], b" ".join(words[r["start"] : r["stop"]]).decode()) for r in its)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc", "ref", "start", "words"])

    cuts = saved(texts.join(listed, "doc").transform(X.streamed(cut, "doc bigint, ref bigint, start bigint, words string")))
    # a reference with many passages to check is dealt in shares, each with its own copy of the reference
    shares = saved(cuts.where("doc > ref").groupBy("ref").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).withColumnRenamed("ref", "to"))
    dealt = cuts.join(shares, F.col("ref") == F.col("to"))
    own = F.col("doc") == F.col("ref")
    share = F.when(own, F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("shares")).cast("int")))
    dealt = dealt.select("ref", F.explode(share).alias("share"), F.when(own, 0).otherwise(1).alias("asks"), "doc", "start", "words")
    dealt = dealt.repartition("ref", "share").sortWithinPartitions("ref", "share", "asks", "start")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, held = None, [], None  # the reference at hand, and its automaton if one shard holds it
        for b in _pieces(batches):
            found = []
            ref, share, asks, doc, start, words = (b.column(i).to_pylist() for i in range(6))
            key = list(zip(ref, share, asks, strict=True))
            edges = [i for i in range(len(key)) if not i or key[i] != key[i - 1]] + [len(key)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if key[lo][:2] != now:
                    now, texts, held = key[lo][:2], [], None
                if not asks[lo]:
                    texts.extend(words[lo:hi])
                    continue
                queries = [x.split(" ") for x in words[lo:hi]]
                n = 0
                for a in [held] if held is not None else _automata(sorted(set(texts)), length):
                    n, last = n + 1, a
                    for i, q in zip(range(lo, hi), queries, strict=True):
                        found.extend((doc[i], start[i] + x, start[i] + y) for x, y in a.long_runs(q, length))
                held = last if n == 1 else None
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["doc", "start", "stop"])

    return dealt.transform(X.streamed(stream, "doc bigint, start bigint, stop bigint"))


def _automata(texts: list[str], length: int) -> Iterator[SuffixAutomaton]:
    for shard in _shards(texts, length):
        a = SuffixAutomaton()
        for sequence in shard:
            a.add(sequence)
        yield a


def _cut(batch: pa.RecordBatch, text: int, runs: int | None) -> tuple[list[int], list[int], list[str]]:
    """Words, words removed and the rest of every text of the batch."""
    n_words, n_removed, kept = [], [], []
    gone_of = batch.column(runs).to_pylist() if runs is not None else [None] * batch.num_rows
    for value, its in zip(batch.column(text).to_pylist(), gone_of, strict=True):
        words = (value or "").encode().split()
        n_words.append(len(words))
        if its:
            gone = np.zeros(len(words), bool)
            for r in its:
                gone[r["start"] : r["stop"]] = True
            words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words).decode())
    return n_words, n_removed, kept


def _touched(rows: DataFrame, length: int, doc: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may lose words, with the stretches in a last column, and rows that surely lose none."""
    removed = saved(repeated(rows.select(F.col(doc).alias("doc"), "text").where("doc is not null"), length))
    name = fresh(rows.columns, "runs")
    key = fresh([*rows.columns, name], "of")
    listed = removed.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("start", "stop")).alias(name))
    changed, same = split(rows, doc, membership(removed.select("doc").distinct(), "doc", removed.count()))
    return changed.join(listed, F.col(doc) == F.col(key), "left").drop(key), same


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, one space between) for every row of ``docs``."""
    changed, same = _touched(docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text"), length, "doc")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            n_words, n_removed, kept = _cut(b, 1, 2 if b.num_columns > 2 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return changed.transform(X.streamed(keep, schema)).unionByName(same.transform(X.streamed(keep, schema)))


def clean(docs: DataFrame, key: str, length: int = 50) -> DataFrame:
    """``docs``, all columns, without the repeated passages; a text that loses none stays as it is.

    ``key`` is a bigint column that orders the documents; rows without one keep
    everything.  Only rows that may lose words are dealt.
    """
    changed, same = _touched(docs, length, key)
    at = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            _, n_removed, kept = _cut(b, at, b.num_columns - 1)
            gone = pa.array(np.array(n_removed, np.int64) > 0)
            columns = [*b.columns[:at], pc.if_else(gone, pa.array(kept, b.column(at).type), b.column(at)), *b.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return changed.transform(X.streamed(rewrite, docs.schema)).unionByName(same)
