"""Packing token streams into sequences by order-preserving dynamic programming.

Documents become token ids and stay in their order.  Places where a sequence
may end are document ends, sentence ends and, inside long sentences, a grid;
each has a truncation penalty (none, some, more).  The cost of a window of n
tokens is ``size - n`` padding plus the penalty of its end, so

    best(j) = penalty(j) + size - j + min over j - i <= size of (best(i) + i)

and the minimum over the sliding range is kept in a monotone queue: one pass,
whatever the number of windows.  A task packs its documents in runs of bounded
length and carries the last, open window into the next run.  What is left at a
task's end is cut at powers of two, which need no padding.

Cases: null text is an empty document (its end token only); an empty text, a
text longer than many sequences and repeated rows are packed like any other;
a document without id has pieces without one; an empty table gives no pieces;
other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Tokens packed in one run of the dynamic programme.
RUN_TOKENS = 1 << 19
#: Distinct units whose ids a worker remembers.
REMEMBER = 300_000
#: Penalties, in tokens of padding, for a window that ends inside a document and inside a sentence.
INSIDE_DOCUMENT, INSIDE_SENTENCE, GRID = 4, 24, 64

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
WITH_IDS = SCHEMA + ", ids array<int>"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_TRAILING = np.zeros(256, bool)
_TRAILING[list(b".,!?;:$%&#*|")] = True
#: Units of lower-case letters alone, a to z and those of Latin-1.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class Units:
    """Token ids of units of text: what the tokenizer gives for a text, found unit by unit.

    White space never reaches a token in this vocabulary, and a run of symbols
    after a letter is a group of its own, so a text's ids are those of its
    words, cut before such a run, in turn.  Units that repeat are looked up by
    hash; new ones of letters alone are tokenized many at a time, as each ends
    in one token that closes a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # strings that the tokenizer takes out of a text as it stands, before it lower-cases
        self.marks = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.closes[i] = piece.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[int], units: list[str]) -> None:
        plain = [k for k, u in enumerate(units) if _PLAIN(u)]
        other = [k for k, u in enumerate(units) if not _PLAIN(u)]
        order, ids, sizes = [], [], []
        for lo in range(0, len(plain), 512):
            part = plain[lo : lo + 512]
            got = self._encode([" ".join([units[k] for k in part])])[0]
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) == len(part):
                order.extend(part)
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
            else:
                other.extend(part)
        if other:
            got = self._encode([units[k] for k in other])
            order.extend(other)
            ids.extend(got)
            sizes.append(np.array([len(x) for x in got], np.int64))
        size = np.concatenate(sizes)
        self.known.update(zip([keys[k] for k in order], range(len(self.size), len(self.size) + len(order)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *ids])

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, number of ids) of each unit; the bytes have A-Z in lower case."""
        hashed, first, inverse = np.unique(X.range_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self._clear()
        keys, known = hashed.tolist(), self.known
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            raw = data.tobytes()
            at = first[new]
            self._learn([keys[i] for i in new], [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        which = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[inverse]
        return self.begin[which], self.size[which]


_loaded: dict[str, Units] = {}


def units(path: str) -> Units:
    """The tokenizer's units, kept for the life of a worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Units(path)
    return _loaded[path]


def _marked(marks: list[bytes], lowered: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts that hold, in any case, a string with a token of its own: units would not do for those."""
    raw, found = lowered.tobytes(), set()
    for m in marks:
        at = raw.find(m)
        while at >= 0:
            k = int(np.searchsorted(bounds, at, "right")) - 1
            if at + len(m) <= bounds[k + 1]:
                found.add(k)
            at = raw.find(m, at + 1)
    return np.array(sorted(found), np.int64)


def encode(find: Units, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document bounds, sentence ends) of a slice of texts, each with its end token.

    A text with a string that has a token of its own, in any case, goes through
    the tokenizer whole, as it stands; it has no sentence ends.
    """
    w = X.words(data, bounds, X.SPACED, lower=True)
    ids, ends, stops = _by_units(find, w, bounds, end_id)
    marked = _marked(find.marks, w.data, bounds)
    if not len(marked):
        return ids, ends, stops
    parts, kept = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.ones(len(stops), bool)
    raw = data.tobytes()
    for k in marked.tolist():
        own = find._encode([raw[bounds[k] : bounds[k + 1]].decode()])[0]
        parts[k] = np.append(own, np.int32(end_id))
        kept[np.searchsorted(stops, ends[k], "right") : np.searchsorted(stops, ends[k + 1], "right")] = False
    now = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    owner = np.searchsorted(ends, stops[kept], "left") - 1
    return np.concatenate(parts), now, stops[kept] - ends[owner] + now[owner]


def _by_units(find: Units, w: X.Words, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    core = w.end.copy()
    moving = np.arange(len(core))
    while len(moving):  # back over symbols at the end of words
        moving = moving[(core[moving] > w.start[moving]) & _TRAILING[w.data[core[moving] - 1]]]
        core[moving] -= 1
    cut = (core < w.end) & (core > w.start)
    cut[cut] = _LETTER[w.data[core[cut] - 1]]
    at = np.repeat(np.arange(len(cut)), 1 + cut)
    tail = np.zeros(len(at), bool)
    tail[1:] = at[1:] == at[:-1]
    begin, n = find.find(w.data, np.where(tail, core[at], w.start[at]), np.where(tail | ~cut[at], w.end[at], core[at]))
    owner = w.owner[at]
    total = np.bincount(owner, weights=n, minlength=len(bounds) - 1).astype(np.int64) + 1
    ends = np.cumsum(total)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
    past = np.cumsum(n)
    within = np.arange(int(past[-1]) if len(past) else 0) - np.repeat(past - n, n)
    out[np.repeat(past - n + owner, n) + within] = find.ids[np.repeat(begin, n) + within]
    closing = np.isin(w.data[w.end - 1], np.frombuffer(b".!?", np.uint8)) if len(w.end) else np.zeros(0, bool)
    last = np.ones(len(at), bool)
    last[:-1] = at[1:] != at[:-1]
    stops = (past + owner)[last][closing]
    return out, np.concatenate([[0], ends]), stops


def cuts(places: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Window ends with the least padding and penalties; ``places`` rise, at most ``size`` apart."""
    at, cost = places.tolist(), penalty.tolist()
    value, back = [0] * (len(at) + 1), [0] * (len(at) + 1)
    place = [0, *at]
    queue: deque[int] = deque([0])
    key = [0] * (len(at) + 1)  # best(i) + i
    for j in range(1, len(place)):
        x = place[j]
        while place[queue[0]] < x - size:
            queue.popleft()
        i = queue[0]
        value[j] = cost[j - 1] + size - x + key[i]
        back[j] = i
        key[j] = k = value[j] + x
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(place) - 1
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs the documents of one task, in their order."""

    def __init__(self, size: int, task: int, with_ids: bool):
        self.size, self.with_ids = size, with_ids
        self.next = task << 33
        self.docs: list[tuple[int, int, int]] = []  # id, tokens before the first held one, tokens in all
        self.ids: list[np.ndarray] = []
        self.stops: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append((doc, 0, len(ids)))
        self.stops.append(stops + self.held)
        self.ids.append(ids)
        self.held += len(ids)

    def run(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Packs what is held; unless ``last``, the final window stays open."""
        if not self.held:
            return
        ids, size = np.concatenate(self.ids), self.size
        ends = np.cumsum([n - start for _, start, n in self.docs])
        stops = np.concatenate(self.stops)
        kind = np.full(self.held + 1, 3, np.int8)
        grid = min(GRID, size)
        kind[grid::grid] = 2
        kind[stops] = 1
        kind[ends] = 0
        places = np.flatnonzero(kind[1:] < 3) + 1
        windows = cuts(places, np.array([0, INSIDE_DOCUMENT, INSIDE_SENTENCE])[kind[places]], size)
        begin = windows[-2] if len(windows) > 1 else 0
        if last:
            rest, at = self.held - begin, begin
            windows.pop()
            while rest and rest != size:
                step = 1 << (rest.bit_length() - 1)
                at += step
                rest -= step
                windows.append(at)
            if rest:
                windows.append(self.held)
            stop = self.held
        else:
            windows.pop()
            stop = begin
        starts = ends - np.array([n - start for _, start, n in self.docs])
        marks = np.unique(np.concatenate([np.array([0, *windows], np.int64), ends[ends < stop], starts[starts < stop]])) if stop else np.zeros(1, np.int64)
        a, b = marks[:-1], marks[1:]
        d = np.searchsorted(ends, a, "right")
        s = np.searchsorted(np.array(windows, np.int64), a, "right")
        edge = np.array([0, *windows], np.int64)[s]
        before = np.array([x[1] for x in self.docs], np.int64)[d] + a - starts[d]
        raw = ids.astype("<u4")
        columns = [
            pa.array([self.docs[i][0] for i in d.tolist()], pa.int64()), pa.array(before, pa.int64()), pa.array(b - a, pa.int64()),
            pa.array([zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
            pa.array([self.docs[i][2] for i in d.tolist()], pa.int64()), pa.array(self.next + s, pa.int64()), pa.array(a - edge, pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(ids[: marks[-1]], pa.int32())))
            names.append("ids")
        if len(a):
            yield pa.RecordBatch.from_arrays(columns, names=names)
        self.next += len(windows)
        k = int(np.searchsorted(ends, stop, "right"))
        kept = self.docs[k:]
        if kept and starts[k] < stop:
            doc, start, n = kept[0]
            kept[0] = (doc, start + int(stop - starts[k]), n)
        self.docs, self.ids, self.stops = kept, [ids[stop:]], [stops[stops > stop] - stop]
        self.held -= int(stop)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``size`` tokens.

    Every id of every document lies in one piece; ``offset`` runs without gaps
    from 0 in each sequence.  ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = units(tokenizer_path)
        packer = Packer(size, TaskContext.get().partitionId(), with_ids)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, bounds in X.slices(batch.column(1)):
                ids, ends, stops = encode(find, data, bounds, end_id)
                cut = np.searchsorted(stops, ends)
                for k in range(hi - lo):
                    packer.add(names[lo + k], ids[ends[k] : ends[k + 1]], stops[cut[k] : cut[k + 1]] - ends[k])
                if packer.held >= RUN_TOKENS:
                    yield from packer.run(last=False)
        yield from packer.run(last=True)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(X.streamed(run, WITH_IDS if with_ids else SCHEMA))
