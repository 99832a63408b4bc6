"""License scans with a generalised suffix automaton of licence words.

The automaton holds every template.  Files are streamed through it word by
word; at each word it knows the longest run of words, ending there, that stands
in some template (the matching statistics).  Words outside the licence
vocabulary reset it, so only runs of licence words are streamed.  Runs that
cannot be lengthened are matches; long ones are chained, template by template,
in the order of both texts, and a chain that covers enough of its template
gives the template's label.  Short phrases are templates too: every place where
one stands whole is counted.  A template of fewer words than the shortest match
stands whole or not at all.

Cases: null or empty text has no words and no places; overlapping and repeated
phrases all count; a text that is one long template, or very long, is streamed
like any other; repeated rows are judged each on its own; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Notices and grants as their licences word them.
TEMPLATES = [
    ("released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
]

#: Shortest match that takes part in a chain; most words that a chain may skip; share of a template that gives its label.
SHORTEST, SKIP, COVERED = 3, 6, 0.8

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, spans array<struct<label:string,start:bigint,end:bigint,covered:double>>, score double"


class Automaton:
    """Generalised suffix automaton of sequences of small integers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, position) where the state's runs end
        for s, seq in enumerate(sequences):
            last = 0
            for p, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((s, p))
        for state in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        every = [*phrases, *templates]
        self.labels = [x for _, x in every]
        self.n_phrases = len(phrases)
        column = pa.array([t for t, _ in every], pa.string())
        (_, _, data, bounds), = X.slices(column, 1 << 30)
        w = X.words(data, bounds, X.ALNUM, lower=True)
        self.vocabulary, code = np.unique(w.hash, return_inverse=True)
        code = code.tolist()
        self.size = np.diff(w.first).tolist()
        self.automaton = a = Automaton([code[i:j] for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)])
        # whole phrases, and templates too short for a match, that end where a state's runs end: (number, words)
        self.whole: list[list[tuple[int, int]]] = [[] for _ in a.link]
        entire = [k for k, n in enumerate(self.size) if n and (k < self.n_phrases or n < SHORTEST)]
        #: Words of the shortest run that can hold a place or a match.
        self.least = min([SHORTEST, *(self.size[k] for k in entire)])
        for k in entire:
            state = 0
            for c in code[w.first[k] : w.first[k + 1]]:
                state = a.next[state][c]
            for s in range(len(a.link)):
                up = s
                while up > 0 and up != state:
                    up = a.link[up]
                if up == state:
                    self.whole[s].append((k, self.size[k]))

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Streams one run: (phrase, first word) places and (state, first word, end) matches."""
        nxt, link, length, whole = self.automaton.next, self.automaton.link, self.automaton.length, self.whole
        places, matches = [], []
        state = n = 0
        for i, c in enumerate(codes):
            grew = state
            while state and c not in nxt[state]:
                state = link[state]
            if state != grew:
                if n >= SHORTEST:
                    matches.append((grew, i - n, i))
                n = length[state]
            state = nxt[state].get(c, 0)
            n = n + 1 if state else 0
            if whole[state]:
                places.extend((k, i + 1 - size) for k, size in whole[state] if size <= n)
        if n >= SHORTEST:
            matches.append((state, len(codes) - n, len(codes)))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Covered template spans: (label, first word, end, share covered) of the best chain of each place."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for state, a, b in matches:
            for s, p in self.automaton.ends[state]:
                by.setdefault(s, []).append((a, b, p + 1 - (b - a)))
        out = []
        for s, found in by.items():
            found.sort()
            every: list[tuple] = []  # covered, first, end
            ends: dict[tuple[int, int], tuple] = {}  # the best chain of each end in the text and in the template
            for a, b, t in found:
                near = [c for x in range(a - SKIP, a + 1) for y in range(t - SKIP, t + 1) if (c := ends.get((x, y)))]
                best = max(near, key=lambda c: (c[0], -c[1]), default=None)
                chain = ((best[0] if best else 0) + b - a, best[1] if best else a, b)
                every.append(chain)
                at = b, t + b - a
                if at not in ends or chain[0] > ends[at][0]:
                    ends[at] = chain
            for c in every:
                if c[0] >= COVERED * self.size[s]:
                    out.append((self.labels[s], c[1], c[2], c[0] / self.size[s]))
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


def _batch(batch: pa.RecordBatch, scanner: Scanner) -> Iterator[pa.RecordBatch]:
    for lo, hi, data, bounds in X.slices(batch.column(1)):
        w = X.words(data, bounds, X.ALNUM, lower=True)
        k = hi - lo
        places: list[list[tuple[int, int]]] = [[] for _ in range(k)]
        spans: list[list] = [[] for _ in range(k)]
        if len(w.hash):
            code = np.searchsorted(scanner.vocabulary, w.hash)
            code[code == len(scanner.vocabulary)] = 0
            known = scanner.vocabulary[code] == w.hash
            edge = np.zeros(len(known) + 1, bool)
            edge[w.first] = True
            start = np.flatnonzero(known & (~np.concatenate([[False], known[:-1]]) | edge[:-1]))
            end = np.flatnonzero(known & (~np.concatenate([known[1:], [False]]) | edge[1:])) + 1
            long = end - start >= scanner.least
            text = np.searchsorted(w.first, start, "right") - 1
            held: dict[int, list] = {}
            for a, b, t in zip(start[long].tolist(), end[long].tolist(), text[long].tolist(), strict=True):
                at = a - int(w.first[t])
                p, m = scanner.scan(code[a:b].tolist())
                places[t].extend((x, at + i) for x, i in p if x < scanner.n_phrases)
                spans[t].extend((scanner.labels[x], at + i, at + i + scanner.size[x], 1.0) for x, i in p if x >= scanner.n_phrases)
                if m:
                    held.setdefault(t, []).extend((s, at + i, at + j) for s, i, j in m)
            for t, m in held.items():
                spans[t] = sorted({*spans[t], *scanner.chains(m)}, key=lambda x: (x[1], x[2], x[0]))
        base = [sorted({scanner.labels[x] for x, _ in p}) for p in places]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(lo, k), pa.array(np.diff(w.first), pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                pa.array([min((i for _, i in p), default=None) for p in places], pa.int64()), pa.array([max((i for _, i in p), default=None) for p in places], pa.int64()),
                pa.array(base, pa.list_(pa.string())), pa.array([sorted({*b, *(x[0] for x in s)}) for b, s in zip(base, spans, strict=True)], pa.list_(pa.string())),
                pa.array([[{"label": x[0], "start": x[1], "end": x[2], "covered": x[3]} for x in s] for s in spans], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))),
                pa.array([max([float(bool(p)), *(min(1.0, x[3]) for x in s)]) for p, s in zip(places, spans, strict=True)], pa.float64()),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"],
        )


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: phrase places, labels, covered template spans and the largest covered share."""
    given = (templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*given)
        for b in batches:
            yield from _batch(b, scanner)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(X.streamed(run, SCHEMA))
