"""Every operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import decontaminate, graph, licenses, likelihood, ngram_join, packing, perspectives, quality, substrings, topk, urls

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n bigint, ref string, score double, key string"


@pytest.fixture
def P():
    """Files of public tokenizers; only the tests that need them are skipped without."""
    return pytest.importorskip("public_tokenizers")


def corpus(n=160, seed=1):
    """Small documents with copies, near copies, shared passages, nulls, empty and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve,", "X.", "the", "The"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base, out = words(70), words(120), []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            w = list(base)
            for _ in range(i // 8 % 4):
                w[rng.randrange(len(w))] = f"edit{i}"
        elif kind == 1:
            w = words(20) + passage[rng.randrange(3) :] + words(10)
        elif kind == 2 and out:
            out.append((i, rng.choice(out)[1]))
            continue
        else:
            w = words(rng.randrange(0, 150))
        out.append((i, " ".join(w)))
    tail = [None, "", "  \t\n", "one", "a b c", "long" * 20000, "x " * 3000, "  lead\ntrail  ", "a\u00a0b \u3000 c", "nul\x00l byte"]
    return out + [(n + i, t) for i, t in enumerate(tail)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "r", 0.5, "k") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for df in (
        substrings.deduplicate(none), quality.score(none, labels, F.lit(True)), quality.keep(none, labels, F.lit(True), 0.5), decontaminate.decontaminate(none, bench), decontaminate.clean(none, bench), licenses.scan(none),
        ngram_join.join(none), topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.lit(True)),
        urls.judge(spark.createDataFrame([], "url string"), [("block", "net/")]), perspectives.rotate(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")),
    ):
        assert df.count() == 0


def test_empty_tables_of_tokens(spark, P):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    for df in (likelihood.score(none, F.lit(True), P.path("piece_bpe_32k.model")), packing.pack(none, P.path("word_bpe_49k.json"))):
        assert df.count() == 0


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "a.b/x"), ("allow", "a.b/x"), ("block", "bare.org")]
    given = [
        ("http://NET/", "net/", "block"), ("http://x.net", None, "allow"), ("https://q.example.net/en/1?a#b", "example.net/en/", "allow"), ("http://example.net/en", "net/", "block"),
        ("ftp://notnet/", None, "allow"), ("http://x.net:80/", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://c.a.b/xyz", "a.b/x", "block"),
        ("http://bare.org?x", "bare.org", "block"), ("http://a://b/", None, "allow"), ("http://example.net#/en/", None, "allow"), ("http://" + "s." * 500 + "net/" + "p" * 5000, "net/", "block"),
    ]
    df = spark.createDataFrame([(u, i, "mine", "mine") for i, (u, _, _) in enumerate(given)], "url string, page_id int, host string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()}
    assert got == {i: (r, v) for i, (_, r, v) in enumerate(given)}
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_cascade_is_exact_when_filters_are_full(spark):
    universe = spark.range(5000).select(F.xxhash64(F.concat(F.lit("k"), "id")).alias("h"), "id")
    listed = universe.where("id % 10 = 7").select("h")
    levels = urls.cascade(listed, universe.select("h"), 60, 60)  # far too few bits: wrong keys at every level
    assert len(levels) > 2
    rows = universe.collect()
    assert (urls.listed(levels, np.array([r["h"] for r in rows]).view(np.uint64)) == np.array([r["id"] % 10 == 7 for r in rows])).all()


def test_substrings_equal_brute_force(spark, docs):
    for length in (50, 12):
        rows = [(i, t or "") for i, t in corpus()]
        low = {}
        words = {i: re.findall(SPACED, t) for i, t in rows}
        for i in sorted(words):
            for s in range(len(words[i]) - length + 1):
                low.setdefault(tuple(words[i][s : s + length]), i)
        want = []
        for i, w in words.items():
            gone = set()
            for s in range(len(w) - length + 1):
                if low[tuple(w[s : s + length])] < i:
                    gone.update(range(s, s + length))
            want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
        assert sum(x[2] for x in want) > 500
        assert rows_of(substrings.deduplicate(docs, length).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)), "doc_id", "n_words", "n_removed", "sha") == sorted(want)


def test_substrings_shards_and_repeated_rows(spark, monkeypatch):
    long = " ".join(f"t{i}" for i in range(400))
    monkeypatch.setattr(substrings, "SHARD_WORDS", 60)
    assert [len(s) for shard in substrings._shards([long], 50) for s in shard] == [109] * 5 + [100]
    df = frame(spark, [(1, long), (1, long), (2, long), (None, long)])
    assert rows_of(substrings.deduplicate(df).where("doc_id is not null"), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 400)]
    assert substrings.deduplicate(df).where("doc_id is null").first()["n_removed"] == 0


def test_quality_learns_and_is_calibrated(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        w = [rng.choice(["and", "the", "of", "river", "stone", "green"]) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "$$!" for x in w)))
        labels.append((i, int(good) if i % 50 else None))
    rows += [(900, None), (901, ""), (902, "z" * 50000)]
    lab = spark.createDataFrame(labels + labels[:5], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, rows), lab, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(0, 600, 5)]
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in held) / len(held) > 0.97
    one = spark.createDataFrame([(0, 1), (3, 1)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(frame(spark, rows[:9]), one, F.lit(True)).collect()} == {1.0}


def test_isotonic_rises():
    x, y = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert list(y) == [0.0, 0.5, pytest.approx(2 / 3)] and (np.diff(x) > 0).all()


def test_perspectives(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "again"), (2, 0, "system", "only"), (None, 0, "ann", "x"), (3, 0, None, "x"), (4, 0, "ann", "")]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id bigint, turn int, role string, text string, name string")
    got = rows_of(perspectives.rotate(df), "conv_id", "perspective", "turn", "rendered", "learn")
    ann = [(1, "ann", 0, "<|system|>\ns<|end|>\n", False), (1, "ann", 1, "<|assistant|>\nhi<|end|>\n", True), (1, "ann", 2, "<|user name=bob|>\n<|end|>\n", False), (1, "ann", 2, "<|user name=bob|>\nagain<|end|>\n", False)]
    bob = [(1, "bob", 0, "<|system|>\ns<|end|>\n", False), (1, "bob", 1, "<|user name=ann|>\nhi<|end|>\n", False), (1, "bob", 2, "<|assistant|>\n<|end|>\n", True), (1, "bob", 2, "<|assistant|>\nagain<|end|>\n", True)]
    assert got == sorted(ann + bob + [(4, "ann", 0, "<|assistant|>\n<|end|>\n", True)])


@pytest.mark.parametrize("block_chars", [4_000_000, 300])
def test_decontamination_equals_brute_force(spark, docs, block_chars):
    texts = [t for _, t in corpus() if t]
    items = [(0, " ".join(texts[1].split()[25:60])), (1, texts[8]), (2, "W1 w2!!"), (3, "x"), (4, ""), (5, None), (6, texts[8]), (7, "ÉTÉ"), (8, "?!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    window = defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, (t or "").translate(LOW))
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            window[tuple(w[s : s + min(10, len(w))])].add(str(i))
    want = []
    for i, t in corpus():
        w = re.findall(ALNUM, (t or "").translate(LOW))
        hit, found = set(), set()
        for m in {len(k) for k in window}:
            for s in range(len(w) - m + 1):
                if (k := tuple(w[s : s + m])) in window:
                    hit.update(range(s, s + m))
                    found |= window[k]
        want.append((i, len(w), len(hit), sorted(found)))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.decontaminate(docs, bench, block_chars=block_chars).collect())
    assert got == sorted(want) and sum(x[2] for x in want) > 100


def test_likelihood_counts_and_marginals(spark, docs, P):
    train = F.col("doc_id") % 3 != 0
    tokens = {i: re.findall(SPACED, (t or "").translate(LOW)) + [None] for i, t in corpus()}
    c = Counter(w for i, t in tokens.items() if i % 3 for w in t)
    n, v = sum(c.values()), len(c)
    for common in (500_000, 40):
        got = {r["doc_id"]: r for r in likelihood.score(docs, train, P.path("piece_bpe_32k.model"), common=common).collect()}
        assert len(got) == len(tokens)
        for i, t in tokens.items():
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            assert math.isfinite(r["score"]) and r["score"] < 0


def test_likelihood_of_repeated_and_null_ids(spark, P):
    texts = [t for _, t in corpus(48)]
    rows = [*enumerate(texts[:40]), *enumerate(texts[:5]), (3, texts[41]), (3, None), (None, texts[42]), (None, texts[42]), (None, texts[43]), (None, None)]
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[4], 6))
    few, all_common = (sorted((tuple(r) for r in likelihood.score(frame(spark, rows), F.lit(True), P.path("piece_bpe_32k.model"), common=c).select("doc_id", *columns).collect()), key=order) for c in (40, 500_000))
    assert len(few) == len(rows)
    for a, b in zip(few, all_common, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_lattice_equals_enumeration():
    names = [b"\xe2\x96\x81", "▁ab".encode(), b"a", b"b", b"ab", b"ba", "é".encode()]
    logp = np.log(np.array([0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.05]))
    byte = np.full(256, math.log(0.0002))
    table = dict(zip(names, logp))

    def every(rest, first):
        if not rest:
            return 0.0 if first else 1.0
        total = 0.0
        if first:
            total += math.exp(table[names[0]]) * every(rest, False)
            total += sum(math.exp(p) * every(rest[len(k) - 3 :], False) for k, p in table.items() if len(k) > 3 and k[:3] == names[0] and rest.startswith(k[3:]))
            return total
        total += math.exp(byte[rest[0]]) * every(rest[1:], False)
        return total + sum(math.exp(p) * every(rest[len(k) :], False) for k, p in table.items() if not k.startswith(names[0]) and rest.startswith(k))

    words = [b"ab", b"abba", "bé".encode(), b"zzz", b"babab"]
    assert np.allclose(likelihood.marginals(words, likelihood.Pieces(names, logp, byte)), [math.log(every(w, True)) for w in words])


def test_licenses(spark):
    texts = {
        0: "Some. Released under the MIT License.\nmit license", 1: "general public license " * 3, 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under CC BY-NC 4.0.",
        4: None, 5: "", 6: "license mit the of software " * 200, 7: "MIT-License APACHE license apache  license", 8: "word " * 20000 + "apache license", 9: dict(enumerate(t for t, _ in licenses.TEMPLATES))[1],
    }
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, list(texts.items()))).collect()}
    for i, t in texts.items():
        w = re.findall(ALNUM, (t or "").translate(LOW))
        found = [(s, label) for p, label in licenses.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), min((s for s, _ in found), default=None), max((s for s, _ in found), default=None))
        assert list(r["base_labels"]) == sorted({x for _, x in found}) and set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert list(got[2]["labels"]) == ["gpl"] and list(got[3]["labels"]) == ["cc-by-nc"] and list(got[9]["labels"]) == ["mit"] and got[9]["spans"][0]["covered"] == 1.0


def test_ngram_join_equals_brute_force(spark, docs):
    sets = {}
    for i, t in corpus():
        w = re.findall(SPACED, (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted((i, len(s), find(i)) for i, s in sets.items())
    assert len({x[2] for x in want}) < len(want) - 10
    assert rows_of(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == want
    twice = frame(spark, corpus()[:9] * 2)
    assert rows_of(ngram_join.join(twice), "doc_id", "component_id") == sorted((i, min(k for k in range(9) if find(k) == find(i))) for i in range(9) for _ in range(2))


def test_blocks_of_a_group(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([rng.choice(base, 100 - e, replace=False), 1000 + 100 * np.uint64(i) + np.arange(e, dtype=np.uint64)])) for i, e in enumerate(rng.integers(0, 25, 60))]
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "COLUMNS", 32)
    sig = np.arange(60)
    links = ngram_join.block_links(sig, [s.tobytes() for s in sets], np.zeros(60, int), 75)

    def parts(pairs):
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return [min(j for j in range(60) if find(j) == find(i)) for i in range(60)]

    true = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert parts(links) == parts(true) and {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in true}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(-5, -9), (7, 7)]
    got = dict(rows_of(graph.components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "component"))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, -5: -9, -9: -9}


def test_packing_round_trip(spark, docs, P):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = [(500, "it's don't.!! 3.14%$ <|endoftext|> A\u0301 É. ß... a'll,'s '$ .,. x¼. 東京。 q."), (501, "Hello<|startoftext|>world."), (501, "Hello<|startoftext|>world.")]
    df = frame(spark, corpus() + odd)
    got = packing.pack(df, path, size=256, with_ids=True).toPandas()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in corpus() + odd}
    pieces = defaultdict(list)
    for r in got.itertuples():
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    for i, p in pieces.items():
        p.sort()
        repeats = 2 if i == 501 else 1
        assert sum(n for _, n in p) == repeats * len(ids[i]) and (repeats > 1 or all(a + n == b for (a, n), (b, _) in zip(p, p[1:])))
    assert set(pieces) == set(ids)
    used = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = s.offset + s.length
        assert s.offset.iloc[0] == 0 and (ends.values[:-1] == s.offset.values[1:]).all() and ends.max() <= 256
        used += 0 if int(ends.max()).bit_count() == 1 else 256 - ends.max()
    assert used / got.length.sum() < 0.02


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        places = np.cumsum(rng.integers(1, 8, 12))
        cost = rng.integers(0, 5, 12)
        best = {0: 0}
        for j, x in enumerate(places.tolist()):
            best[x] = min((best[i] + 15 - (x - i) for i in best if 0 < x - i <= 15), default=10**9) + int(cost[j])
        at, total = 0, 0
        for x in packing.cuts(places, cost, 15):
            total += 15 - (x - at) + int(cost[places.tolist().index(x)])
            at = x
        assert total == best[int(places[-1])]


@pytest.mark.parametrize("round_size", [65_536, 7])
def test_top_k_equals_brute_force(spark, round_size):
    rng = np.random.default_rng(6)
    vectors = {i: (rng.normal(size=16) * (0.2 if i % 3 else 1)).astype(np.float32).tolist() for i in range(400)}
    vectors |= {i: vectors[1] for i in range(400, 480)}
    vectors |= {480: None, 481: [1.0, None], 482: [float("nan")] * 16, 483: [float("inf")] * 16, 484: [], 485: [1.0, 2.0], 490: [0.5, -0.5]}
    df = spark.createDataFrame([(i, v, 3) for i, v in vectors.items()], "vec_id bigint, embedding array<float>, rank int").repartition(3)
    good = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    assert rows_of(topk.top_k(df, F.col("vec_id") % 10 == 0, round_size=round_size), "query_id", "rank", "vec_id", "score") == sorted(want)
