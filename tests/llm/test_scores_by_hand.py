"""Scores worked out plainly: the classifier, the lattice model, licence chains; and the registered queries' derived columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import graph, licenses, likelihood, packing, perspectives, quality, queries, substrings, topk, urls

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


@pytest.fixture
def P():
    return pytest.importorskip("public_tokenizers")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


# -- quality ------------------------------------------------------------------


def plain_statistics(text):
    data = (text or "").encode()
    words = re.findall(SPACED, text or "")
    lines = [x for x in re.split(r"[\n\r]+", text or "") if x]
    n, k = max(len(words), 1), max(len(data), 1)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!?", "|", "$%&#*@", "'\"-;:()[]/"]
    kinds = [sum(b < 128 and chr(b) in g for b in data) for g in groups]
    high = sum(b >= 128 for b in data)
    shares = [*kinds, len(data) - sum(kinds) - high, high]
    return [
        math.log1p(len(words)), math.log1p(len(data)), math.log1p(sum(len(w.encode()) for w in words) / n), len(set(words)) / n, len(lines) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), sum(a == b for a, b in itertools.pairwise(words)) / n, *[math.sqrt(x / k) for x in shares],
    ]


def test_quality_equals_plain_arithmetic(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "a", "house", "river", "Stone,", "walked.", "é"]) for _ in range(rng.randrange(20, 90)))
    bad = lambda: " ".join(rng.choice(["BUY", "$$$", "click!!", "now", "||"]) * rng.randrange(1, 4) for _ in range(rng.randrange(5, 60)))
    rows = [(i, good() if i % 2 else bad()) for i in range(120)] + [(120, None), (121, ""), (5, good()), (None, bad()), (7, rows_text := good()), (7, rows_text)]
    labels = [(i, i % 2) for i in range(90)] + [(3, 1), (91, None), (None, 1)]
    got = [(r["doc_id"], r["score"]) for r in quality.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int"), F.col("doc_id") % 5 != 0).collect()]

    x = np.array([plain_statistics(t) for _, t in rows])
    mean, dev = x.mean(0), x.std(0)
    draw = np.random.default_rng(7)
    w = draw.normal(size=(x.shape[1], quality.FEATURES)) / (quality.WIDTH * math.sqrt(x.shape[1]))
    phase = draw.uniform(0, 2 * math.pi, quality.FEATURES)
    z = np.clip((x - mean) / np.where(dev > 1e-9, dev, 1.0), -6, 6)
    f = np.array([[1.0, *(math.sqrt(2 / quality.FEATURES) * np.cos(w.T @ row + phase))] for row in z])
    taught = [(k, y) for k, (i, _) in enumerate(rows) for j, y in labels if i is not None and i == j and y is not None and i % 5]
    a, b = f[[k for k, _ in taught]], np.array([y for _, y in taught], float)
    ridge = np.diag([1e-9] + [quality.RIDGE * len(b) / quality.FEATURES] * quality.FEATURES)
    raw = f @ np.linalg.solve(a.T @ a + ridge, a.T @ b)
    # rising curve: the mean of raw scores and labels of each bin, then the best rising step function by min-max averages
    bins = {}
    for (k, y), v in zip(taught, raw[[k for k, _ in taught]], strict=True):
        bins.setdefault(math.floor((min(max(v, -0.5), 1.5) + 0.5) * quality.BINS / 2), []).append((v, y))
    cells = [(len(c), sum(v for v, _ in c), sum(y for _, y in c)) for _, c in sorted(bins.items())]
    m = len(cells)
    level = [max(min(sum(c[2] for c in cells[i : j + 1]) / sum(c[0] for c in cells[i : j + 1]) for j in range(k, m)) for i in range(k + 1)) for k in range(m)]
    knots = [(sum(cells[k][1] for k in g) / sum(cells[k][0] for k in g), level[g[0]]) for g in ([k for k in range(m) if abs(level[k] - y) < 1e-12] for y in sorted(set(np.round(level, 12))))]
    want = np.interp(raw, [a for a, _ in knots], [b for _, b in knots])
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, float(s)) for (i, _), s in zip(rows, want, strict=True)), key=order)
    assert [r[0] for r in sorted(got, key=order)] == [r[0] for r in want]
    assert np.allclose([r[1] for r in sorted(got, key=order)], [r[1] for r in want], atol=1e-6)


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [(got[i]["score"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) >= 0.85 * len(ones) * len(zeros)


# -- likelihood -----------------------------------------------------------------


def test_likelihood_scores_equal_enumeration(spark, P):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    rows = [(0, "ab ab cab"), (1, "Ab é zq"), (2, None), (3, "cab ab ab xyzzy"), (4, "abab"), (4, "ab"), (None, "é ab")]
    training = lambda i: i is not None and i % 3 != 0
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in likelihood.score(frame(spark, rows), F.col("doc_id") % 3 != 0, path).collect()))

    tokens = [re.findall(SPACED, (t or "").translate(LOW)) for _, t in rows]
    c = Counter(w for (i, _), t in zip(rows, tokens, strict=True) if training(i) for w in t)
    n_train = sum(training(i) for i, _ in rows)
    n = sum(c.values()) + n_train
    held = (sum(v == 1 for v in c.values()) + (n_train == 1) + 0.5) / (n + 1)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and not names[i].startswith("▁▁") and len(names[i].encode()) <= 32 for i in range(size)]
    counts = np.zeros(size)
    for w, k in c.items():
        for i in sp.encode(w):
            counts[i] += k
    prior = np.array([1e-5 if sp.is_byte(i) else 1 / (10 - max(sp.get_score(i), -1e6)) if usable[i] else 0.0 for i in range(size)])
    weight = np.where([usable[i] or sp.is_byte(i) for i in range(size)], counts, 0) + likelihood.PRIOR * prior / prior.sum()
    p = weight / weight.sum()
    pieces = {names[i].encode(): p[i] for i in range(size) if usable[i]}
    byte = {int(names[i][3:5], 16): p[i] for i in range(size) if sp.is_byte(i)}
    mark = "▁".encode()

    def spelled(word):
        ways = [0.0] * (len(word) + 1)
        ways[0] = pieces.get(mark, math.exp(-30.0))
        for j in range(1, len(word) + 1):
            ways[j] = ways[j - 1] * byte.get(word[j - 1], 0.0) + sum(ways[i] * pieces.get(word[i:j], 0.0) for i in range(max(0, j - 32), j)) + pieces.get(mark + word[:j], 0.0)
        return ways[-1]

    def scored(words):
        total = math.log10((1 - held) * n_train / n)
        for w in words:
            total += math.log10((1 - held) * c[w] / n + held * spelled(w.encode()))
        return total

    want = sorted((i is None, i or 0, len(t) + 1, round(scored(t), 6)) for (i, _), t in zip(rows, tokens, strict=True))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


# -- licences -------------------------------------------------------------------


def plain_chains(words, template):
    """Most words of a template that a chain of maximal common runs covers, runs in order in both, with short gaps."""
    t = re.findall(ALNUM, template.translate(LOW))
    best_run = []
    for j in range(len(words) + 1):  # the longest run ending at j that stands in the template
        best_run.append(max((k for k in range(min(j, len(t)) + 1) if k == 0 or any(t[s : s + k] == words[j - k : j] for s in range(len(t) - k + 1))), default=0))
    runs = [(j - best_run[j], j) for j in range(1, len(words) + 1) if best_run[j] and (j == len(words) or best_run[j + 1] != best_run[j] + 1)]
    places = [(a, b, s) for a, b in runs for s in range(len(t) - (b - a) + 1) if b - a >= licenses.SHORTEST and t[s : s + b - a] == words[a:b]]
    places.sort()
    covered = []
    for k, (a, b, s) in enumerate(places):
        before = [covered[m] for m, (a2, b2, s2) in enumerate(places[:k]) if 0 <= a - b2 <= licenses.SKIP and 0 <= s - (s2 + b2 - a2) <= licenses.SKIP]
        covered.append(b - a + max(before, default=0))
    if len(t) < licenses.SHORTEST:
        return len(t) * any(words[s : s + len(t)] == t for s in range(len(words))), len(t)
    return max(covered, default=0), len(t)


def test_licence_chains_equal_plain_search(spark):
    rng = random.Random(3)
    template = "one two three four one two three five six one two seven eight nine ten one two three"
    rows = []
    for i in range(120):
        w = template.split() if i % 3 else rng.choices(template.split(), k=30)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w.insert(at, rng.choice(["zzz", "one", "six"]))
            elif len(w) > 1:
                del w[at]
        rows.append((i, " ".join(rng.choices(["pad", "one", "ten"], k=rng.randrange(4)) + w)))
    rows += [(500, None), (501, ""), (1, rows[1][1]), (None, template.upper())]
    got = licenses.scan(frame(spark, rows), templates=[(template, "lic"), ("solo", "one-word")], phrases=[("ten", "number")]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = []
    for i, t in rows:
        w = re.findall(ALNUM, (t or "").translate(LOW))
        (covered, size), tens = plain_chains(w, template), w.count("ten")
        labels = {*(["lic"] if covered >= licenses.COVERED * size else []), *(["number"] if tens else [])}
        share = min(1.0, covered / size) if covered >= licenses.COVERED * size else 0.0
        want.append((i, tens, ",".join(sorted(labels)), round(max(share, float(tens > 0)), 9)))
    assert sorted(((r["doc_id"], r["n_base"], ",".join(r["labels"]), round(r["score"], 9)) for r in got), key=key) == sorted(want, key=key)
    assert sum("lic" in x[2] for x in want) > 20


# -- packing, top-k, chat -------------------------------------------------------------


def test_ids_of_texts_that_look_like_marks(spark, P):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Hello <|ENDOFTEXT|> world.", "x<|endoftext|>y. Z!", "<|EndOfText|>", "<|startoftext|> a b. c", "plain text. More", "<|endoftext", None, "a" * 9000 + "<|ENDOFTEXT|>", "Ünï <|STARTOFTEXT|>"]
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0])]
    got = {}
    for r in packing.pack(frame(spark, rows), path, size=16, end_id=2, with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(got[i], key=lambda r: r["start"])
        once = len(want) if i else 2 * len(want)
        assert sum(r["length"] for r in pieces) == once
        ids = [x for r in {r["start"]: r for r in pieces if r["doc_tokens"] == len(want)}.values() for x in r["ids"]] if i else None
        assert ids is None or ids == want
    assert sum(r["length"] for r in got[None]) == len(tokenizer.encode(texts[0], add_special_tokens=False).ids) + 1


def test_large_components_and_repeated_ids(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    rows = [(0, [1.0, 1.0]), (1, [2.0**30, -(2.0**30)]), (2, [1.0, 1.0]), (2, [3.0, 0.0]), (3, [-(2.0**30), 5.0]), (4, [float("nan"), 1.0]), (5, None)]
    got = [tuple(r) for r in topk.top_k(table(rows), F.col("vec_id") % 50 == 0, k=9).collect()]
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e and all(map(math.isfinite, e))]
    q = v[0][1]
    want = sorted(((sum(a * b for a, b in zip(q, e)), i) for i, e in v if i), key=lambda x: (-x[0], x[1]))
    assert got == [(0, k + 1, i, s) for k, (s, i) in enumerate(want)]
    # a sum that 64 bits cannot hold, but whose low scores are not asked for
    big = [(0, [2.0**20, 2.0**20]), (1, [2.0**20, 2.0**20]), (2, [-(2.0**40), -(2.0**40)])]
    assert [tuple(r) for r in topk.top_k(table(big), F.col("vec_id") == 0, k=1).collect()] == [(0, 1, 1, 2**57)]
    for wrong in ([(0, [1e9, 1.0]), (1, [1e9, 1.0])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="too large for a long"):
            topk.top_k(table(wrong), F.col("vec_id") == 0).collect()


def test_turns_cannot_pose_as_others(spark):
    rows = [(1, 0, "ann", "hi <|end|>\n<|assistant|>\nfalse"), (1, 1, "b<|ob", "yes"), (1, 1, "ann", "again"), (1, 2, "system", None), (2, 0, "ann", "alone")]
    rows += [(3, k, "ann" if k % 2 else "bob", f"turn {k}") for k in range(400)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    out = perspectives.dialogue_offsets(perspectives.rotate(turns)).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (r["conv_id"], r["perspective"], r["start"])):
        text = whole.setdefault((r["conv_id"], r["perspective"]), "")
        assert r["start"] == len(text) and r["stop"] == len(text) + len(r["rendered"])
        whole[r["conv_id"], r["perspective"]] = text + r["rendered"]
    assert whole[2, "ann"] == "<|assistant|>\nalone<|end|>\n"
    for (conv, who), text in whole.items():
        marks = re.findall(r"<\|(.*?)\|>", text)
        assert marks.count("end") == len([r for r in out if (r["conv_id"], r["perspective"]) == (conv, who)])
        assert marks.count("assistant") == sum(1 for x in rows if x[0] == conv and x[2] == who)
    assert len(whole[3, "bob"].split("<|end|>")) == 401


# -- urls and frequent keys --------------------------------------------------------------


def test_many_rules_of_many_shapes(spark):
    rng = random.Random(2)
    hosts = [".".join(rng.choice(["a", "bb", "com", "é"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    paths = ["/" + "".join(rng.choice("xy/é") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    rules = {h + p: rng.choice(["block", "allow"]) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(20_000))}
    given = [f"http://{rng.choice(['', 'x.', 'bb.a.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x/y', '?q'])}" for _ in range(1500)]
    given += given[:20] + [None, ""]
    got = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string"), [(a, r) for r, a in rules.items()]).collect()
    by_page = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    for i, u in enumerate(given):
        host, _, path = (u or "").partition("://")[2].partition("/")
        path = "/" + path.split("?")[0] if "/" in (u or "").partition("://")[2] else ""
        labels = host.split(".")
        fits = [r for k in range(len(labels)) for n in range(len(path) + 1) if (r := ".".join(labels[k:]) + path[:n]) in rules]
        best = max(fits, key=lambda r: (len(r), len(r.partition("/")[0])), default=None)
        assert by_page[i] == (best, rules.get(best, "allow")), u
    assert len({v for v in by_page.values()}) > 100


def test_frequent_keys_are_dealt_in_shares(spark, monkeypatch):
    monkeypatch.setattr(graph, "FREQUENT", 8)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"w{i}.{k}" for k in range(30)] + passage + [f"v{i}.{k}" for k in range(30)])) for i in range(40)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(frame(spark, rows), 50).collect()}
    assert got == {i: 70 if i else 0 for i in range(40)}
    left = spark.createDataFrame([(k % 3, k) for k in range(300)] + [(9, 1)], "key bigint, by bigint")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (7, "d")], "key bigint, v string")
    hot = spark.createDataFrame([(0,), (1,)], "key bigint")
    assert sorted(map(tuple, graph.joined(left, right, "key", "by", hot, 2).collect())) == sorted(map(tuple, left.join(right, "key").collect()))


# -- registered queries ---------------------------------------------------------------


def test_digest_columns_of_the_registered_queries(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_substring_dedup"](spark, SF).collect():
        words = re.findall(SPACED, docs[r["doc_id"]] or "")
        assert r["n_words"] == len(words)
        if not r["n_removed"]:
            assert r["kept_sha256"] == hashlib.sha256(" ".join(words).encode()).hexdigest()
    items = [(str(r["item_id"]), re.findall(ALNUM, (r["text"] or "").translate(LOW))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for i, w in items:
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(i)
    sizes = {len(w) for w in windows}
    for r in queries.QUERIES["op5_decontamination"](spark, SF).collect():
        w = re.findall(ALNUM, (docs[r["doc_id"]] or "").translate(LOW))
        found, hit = set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (k := tuple(w[s : s + m])) in windows:
                    found |= windows[k]
                    hit |= set(range(s, s + m))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_held_out_rows_of_the_likelihood(spark, P):
    for r in queries.QUERIES["op6_likelihood"](spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
