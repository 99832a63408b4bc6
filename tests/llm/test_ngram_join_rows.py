"""The n-gram join of rows without id, whose texts lead from one document to another."""

from framelake.llm import ngram_join


def test_rows_without_id_link(spark):
    words = [f"w{i}" for i in range(150)]
    text = lambda lo, hi: " ".join(words[lo:hi])
    # windows of 100 words link when moved by 10, not by 20: 5 - null - 9 is a chain, so is null - null
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(5, text(0, 100)), (9, text(20, 120)), (None, text(10, 110)), (None, text(10, 110)), (None, text(10, 110).upper()), (None, other), (None, other + " more"), (7, "alone in the world of words"), (None, "by itself and nothing else"), (None, None), (3, text(0, 100))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"] or -1) for r in ngram_join.join(docs).collect())
    size = lambda t: max(1, len(t.split()) - 4) if t else 0
    want = [3, 3, 3, 3, 3, -1, -1, 7, -1, -1, 3]
    assert got == sorted((str(i), size(t), c) for (i, t), c in zip(rows, want, strict=True))


def test_large_groups_are_settled_by_their_centre(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "BLOCK", 400)
    monkeypatch.setattr(ngram_join, "LARGEST", 3000)
    monkeypatch.setattr(ngram_join, "FEW", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):  # copies near the base, copies of a copy that drifted away, and texts that only share its start
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(60)] = f"e{i}"
        if i % 3 == 1:
            w = w[:40] + [f"d{k}" for k in range(12 + i % 4)] + w[44 : 50 + i % 7]
        if i % 3 == 2:
            w = w[:12] + [f"own{i}.{k}" for k in range(rng.randrange(5, 30))]
        rows.append((i if i % 10 else None, " ".join(w)))
    rows += [(200, rows[0][1]), (201, rows[1][1] + " tail"), (202, None)]
    sets = [{tuple(w[s : s + 5]) for s in range(len(w) - 4)} for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    lowest = [min((i for (i, _), r in zip(rows, root, strict=True) if r == root[k] and i is not None), default=-1) if sets[k] else (rows[k][0] or -1) for k in range(len(rows))]
    want = sorted((str(i), len(s), c) for (i, _), s, c in zip(rows, sets, lowest, strict=True))
    got = sorted((str(r["doc_id"]), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())
    assert got == want
    assert len(set(root)) > 30
