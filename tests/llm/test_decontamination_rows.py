"""Decontamination of rows that share an id or have none, in one pass and in several."""

import pytest

from framelake.llm import decontaminate

WORDS = [f"w{i}" for i in range(60)]
DOCS = [(1, " ".join(WORDS[:20])), (1, " ".join(WORDS[30:45])), (1, "clean"), (2, " ".join(WORDS)), (2, " ".join(WORDS)), (None, " ".join(WORDS[5:18])), (None, " ".join(WORDS[40:])), (None, None), (3, None)]


def found(spark, items, block_chars):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["starts"]), list(r["ends"]), list(r["items"])) for r in decontaminate.decontaminate(docs, bench, block_chars=block_chars).collect())


def expected(items):
    out = []
    for i, t in DOCS:
        w = (t or "").split()
        hit, names = set(), set()
        for item, text in items:
            p = text.split()
            for s in range(len(p) - 9):
                for at in range(len(w) - 9):
                    if w[at : at + 10] == p[s : s + 10]:
                        hit.update(range(at, at + 10))
                        names |= {str(item)} if item is not None else set()
        starts, ends = [x for x in sorted(hit) if x - 1 not in hit], [x + 1 for x in sorted(hit) if x + 1 not in hit]
        out.append((str(i), len(w), len(hit), starts, ends, sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("block_chars", [4_000_000, 30])
def test_rows_keep_their_own_hits(spark, block_chars):
    items = [(k, " ".join(WORDS[5 * k : 5 * k + 12])) for k in range(9)]
    assert found(spark, items, block_chars) == expected(items)


@pytest.mark.parametrize("block_chars", [4_000_000, 30])
def test_items_without_id_hit_words(spark, block_chars):
    items = [(None, " ".join(WORDS[2:16])), (None, " ".join(WORDS[32:44])), (4, " ".join(WORDS[10:24])), (4, " ".join(WORDS[45:58])), (None, None)]
    want = expected([x for x in items if x[1]])
    assert any(r[2] and not r[5] for r in want)
    assert found(spark, items, block_chars) == want


@pytest.mark.parametrize("block_chars", [10**6, 40])
def test_clean_rows_keep_all_columns(spark, block_chars):
    items = [(1, " ".join(WORDS[3:14])), (2, " ".join(WORDS[41:52])), (None, " ".join(WORDS[30:41])), (4, "one two"), (5, None)]
    rows = [*DOCS, (9, "say one two three"), (9, "")]
    docs = spark.createDataFrame([(f"{i}", t, k, "own") for k, (i, t) in enumerate(rows)], "source string, text string, doc_id bigint, n_hit string")
    got = decontaminate.clean(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_chars=block_chars)
    assert got.columns == docs.columns
    windows = {tuple(w[s : s + min(10, len(w))]) for w in ((t or "").split() for _, t in items) for s in range(max(1, len(w) - 9)) if w}
    spoilt = lambda t: any(tuple(w[s : s + n]) in windows for w in [(t or "").split()] for n in {len(x) for x in windows} for s in range(len(w) - n + 1))
    assert sorted(r["doc_id"] for r in got.collect()) == [k for k, (_, t) in enumerate(rows) if not spoilt(t)]


def test_a_large_benchmark_is_small_on_the_driver():
    import pickle
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(200)) for _ in range(400)]  # half a million characters
    table = pa.table({"item": [str(i) for i in range(400)], "text": texts})
    tracemalloc.start()
    made = decontaminate.searches(table, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, texts))
    # at four million characters: 400 MB while it is built, 115 MB sent
    assert peak < 130 * size and len(pickle.dumps(made)) < 40 * size
