"""The pipeline against brute force, with rows that share an id or have none."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import quality, queries

pytest.importorskip("public_tokenizers")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folder of tables, documents as rows, benchmark texts."""
    rng = random.Random(5)
    words = lambda k: [rng.choice([f"word{i}" for i in range(400)] + ["the", "of"]) for _ in range(k)]
    passage, leak, near = words(60), words(14), words(120)
    rows = [(i, " ".join(words(rng.randrange(60, 130)))) for i in range(60)]
    rows += [(i, " ".join(x.upper() + "$$!" for x in words(40))) for i in range(60, 80)]
    edited = [*near[:60], "edit", *near[61:]]
    rows += [(None, rows[3][1]), (None, "alone " + rows[5][1][:200]), (None, "alone " + rows[5][1][:200]), (7, rows[7][1]), (7, " ".join(near)), (8, " ".join(edited)), (9, " ".join(words(70)))]
    rows += [(10, " ".join(words(30) + passage)), (11, " ".join(passage + words(70))), (11, " ".join(words(80))), (11, " ".join(words(20) + passage)), (None, " ".join(words(9) + passage))]
    rows += [(12, " ".join(leak + words(40))), (None, " ".join(words(40) + leak)), (None, " ".join(words(60))), (61, " ".join(words(90))), (None, rows[62][1]), (13, ""), (13, ""), (None, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", " ".join(leak))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [" ".join(leak)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)


def judged(spark, folder, rows):
    df = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id bigint, text string")
    ids = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "row bigint, doc_id bigint")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(queries.crc_of_id() % 5 != 0).join(ids, "doc_id").select(F.col("row").alias("doc_id"), "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, labels, F.lit(True)).collect()}
    return [r for k, r in enumerate(rows) if got[k] >= corpus_pipeline.LEAST_QUALITY]


def grouped(rows):
    rows = sorted(set(rows), key=key)
    sets = []
    for r in rows:
        w = re.findall(SPACED, (r[1] or "").lower())
        sets.append({tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    # of one id's rows in a group any may be first: only the text tells
    return [r for k, r in enumerate(rows) if root[k] == k]


def cleaned(rows, leaks):
    windows = {tuple(w[s : s + 10]) for w in (re.findall(ALNUM, t.lower()) for t in leaks) for s in range(len(w) - 9)}
    spoilt = lambda t: any(tuple(w[s : s + 10]) in windows for w in [re.findall(ALNUM, (t or "").lower())] for s in range(len(w) - 9))
    return [r for r in rows if not spoilt(r[1])]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_stages_decide_by_row(spark, tables):
    folder, rows, leaks = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = judged(spark, folder, rows)
    assert None in {r[0] for r in first} and len(first) < len(rows)
    assert collected(corpus_pipeline.quality_classifier(spark, docs, folder)) == sorted(first, key=key)
    second = grouped(rows)
    assert len(second) < len(set(rows))
    assert collected(corpus_pipeline.ngram_jaccard_join(spark, docs, folder)) == sorted(second, key=key)
    assert collected(corpus_pipeline.benchmark_decontamination(spark, docs, folder)) == sorted(cleaned(rows, leaks), key=key)

    # substrings: rows of one id go by the hash of their columns
    hashed = docs.withColumn("h", F.xxhash64(*docs.columns)).collect()
    ordered = sorted(hashed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    seen, want = set(), []
    for r in ordered:
        w = re.findall(SPACED, r["text"] or "")
        windows = [tuple(w[s : s + 50]) for s in range(len(w) - 49)]
        gone = {x for s, k in enumerate(windows) if k in seen for x in range(s, s + 50)}
        seen |= set(windows)
        t = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r["text"]
        want.append((r["doc_id"], t, r["lang"], r["source"], len(t) if t is not None else None))
    got = collected(corpus_pipeline.substring_dedup(spark, docs, folder))
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=key)]


def test_pipeline_runs_on_such_rows(spark, tables):
    folder, rows, leaks = tables
    got = corpus_pipeline.run(spark, folder).collect()
    left = cleaned(grouped(judged(spark, folder, rows)), leaks)
    pieces = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(pieces) == len(got)
    starts = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["start"] == 0)
    assert starts == sorted((r[0] is None, r[0] or 0) for r in left)


def test_stages_with_clashing_columns_and_empty_tables(spark, tables):
    folder, rows, _ = tables
    names = ["row", "Runs", "gone", "of", "own", "sig", "_id", "share", "component", "quality", "items", "settled"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumns({n: F.xxhash64("doc_id", "text").cast("string") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, wide, folder), stage(spark, docs, folder)
        assert got.columns == wide.columns
        assert sorted(map(repr, got.select(docs.columns).collect())) == sorted(map(repr, plain.collect()))
        assert got.where(F.col("row") != F.col("Runs")).count() == 0
    none = docs.where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
