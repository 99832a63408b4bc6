"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.

Stages decide by row, not by ``doc_id``: rows that share an id or have none are
documents of their own.  Their order is that of ids, rows without id last, and of
their contents where ids do not tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, graph, ngram_join, packing, quality, queries, storage, substrings

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.3


def _rows(docs: DataFrame, once: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a unique number in the order of documents, and that column's name; ``once``: equal rows are one."""
    row = graph.fresh(docs.columns, "row")
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1):
        return docs.withColumn(row, F.col("doc_id").cast("bigint")), row
    docs = docs.distinct() if once else docs
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns))
    # partitions hold rising ranges, so the numbers that Spark gives rise with the order; saved, they stay
    return storage.saved(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())), row


def _by_row(rows: DataFrame, row: str) -> DataFrame:
    return rows.select(F.col(row).alias("doc_id"), "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns from labelled documents that are not held out.

    A label is that of all rows with its id; rows without id have none, and are judged all the same.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.crc_of_id() % 5 != 0, LEAST_QUALITY)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the first, of every group of near duplicates, and one row of rows that are equal in all columns."""
    rows, row = _rows(docs, once=True)
    grouped = ngram_join.join(_by_row(rows, row), n=5, percent=75)
    later = storage.saved(grouped.where("doc_id <> component_id").select(F.col("doc_id").alias(row)))
    return graph.without(rows, row, later).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document has; untouched texts stay as they are."""
    rows, row = _rows(docs)
    out = substrings.clean(rows, row, length=50)
    return out.select(*[F.coalesce(F.length("text").cast(docs.schema[c].dataType), c).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack(docs, queries.tokenizer_path(), size=4096, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: No SQL: the classifier and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, and go once the next one's are there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        after = storage.saved(stage(spark, docs, sf_dir))
        if before is not None:
            storage.dropped(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
