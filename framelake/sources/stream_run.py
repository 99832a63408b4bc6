"""Runs a streaming form to its end over rows written as files, and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import folder


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run_to_table(spark: SparkSession, rows: DataFrame, form: Callable[[DataFrame], DataFrame], batch_rows: int | None = None) -> DataFrame:
    """Writes ``rows`` to the shared folder, streams them through ``form`` and reads the files it appended.

    ``batch_rows``: rows that go to and from Python together, for long rows; the session's own setting comes back.
    """
    at = folder(spark, "stream")
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    before = spark.conf.get(_ROWS)
    if batch_rows:
        spark.conf.set(_ROWS, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:  # a query keeps the settings it was started with
        q = form(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_ROWS, before)
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")
