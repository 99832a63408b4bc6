"""Tables that cut lineage: written once to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import folder, shared_dir

__all__ = ["dropped", "folder", "saved", "shared_dir"]


def saved(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    ``narrow``: rows of a few numbers, made without a shuffle from wide ones; they
    are dealt anew, into files of a fair size instead of a small one for each task.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "table")
    df = df.hint("rebalance") if narrow else df
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
