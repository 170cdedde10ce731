"""Tables between the jobs of an operator, and the shuffle files of these jobs."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from bomloom.sources import tables
from bomloom.sources.tables import dropped

__all__ = ["dropped", "shuffle_files_end_with_each_job", "written"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task writes at once for a table with keys, instead of sorting its rows by them.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def written(df: DataFrame, *keys: str) -> DataFrame:
    with _set(df.sparkSession, _WRITERS, "8"):
        return tables.written(df, *keys)


def shuffle_files_end_with_each_job(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within, the shuffle files of a finished job go at once, not when the driver next collects garbage."""
    return _set(spark, _CLEANUP, "true")
