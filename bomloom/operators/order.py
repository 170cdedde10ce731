"""Numbers of rows in an order over all of them, without one task that sees all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.sources.tables import written


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the number of each row, from 1: ranges of the order are sorted apart, and begin where those before them end."""
    ranges = written(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_within", within).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_within", "_start")
