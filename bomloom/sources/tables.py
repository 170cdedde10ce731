"""Tables between the jobs of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of our own on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bomloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables"


def written(df: DataFrame, *keys: str) -> DataFrame:
    """df as a Parquet table, divided by keys: its lineage ends here, and a lost executor costs only tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*keys) if keys else out).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.bomloom_path = path
    return table


def dropped(*tables: DataFrame, part: str = "") -> None:
    """Delete tables, or a part (key=value) of each, that no later job reads."""
    for table in tables:
        if path := getattr(table, "bomloom_path", None):
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
