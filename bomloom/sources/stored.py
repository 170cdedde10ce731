"""A stored table whose rows are replaced by key.

Rows lie in Parquet files divided by buckets, which a hash of the key deals. A change
writes the buckets that hold changed keys anew, beside the old files, and then names a
new version: a small file that lists which folder each bucket is in now. Readers see the
version before or the one after, never a mixture; a writer that fails on the way, or is
overtaken by another, leaves only files that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bomloom.sources.tables import dropped, written


class Overtaken(RuntimeError):
    """Another writer has named a version meanwhile; this one's change wasn't made."""


class KeyedTable:
    """The table at a path; create() makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.FileContext.getFileContext(self._at("").toUri(), spark._jsparkSession.sessionState().newHadoopConf())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 32) -> KeyedTable:
        """An empty table at a path where there is none; buckets should be so many that one is a few hundred MB."""
        table = cls(spark, path)
        table._name(0, {"schema": schema.jsonValue(), "key": key, "buckets": buckets, "folders": {}})
        return table

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self._files.util().exists(self._at(folder)):
            return []
        return [x.getPath().getName() for x in self._files.util().listStatus(self._at(folder))]

    def _name(self, version: int, about: dict) -> None:
        """Make a version: written aside, then renamed, which fails if another writer has named the same."""
        jvm = self.spark._jvm
        aside = f"aside/{uuid.uuid4().hex}.json"
        new = jvm.java.util.EnumSet.of(self._hadoop.CreateFlag.CREATE)
        parents = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        parents[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        out = self._files.create(self._at(aside), new, parents)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        self._files.mkdir(self._at("versions"), None, True)
        try:
            self._files.rename(self._at(aside), self._at(f"versions/{version:012d}.json"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._files.delete(self._at(aside), False)
            if "FileAlreadyExists" in str(e):
                raise Overtaken(f"{self.path} has a version {version} already") from e
            raise

    def version(self) -> int:
        """The number of the newest version; 0 is the empty table."""
        found = [int(x.split(".")[0]) for x in self._names("versions") if x.endswith(".json") and not x.startswith(".")]
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return max(found)

    def _about(self, version: int | None = None) -> tuple[int, dict]:
        version = self.version() if version is None else version
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def _rows(self, about: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{d}" for b, d in about["folders"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(about["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of another that vacuum() has left."""
        return self._rows(self._about(version)[1])

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """Put rows in the place of all rows of their keys, and of keys (its first column) if given; returns the version made.

        A key may have several rows; a null key is one like others. Columns that rows
        lacks are null, and those that the table lacks are left out. Replacing by the
        same rows again changes nothing. Overtaken is raised if another writer was
        faster; the caller reads and tries again.
        """
        version, about = self._about()
        schema, key = StructType.fromJson(about["schema"]), about["key"]
        have = set(rows.columns)
        rows = written(rows.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)))
        gone = rows.select(F.col(key).alias("_key"))
        if keys is not None:
            gone = gone.unionAll(keys.select(F.col(keys.columns[0]).cast(schema[key].dataType)))
        gone = written(gone.distinct())
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(about["buckets"])).cast("int")
        touched = [r[0] for r in gone.select(bucket("_key")).distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return version
        old = self._rows(about, touched)
        new = old.join(gone, old[key].eqNullSafe(gone["_key"]), "left_anti").unionByName(rows)
        folder = f"data/{uuid.uuid4().hex}"
        # Spark makes several files of a bucket that is far larger than others.
        new.withColumn("_bucket", bucket(key)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {x.split("=")[1]: f"{folder}/{x}" for x in self._names(folder) if x.startswith("_bucket=")}
        kept = {b: d for b, d in about["folders"].items() if int(b) not in touched}
        self._name(version + 1, about | {"folders": kept | made})
        dropped(rows, gone)
        return version + 1

    def delete(self, keys: DataFrame) -> int:
        """Delete all rows of keys (the first column)."""
        about = self._about()[1]
        return self.replace(self.spark.createDataFrame([], StructType.fromJson(about["schema"])), keys)

    def upsert(self, rows: DataFrame) -> int:
        """replace() for tables with one row a key: of several rows of a key the greatest, column by column, is put."""
        key = self._about()[1]["key"]
        row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
        return self.replace(rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(row).alias("_row")).select("_row.*"))

    def vacuum(self) -> None:
        """Delete older versions, and files that the newest doesn't name. No writer or older reader should be at work."""
        version, about = self._about()
        named = {d.split("/")[1] for d in about["folders"].values()}
        for x in self._names("versions"):
            if x.endswith(".json") and int(x.split(".")[0]) < version:
                self._files.delete(self._at(f"versions/{x}"), False)
        for x in self._names("data"):
            if x not in named:
                self._files.delete(self._at(f"data/{x}"), True)
