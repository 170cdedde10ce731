"""Approximate search in vectors: inverted lists by k-means cells, stored, and probed by several cells a query.

Centers are fitted on a bounded sample; every vector is in the list of its nearest one.
Lists are a Parquet table divided by cell, so a search reads the cells that its queries
probe and no other. Within a cell vectors lie in blocks of bounded size, and so do the
queries that probe it: a task compares one block of each, whatever share of the vectors
or queries one cell has. Distances of what is compared are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomloom.sources.tables import dropped, written

#: Vectors that centers are fitted on, about; the most cells; vectors and queries that a task compares at once.
SAMPLE, MAX_CELLS = 50_000, 4096
BLOCK, QUERIES_AT_ONCE = 4096, 512


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows; null elements count as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy()
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(length > 0, length, 1.0)[:, None]


def _nearest(centers: np.ndarray, count: int, metric: str):
    half = np.einsum("ij,ij->i", centers, centers) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"))
            rows = _unit(rows) if metric == "cosine" else rows
            near = half - rows @ centers.T
            k = min(count, len(centers))
            first = np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(centers) else np.argsort(near, axis=1, kind="stable")
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(first.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return nearest


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of a to the same rows of b, as vectors.cosine_distance and l2sq_distance have them."""
    if metric == "l2sq":
        return np.einsum("ij,ij->i", a - b, a - b)
    norm = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return 1 - np.where(norm > 0, np.einsum("ij,ij->i", a, b) / np.where(norm > 0, norm, 1.0), 0.0)


def _best(k: int, metric: str, _key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
    """The k nearest vectors of a block to each query of a block; equal distances by id.

    A product of matrices finds all pairs that may be among them, rounding included;
    these are compared again one by one.
    """
    empty = pa.table({"query_id": queries.column("query_id").slice(0, 0), "vec_id": vectors.column("vec_id").slice(0, 0), "distance": pa.array([], pa.float64())})
    if not vectors.num_rows or not queries.num_rows:
        return empty
    v, q = _matrix(vectors.column("embedding")), _matrix(queries.column("embedding"))
    a, b = (_unit(q), _unit(v)) if metric == "cosine" else (q, v)
    squares = np.einsum("ij,ij->i", b, b)
    near = squares - 2 * (a @ b.T) if metric == "l2sq" else -(a @ b.T)
    if len(v) > k + 1:  # one more, as a query may meet itself
        slack = 1e-9 * (1 + squares.max() + np.einsum("ij,ij->i", a, a).max())
        at_q, at_v = np.nonzero(near <= np.partition(near, k, axis=1)[:, k, None] + slack)
    else:
        at_q, at_v = (x.ravel() for x in np.indices(near.shape))
    own, other = queries.column("query_id").combine_chunks().take(pa.array(at_q)), vectors.column("vec_id").combine_chunks().take(pa.array(at_v))
    apart = pc.fill_null(pc.not_equal(own, other.cast(own.type)), True).to_numpy(zero_copy_only=False)
    at_q, at_v = at_q[apart], at_v[apart]
    distance = _exact(q[at_q], v[at_v], metric)
    place = pc.rank(vectors.column("vec_id").combine_chunks(), null_placement="at_start", tiebreaker="first").to_numpy()
    order = np.lexsort((place[at_v], distance, at_q))
    at_q, at_v, distance = at_q[order], at_v[order], distance[order]
    first = np.searchsorted(at_q, at_q)
    kept = np.arange(len(at_q)) - first < k
    return pa.table({"query_id": queries.column("query_id").combine_chunks().take(pa.array(at_q[kept])), "vec_id": vectors.column("vec_id").combine_chunks().take(pa.array(at_v[kept])), "distance": distance[kept]})


class VectorIndex:
    """An index of (vec_id, embedding) at a path; build() makes one, VectorIndex(spark, path) opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()  # a row a cell, MAX_CELLS at most
        self.metric, self.dimension, self.kind = about[0]["metric"], len(about[0]["center"]), about[0]["kind"]
        self.centers = np.array([r["center"] for r in about], float)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> VectorIndex:
        """Index all vectors at a path that is new; metric: cosine or l2sq.

        cells: as many as the root of the number of vectors, MAX_CELLS at most, if not
        given. Null vectors, and those of another length than most, aren't indexed, as
        they have no distance to the others. An id may be repeated; it is found as often.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if metric not in ("cosine", "l2sq"):
            raise ValueError(f"metric must be cosine or l2sq, not {metric}")
        spark = vectors.sparkSession
        lengths = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
        n, dimension = (lengths[0]["rows"], lengths[0]["n"]) if lengths else (0, 0)
        whole = F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
        length = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
        fitted = whole if metric == "l2sq" else F.when(length > 0, F.transform(whole, lambda x: x / length)).otherwise(whole)
        chosen = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(seed)), F.lit(1 << 20)) < math.ceil(min(1.0, sample / max(n, 1)) * (1 << 20))
        rows = vectors.where(F.size("embedding") == dimension).where(chosen).select(array_to_vector(fitted).alias("features"))
        k = min(cells or math.isqrt(max(n - 1, 0)) + 1, MAX_CELLS)
        if n > 1 and dimension:
            centers = [c.tolist() for c in KMeans(k=max(2, k), maxIter=rounds, seed=seed).fit(rows).clusterCenters()]
        else:
            centers = [[0.0] * dimension]
        kind = vectors.schema["vec_id"].dataType.simpleString()
        spark.createDataFrame([(i, c, metric, kind) for i, c in enumerate(centers)], "cell int, center array<double>, metric string, kind string").coalesce(1).write.parquet(f"{path}/centers")
        index = cls(spark, path)
        index._append(vectors)
        return index

    def _with_cells(self, vectors: DataFrame, count: int) -> DataFrame:
        """vectors with the cells whose centers are nearest."""
        schema = T.StructType([*vectors.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        return vectors.where(F.size("embedding") == self.dimension).mapInArrow(_nearest(self.centers, count, self.metric), schema)

    def _append(self, vectors: DataFrame) -> None:
        own = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        found = written(self._with_cells(own, 1).select("vec_id", "embedding", F.get("cells", F.lit(0)).alias("cell")))
        blocks = found.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row a cell
        placed = found.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), "blocks").cast("int")).drop("blocks")
        placed.repartition("cell", "block").write.partitionBy("cell").mode("append").parquet(f"{self.path}/vectors")
        dropped(found)

    def add(self, vectors: DataFrame) -> None:
        """Index more vectors, in the lists of the centers that are there; those of another length are left out."""
        self._append(vectors)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"vec_id {self.kind}, embedding array<float>, block int, cell int").parquet(f"{self.path}/vectors")

    def probes_for(self, recall: float = 0.95, k: int = 10, sample: int = 200, seed: int = 1) -> int:
        """How many cells to probe so that of the k nearest vectors the share recall is found, by exact search for about sample of the vectors."""
        stored = self.vectors()
        share = math.ceil(min(1.0, sample / max(stored.count(), 1)) * (1 << 20))
        asked = written(stored.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share).select(F.col("vec_id").alias("query_id"), "embedding"))
        near = self.search(asked, k, len(self.centers))
        orders = self._with_cells(asked, len(self.centers)).select("query_id", "cells")
        cells = stored.select("vec_id", "cell").join(near.select("vec_id").distinct(), "vec_id", "left_semi").distinct()
        places = near.join(cells, "vec_id").join(orders, "query_id").groupBy(F.array_position("cells", F.col("cell")).alias("place")).agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a cell
        total, met = sum(r["n"] for r in places), 0
        for r in places:
            met += r["n"]
            if met >= recall * total:
                return r["place"]
        return len(self.centers)

    def search(self, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
        """query_id, vec_id, distance, rank: the k nearest to each query (query_id, embedding) in the probed cells, itself aside.

        Queries whose vector is null or of another length have no rows. With as many
        probes as there are cells the result is exact.
        """
        asked = written(self._with_cells(queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")), probes).select("query_id", "embedding", F.explode("cells").alias("cell")))
        parts = self.spark.createDataFrame([(r["cell"], -(-r["n"] // QUERIES_AT_ONCE)) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()], "cell int, parts int")  # a row a cell
        cells = [r["cell"] for r in parts.select("cell").collect()]
        lists = self.vectors().where(F.col("cell").isin(cells))  # other cells' files aren't listed
        vectors = lists.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        blocks = lists.groupBy("cell").agg(F.collect_set("block").alias("blocks"))
        wanted = asked.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("query_id", "embedding"), "parts").cast("int")).drop("parts")
        wanted = wanted.join(blocks, "cell").withColumn("block", F.explode("blocks")).drop("blocks")
        key = ["cell", "block", "part"]
        wanted = wanted.select(F.col("query_id"), F.col("embedding"), *(F.col(c).alias(f"q_{c}") for c in key))
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {lists.schema['vec_id'].dataType.simpleString()}, distance double"
        kernel = partial(_best, k, self.metric)
        near = vectors.groupBy(*key).cogroup(wanted.groupBy(*(f"q_{c}" for c in key))).applyInArrow(lambda key, v, q: kernel(key, v, q), schema)
        w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def scanned_share(self, queries: DataFrame, probes: int = 16) -> float:
        """The share of all pairs of queries and vectors that a search compares."""
        sizes = self.vectors().groupBy("cell").agg(F.count("*").alias("n"))
        asked = self._with_cells(queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")), probes).select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asked"))
        compared = asked.join(sizes, "cell").agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0
        all_, n = sizes.agg(F.sum("n")).first()[0] or 0, queries.where(F.size("embedding") == self.dimension).count()
        return compared / max(all_ * n, 1)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, recall. The mean share of each query's true neighbours (query_id, vec_id) that were found; a query without any isn't counted."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    each = hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))
