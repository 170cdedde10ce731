"""Exact vector search by slices and blocks against all distances, one by one."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bomloom.functions.vectors import cosine_distance, l2sq_distance
from bomloom.operators import embeddings


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_slices_and_blocks(spark, monkeypatch, metric, odd):
    """Copies tie by id, a vector of zeros is 1 to all; all is the same with vectors that are no numbers, which go one by one."""
    monkeypatch.setattr(embeddings, "_SLICE", 40)
    monkeypatch.setattr(embeddings, "_AT_ONCE", 3)
    x = np.random.default_rng(1).normal(size=(150, 8)).astype(np.float32)
    x[50:80], x[90], x[100] = x[50], 0, 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(150, [None] * 8)] * odd
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 10 = 0 AND vec_id < 150").withColumnRenamed("vec_id", "query_id")
    out = embeddings.vector_top_k(vectors, queries, 7, metric, block=4)
    assert ("FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()) == (not odd)
    distance = {"cosine": cosine_distance, "l2sq": l2sq_distance}[metric]
    each = vectors.crossJoin(queries.withColumnRenamed("embedding", "wanted")).where("vec_id <> query_id").withColumn("distance", distance(F.col("embedding"), F.col("wanted")))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("rank <= 7")
    columns = ["query_id", "rank", "vec_id", "distance"]
    assert sorted(map(tuple, out.select(columns).collect()), key=repr) == sorted(map(tuple, each.select(columns).collect()), key=repr)
