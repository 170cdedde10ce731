"""Connected components of edge tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of edges (a, b: long), besides the roots.

    Large and small stars in turn point each node at the least node near it, until
    nothing changes; a round is two aggregations with joins, and is written as a table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small)
        new_state = _state(new)
        dropped(now)
        now = new
        if new_state == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new_state
