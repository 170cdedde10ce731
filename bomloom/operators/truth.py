"""Ground truth on drawn pairs: similarity and class of pairs that a seed decides, where all pairs would be too many."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomloom.functions.sets import overlap, portable_hash
from bomloom.operators.metrics import relationship
from bomloom.operators.order import numbered
from bomloom.operators.search import sizes
from bomloom.sources.inputs import edges
from bomloom.sources.tables import written


def drawn_numbers(spark, total: int, n: int, seed: int) -> DataFrame:
    """number: n different ones (all, if there are no more) of those below total; of a sequence that seed gives, the first that don't repeat.

    Of more than half of them, those that are left out are drawn instead.
    """
    if n >= total:
        return spark.range(max(total, 0)).withColumnRenamed("id", "number")
    if 2 * n > total:
        return spark.range(total).withColumnRenamed("id", "number").join(drawn_numbers(spark, total, total - n, seed), "number", "left_anti")
    draws = math.ceil(1.2 * total * math.log(total / (total - n))) + 100
    while True:
        sequence = spark.range(draws).select("id", (portable_hash(F.concat_ws(":", F.lit(str(seed)), "id")) % total).alias("number"))
        first = written(sequence.groupBy("number").agg(F.min("id").alias("id")))
        if first.count() >= n:
            return first.orderBy("id").limit(n).select("number")
        draws *= 2


def drawn_pairs(materials: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """material_a < material_b: n different pairs of the distinct materials (first column), or all pairs if there are no more.

    Pairs are numbered without being listed: materials in order of their ids, number t
    is the pair (a, b) with t = b (b - 1) / 2 + a. The same materials and seed give the
    same pairs, however they are partitioned.
    """
    spark = materials.sparkSession
    ids = written(numbered(materials.select(F.col(materials.columns[0]).cast("string").alias("id")).dropna().distinct(), "place", F.col("id")))
    count = ids.count()
    t = F.col("number")
    guess = F.floor((1 + F.sqrt(1 + 8 * t.cast("double"))) / 2)
    # The root of a large number may be off by a little.
    b = F.when(guess * (guess - 1) / 2 > t, guess - 1).when(guess * (guess + 1) / 2 <= t, guess + 1).otherwise(guess)
    pairs = drawn_numbers(spark, count * (count - 1) // 2, n, seed).withColumn("b", b.cast("long")).withColumn("a", (t - F.col("b") * (F.col("b") - 1) / 2).cast("long"))
    of = lambda side: ids.select((F.col("place") - 1).alias(side), F.col("id").alias(f"material_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("material_a", "material_b")


def sampled_ground_truth(bom: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """material_a, material_b, shared_components, similarity, relationship_type of n drawn pairs of parents that have components."""
    links = written(edges(bom))
    pairs = written(drawn_pairs(links.select("parent_id"), n, seed))
    left = pairs.join(links.select(F.col("parent_id").alias("material_a"), "child_id"), "material_a")
    shared = left.join(links.select(F.col("parent_id").alias("material_b"), "child_id"), ["material_b", "child_id"]).groupBy("material_a", "material_b").agg(F.count("*").alias("shared"))
    out = pairs.join(shared, ["material_a", "material_b"], "left")
    size = sizes(links)
    for side in "ab":
        out = out.join(size.select(F.col("material_id").alias(f"material_{side}"), F.col("size").alias(f"size_{side}")), f"material_{side}")
    n_shared = F.coalesce("shared", F.lit(0).cast("long"))
    out = out.select("material_a", "material_b", n_shared.alias("shared_components"), overlap(n_shared, F.col("size_a"), F.col("size_b")).alias("similarity"))
    return out.withColumn("relationship_type", relationship(F.col("similarity")))
