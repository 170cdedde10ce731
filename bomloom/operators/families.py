"""Product families: groups of products that a chain of similar pairs joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.operators.search import all_pairs_jaccard
from bomloom.sources.inputs import edges, relation
from bomloom.sources.tables import dropped, written


def connected(pairs: DataFrame) -> DataFrame:
    """member, first: for each member of pairs (its first two columns) the least member that it is joined with. Pairs with a null don't count.

    In turn, each member's greater neighbours and then its lesser ones are joined to the
    least of them, until nothing changes: a chain shortens by a factor in each round,
    and a hub is one group of an aggregation and of a join, never a list.
    """
    a, b = pairs.columns[:2]
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
    ordered = pairs.select(a, b).dropna().select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    alone = ordered.where("a = b").select("a", "b").distinct()
    links = written(ordered.where("a <> b").distinct())
    before = state(links)
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        greater = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = greater.groupBy("a").agg(F.min("b").alias("m"))
        lesser = greater.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(lesser.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = state(new)
        dropped(links)
        links = new
        if now == before:
            break
        before = now
    found = links.select(F.col("a").alias("member"), F.col("b").alias("first"))
    firsts = found.select(F.col("first").alias("member"), "first").unionAll(alone.select(F.col("a").alias("member"), F.col("b").alias("first")).join(found.select(F.col("member")), "member", "left_anti"))
    return found.unionAll(firsts.distinct())


def product_families(spark: SparkSession, bom_table: DataFrame | str, min_similarity: float = 0.8) -> DataFrame:
    """material_id, family_id, size: for each parent the first of its family, and how many belong to it.

    Products are of one family if pairs of at least the similarity lead from one to the
    other; a product that is like no other is a family of its own.
    """
    bom = relation(spark, bom_table, ["parent_id", "child_id"], "bom_table")
    found = written(connected(all_pairs_jaccard(spark, bom, min_similarity).select("material_a", "material_b")))
    parents = edges(bom).select(F.col("parent_id").alias("member")).distinct()
    families = parents.join(found, "member", "left").select(F.col("member").alias("material_id"), F.coalesce("first", "member").alias("family_id"))
    sizes = families.groupBy("family_id").agg(F.count("*").alias("size"))
    return families.join(sizes, "family_id").select("material_id", "family_id", "size")
