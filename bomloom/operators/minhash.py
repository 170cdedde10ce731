"""Search by the rate of equal min-hash values: banded signatures as join keys, then exact similarity.

Materials of equal component sets are one class, which its first material stands for, so
a group of copies is one row of every join. Classes that agree in all values of a band
meet. A band in which very many meet says little, as some common component decides it:
its classes are paired by their rarest components instead, which loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.functions.sets import overlap, portable_hash
from bomloom.operators.search import prefix_candidates
from bomloom.sources.inputs import default, edges, relation
from bomloom.sources.tables import written

SEEDS = 128
_MERSENNE = (1 << 31) - 1
#: The most classes that are paired because they meet in a band.
MEETING = 500


def seeded(h: Column, seed: int) -> Column:
    """One of the hash functions of a family: linear ones modulo a prime."""
    a, b = (seed * 1_000_003 + 12_345) % _MERSENNE + 1, (seed * 7_919_777 + 54_321) % _MERSENNE
    return (F.lit(a).cast("long") * (h % _MERSENNE) + F.lit(b).cast("long")) % _MERSENNE


def signatures(pairs: DataFrame) -> DataFrame:
    """material_id, size, signature (the least hash of its components for each seed) and two sums by which equal sets are known, for distinct edges.

    Edges are sent to their parent, as a signature is far larger than an edge, and there
    would be one for each parent in each task.
    """
    hashed = pairs.repartition("parent_id").select("parent_id", "child_id", portable_hash(F.col("child_id")).alias("h"))
    least = F.array(*(F.min(seeded(F.col("h"), seed)) for seed in range(SEEDS)))
    return hashed.groupBy(F.col("parent_id").alias("material_id")).agg(F.count("*").alias("size"), least.alias("signature"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("child_id")).alias("y"))


def bands(min_similarity: float, confidence: float = 0.995) -> tuple[int, int]:
    """(bands, values a band): as many values as leave pairs of the bound that chance of agreeing in a band; one if none do."""
    rows = [r for r in range(1, SEEDS // 4 + 1) if 1 - (1 - min_similarity**r) ** (SEEDS // r) >= confidence]
    r = max(rows, default=1)
    return SEEDS // r, r


def _keys(classes: DataFrame, n: int, r: int) -> DataFrame:
    """class_id, band, key: a hash of each band's values."""
    slices = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("signature", i * r + 1, F.lit(r))).alias("key")))
    return classes.select("class_id", F.explode(slices).alias("x")).select("class_id", "x.band", "x.key")


def _meeting(keys: DataFrame) -> DataFrame:
    """class_a < class_b with an equal key."""
    a, b = keys.select("key", F.col("class_id").alias("class_a")), keys.select("key", F.col("class_id").alias("class_b"))
    return a.join(b, "key").where("class_a < class_b").select("class_a", "class_b")


def component_classes(spark: SparkSession, bom_table: DataFrame | str | None = "bom_items") -> DataFrame:
    """material_id, class_id: the first material with the same components. Sets are equal if their sizes and two 60-bit and 64-bit sums are."""
    pairs = edges(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table"))
    return _classes(written(signatures(pairs)))[1]


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, size, signature), (material_id, class_id)."""
    same = ["size", "x", "y"]
    named = sets.groupBy(*same).agg(F.min("material_id").alias("class_id"))
    members = sets.join(named, same).select("material_id", "class_id")
    return sets.join(named.select("class_id"), F.col("material_id") == F.col("class_id")).select("class_id", "size", "signature"), members


def minhash_similar_pairs(spark: SparkSession, min_similarity: float, bom_table: DataFrame | str | None = "bom_items", confidence: float = 0.995, meeting: int = MEETING) -> DataFrame:
    """class_a, class_b, shared_components, similarity: classes (by component_classes) whose components are at least so similar.

    Similarities are exact; a pair at the bound is missed with a chance of about 1 less
    confidence, pairs above it less often. Edges with nulls don't count. The bound must
    be above 0.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be above 0, and 1 at most")
    pairs = written(edges(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table")))
    classes = written(_classes(written(signatures(pairs)))[0])
    n, r = bands(min_similarity, confidence)
    keys = written(_keys(classes, n, r))
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > meeting).select("key")
    # What rare components say of a pair is known before its signatures and lists are read.
    possible = prefix_candidates(pairs.join(classes.select(F.col("class_id").alias("parent_id")), "parent_id", "left_semi"), min_similarity)
    possible = written(possible.select(F.col("material_a").alias("class_a"), F.col("material_b").alias("class_b")))
    few = _meeting(keys.join(many, "key", "left_anti")).join(possible, ["class_a", "class_b"], "left_semi")
    crowded = keys.join(many, "key", "left_semi").select("class_id").distinct()
    rarest = possible
    for side in ("class_a", "class_b"):
        rarest = rarest.join(crowded.withColumnRenamed("class_id", side), side, "left_semi")
    met = few.unionByName(rarest).distinct()
    a, b = (classes.select(F.col("class_id").alias(f"class_{x}"), F.col("size").alias(f"size_{x}"), F.col("signature").alias(f"signature_{x}")) for x in "ab")
    # Beyond five deviations below the bound, a pair's rate of equal values isn't chance.
    rate = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / SEEDS
    least = min_similarity - 5 * (min_similarity * (1 - min_similarity) / SEEDS) ** 0.5
    near = met.join(a, "class_a").join(b, "class_b").where(F.least("size_a", "size_b") >= min_similarity * F.greatest("size_a", "size_b") - 1e-9).where(rate >= least)
    near = written(near.select("class_a", "class_b", "size_a", "size_b"))
    left = near.join(pairs.select(F.col("parent_id").alias("class_a"), "child_id"), "class_a")
    shared = left.join(pairs.select(F.col("parent_id").alias("class_b"), "child_id"), ["class_b", "child_id"]).groupBy("class_a", "class_b", "size_a", "size_b").agg(F.count("*").alias("shared_components"))
    similarity = overlap(F.col("shared_components"), F.col("size_a"), F.col("size_b"))
    return shared.select("class_a", "class_b", "shared_components", similarity.alias("similarity")).where(F.col("similarity") >= min_similarity)
