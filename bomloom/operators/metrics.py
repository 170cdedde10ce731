"""Quality of retrieval and inference against known relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: precision_at_k, recall_at_k, mrr, top1_accuracy over the queries of truth.

    ranked: query_id, material_id, rank; truth: query_id, material_id. A query without
    results counts as 0 everywhere.
    """
    truth = truth.select("query_id", "material_id").distinct()
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.where(F.col("rank") <= k).join(truth, ["query_id", "material_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    each = wanted.join(hits, "query_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return each.agg(
        F.avg(n / k).alias("precision_at_k"), F.avg(n / F.col("relevant")).alias("recall_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)).alias("top1_accuracy")
    )


def predecessor_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, precision, recall, f1 of pairs (query_id, predecessor_id)."""
    key = ["query_id", "predecessor_id"]
    a, b = found.select(*key).distinct().withColumn("f", F.lit(1)), truth.select(*key).distinct().withColumn("t", F.lit(1))
    both = a.join(b, key, "full").agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("true_positives"), F.count(F.when(F.col("t").isNull(), 1)).alias("false_positives"), F.count(F.when(F.col("f").isNull(), 1)).alias("false_negatives"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    ratio = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    return both.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def relationship(similarity: Column) -> Column:
    """The name of a degree of similarity."""
    return (
        F.when(similarity == 1, "identical").when(similarity == 0, "unrelated").when(similarity >= 0.8, "variant").when(similarity >= 0.5, "partial_overlap").when(similarity >= 0.2, "low_overlap").otherwise("minimal_overlap")
    )


def calibration(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """For each relationship_type of truth (material_a, material_b): n, and mean, least and greatest similarity of its pairs in scored (0 where it has none)."""
    joined = truth.join(scored.select("material_a", "material_b", "similarity"), ["material_a", "material_b"], "left").withColumn("s", F.coalesce("similarity", F.lit(0.0)))
    return calibrated(joined.select("relationship_type", F.col("s").alias("similarity")))


def calibrated(pairs: DataFrame) -> DataFrame:
    """calibration() of pairs that have both relationship_type and similarity."""
    s = F.col("similarity")
    return pairs.groupBy("relationship_type").agg(F.count("*").alias("n"), F.avg(s).alias("mean_similarity"), F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"))


def top_level(bom: DataFrame) -> DataFrame:
    """material_id of parents that are no one's child."""
    return bom.select(F.col("parent_id").alias("material_id")).dropna().distinct().join(bom.select(F.col("child_id").alias("material_id")), "material_id", "left_anti")
