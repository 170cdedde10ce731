"""Goods movements: components of materials, recent movements, and predecessors by opposed demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.operators.search import Queries, find_similar_materials_jaccard, query_ids
from bomloom.sources.inputs import default, relation

MAX_CANDIDATES = 100


def aggregate_material_components(spark: SparkSession, bom_table: DataFrame | str, material_filter: list[str] | None = None) -> DataFrame:
    """material_id, components: the sorted children of each parent, repeats included."""
    bom = relation(spark, bom_table, ["parent_id", "child_id"], "bom_table").select("parent_id", "child_id").dropna()
    if material_filter is not None:
        bom = bom.where(F.col("parent_id").isin(material_filter))
    return bom.groupBy(F.col("parent_id").alias("material_id")).agg(F.sort_array(F.collect_list("child_id")).alias("components"))


def any_date(c: Column) -> Column:
    """A date from a date, or from text in ISO or YYYYMMDD form; null from others."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("date"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def filter_recent_movements(spark: SparkSession, movements_table: DataFrame | str, time_window_days: int | None = 365, min_quantity: float | None = 0) -> DataFrame:
    """material_id, movement_date, quantity: movements over min_quantity in the last days before the newest of them."""
    moves = relation(spark, movements_table, ["material_id", "movement_date", "quantity"], "movements_table")
    clean = moves.select("material_id", any_date(F.col("movement_date")).alias("movement_date"), F.col("quantity").cast("string").try_cast("double").alias("quantity")).dropna()
    clean = clean.where(F.col("quantity") > default(min_quantity, 0))
    newest = clean.agg(F.max("movement_date").alias("newest"))  # one row
    return clean.join(F.broadcast(newest), F.col("movement_date") >= F.date_sub("newest", default(time_window_days, 365))).drop("newest")


def temporal_score(last: Column, start: Column) -> Column:
    """How well the end of one material's usage fits the start of another's."""
    return (
        F.when((last >= start) & (last <= F.add_months(start, 6)), 1 - F.datediff(last, start) / 180 * 0.3)
        .when((last >= F.add_months(start, -3)) & (last < start), 0.7 - F.datediff(start, last) / 90 * 0.3)
        .when(last > F.add_months(start, 6), 0.3)
        .otherwise(0.0)
    )


def infer_predecessors(
    spark: SparkSession,
    queries: Queries,
    lookback_months: int | None = 24,
    min_similarity: float | None = 0.3,
    min_confidence: float | None = 0.5,
    lag_weeks: int | None = 8,
    min_overlapping_weeks: int | None = 8,
    bom_table: DataFrame | str | None = "bom_items",
    movements_table: DataFrame | str | None = "goods_movements",
) -> DataFrame:
    """Materials that a query may have replaced: alike in components, and used less as it was used more.

    The 100 most similar materials of each query are candidates. Their weekly quantities
    are joined with the query's of lag_weeks later; a negative correlation over enough
    weeks, similarity and the fit in time make the confidence.
    """
    moves = relation(spark, default(movements_table, "goods_movements"), ["material_id", "movement_date", "quantity"], "movements_table")
    moves = moves.select(F.col("material_id").cast("string").alias("material_id"), F.col("movement_date").cast("date").alias("date"), F.col("quantity").cast("double").alias("quantity")).dropna(subset=["material_id", "date"])
    ids = query_ids(spark, queries)
    candidates = find_similar_materials_jaccard(spark, ids, MAX_CANDIDATES, default(min_similarity, 0.3), bom_table).select("query_id", F.col("material_id").alias("predecessor_id"), "similarity")
    week = F.trunc("date", "week").alias("week")
    own = moves.join(ids, moves["material_id"] == ids["query_id"], "left_semi").withColumnRenamed("material_id", "query_id")
    starts = own.groupBy("query_id").agg(F.min("date").alias("successor_start"))
    own_weeks = own.groupBy("query_id", week).agg(F.sum("quantity").alias("query_quantity")).withColumn("week", F.date_sub("week", 7 * default(lag_weeks, 8)))
    theirs = candidates.join(starts, "query_id").join(moves.withColumnRenamed("material_id", "predecessor_id"), "predecessor_id").where(F.col("date") >= F.add_months("successor_start", -default(lookback_months, 24)))
    key = ["query_id", "predecessor_id"]
    span = ["similarity", "successor_start"]
    weeks = theirs.groupBy(*key, *span, week).agg(F.sum("quantity").alias("quantity"), F.min("date").alias("first"), F.max("date").alias("last"))
    # Weeks in which only the candidate was used count for its span alone.
    both = weeks.join(own_weeks.withColumn("met", F.lit(1)), ["query_id", "week"], "left").withColumn("theirs", F.when(F.col("met") == 1, F.col("quantity")))
    # corr() fails on constant series under ANSI; they have no correlation here.
    spread = F.stddev_pop("theirs") * F.stddev_pop("query_quantity")
    fits = both.groupBy(*key, *span).agg(
        (F.covar_pop("theirs", "query_quantity") / F.nullif(spread, F.lit(0.0))).alias("correlation"), F.count("met").alias("overlapping_weeks"), F.min("first").alias("predecessor_first_usage"), F.max("last").alias("predecessor_last_usage")
    )
    fits = fits.where(F.col("overlapping_weeks") >= default(min_overlapping_weeks, 8))
    scored = fits.withColumn("temporal_score", temporal_score(F.col("predecessor_last_usage"), F.col("successor_start"))).where("correlation < 0 AND temporal_score > 0")
    confidence = 0.4 * F.greatest(F.lit(0.0), -F.col("correlation")) + 0.3 * F.col("similarity") + 0.3 * F.col("temporal_score")
    scored = scored.withColumn("confidence", confidence).where(F.col("confidence") >= default(min_confidence, 0.5))
    rounded = [F.round(c, 4).alias(c) for c in ("confidence", "correlation", "similarity", "temporal_score")]
    return scored.select("query_id", "predecessor_id", *rounded, "predecessor_first_usage", "predecessor_last_usage", "successor_start", "overlapping_weeks")
