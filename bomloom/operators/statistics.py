"""Time-series features of materials, their statistics, and transactional embeddings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom.functions.features import CATEGORIES, DOMAIN, NAMES, features
from bomloom.functions.vectors import norm
from bomloom.operators.movements import filter_recent_movements
from bomloom.sources.inputs import default

#: Places of the embedding that hold features of the same index; the others are 0.
FILLED = [*range(30), *range(92, 98)]
DIMENSION = 128


def _of_material(table: pa.Table) -> pa.Table:
    table = table.sort_by([("movement_date", "ascending"), ("quantity", "ascending")])
    values = features(table.column("quantity").to_numpy().astype(float))
    return pa.table({"material_id": table.column("material_id").slice(0, 1), "features": pa.array([values.tolist()], pa.list_(pa.float64()))})


def _in_batch(ids: DataFrame, size: int | None, offset: int | None) -> DataFrame:
    """The ids of one batch of the sorted distinct ones; all without a size."""
    return ids if size is None else ids.orderBy("material_id").offset(default(offset, 0)).limit(size)


def extract_ts_features(spark: SparkSession, movements_table: DataFrame | str, time_window_days: int | None = 365, min_observations: int | None = 3, batch_size: int | None = None, batch_offset: int | None = 0) -> DataFrame:
    """material_id, features: the NAMES of functions.features, of each material with enough recent movements.

    A task holds one material's movements within the window at a time.
    """
    recent = filter_recent_movements(spark, movements_table, time_window_days)
    enough = recent.groupBy("material_id").agg(F.count("*").alias("n")).where(F.col("n") >= default(min_observations, 3)).select("material_id")
    chosen = recent.join(_in_batch(enough, batch_size, batch_offset), "material_id", "left_semi")
    return chosen.groupBy("material_id").applyInArrow(_of_material, "material_id string, features array<double>")


def core_features(spark: SparkSession, movements_table: DataFrame | str, time_window_days: int | None = 365, min_observations: int | None = 3) -> DataFrame:
    """Those features that plain aggregates give, without Python: material_id and a column each."""
    recent = filter_recent_movements(spark, movements_table, time_window_days)
    q = F.col("quantity")
    out = recent.groupBy("material_id").agg(
        F.avg(q).alias("mean"), F.median(q).alias("median"), F.var_pop(q).alias("variance"), F.stddev_pop(q).alias("standard_deviation"), F.sum(q).alias("sum_values"), F.count(q).alias("length"),
        F.min(q).alias("minimum"), F.max(q).alias("maximum"), F.max(F.abs(q)).alias("absolute_maximum"), F.sum(q * q).alias("absolute_energy"), F.percentile(q, 0.25).alias("quantile__q_0_25"), F.percentile(q, 0.75).alias("quantile__q_0_75"),
    )
    return out.where(F.col("length") >= default(min_observations, 3)).withColumn("range", F.col("maximum") - F.col("minimum")).withColumn("iqr", F.col("quantile__q_0_75") - F.col("quantile__q_0_25"))


def _described(rows: DataFrame, names: list[str], categories: list[str], first: int) -> DataFrame:
    """Statistics of array column x over all rows, one aggregation by place."""
    labels = F.array(*(F.struct(F.lit(n).alias("feature_name"), F.lit(first + i).alias("feature_index"), F.lit(c).alias("feature_category")) for i, (n, c) in enumerate(zip(names, categories, strict=True))))
    each = rows.select(F.posexplode("x").alias("i", "v"))
    sums = each.groupBy("i").agg(F.avg("v").alias("mean_value"), F.stddev_pop("v").alias("std_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.count("*").alias("num_samples"))
    return sums.withColumn("label", F.get(labels, F.col("i"))).select("label.*", "mean_value", "std_value", "min_value", "max_value", "num_samples")


def recompute_embedding_statistics(spark: SparkSession, movements_table: DataFrame | str, time_window_days: int | None = 365, min_observations: int | None = 3, extracted: DataFrame | None = None) -> DataFrame:
    """Statistics of the 92 features over all materials, and six reserved rows."""
    rows = extracted if extracted is not None else extract_ts_features(spark, movements_table, time_window_days, min_observations)
    found = _described(rows.select(F.col("features").alias("x")), NAMES, CATEGORIES, 0)
    reserved = spark.range(92, 98).select(F.concat(F.lit("reserved_domain_specific_"), F.col("id").cast("string")), F.col("id").cast("int"), F.lit("reserved"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1).cast("long"))
    return found.unionAll(reserved)


def domain_features(spark: SparkSession, movements_table: DataFrame, time_window_days: int | None = 365, min_observations: int | None = 3) -> DataFrame:
    """material_id and the DOMAIN features: shares of movement types and weekends, concentration on weekdays, trend.

    Without a movement_type column the type shares are 0.
    """
    moves = movements_table
    kind = F.col("movement_type").cast("string") if "movement_type" in moves.columns else F.lit(None).cast("string")
    clean = moves.select("material_id", F.col("movement_date").cast("date").alias("date"), F.col("quantity").cast("double").alias("quantity"), kind.alias("kind")).dropna(subset=["material_id", "date", "quantity"]).where("quantity > 0")
    newest = clean.agg(F.max("date").alias("newest"))
    clean = clean.join(F.broadcast(newest), F.col("date") >= F.date_sub("newest", default(time_window_days, 365)))
    day = F.dayofweek("date") - 1
    share = lambda on: (F.sum(on.cast("int")) / F.count("*")).cast("float")
    days = clean.groupBy("material_id", day.alias("day")).agg(F.count("*").alias("n"))
    total = days.groupBy("material_id").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    spread = days.join(total, "material_id").groupBy("material_id").agg((1 - F.sum(-p * F.ln(p)) / F.ln(F.lit(7.0))).cast("float").alias("weekday_concentration"))
    place = (F.row_number().over(Window.partitionBy("material_id").orderBy("date", "quantity")) - 1).alias("t")
    line = clean.select("material_id", "quantity", place).groupBy("material_id").agg((F.covar_pop("t", "quantity") / F.nullif(F.var_pop("t"), F.lit(0.0))).alias("slope"), F.avg("quantity").alias("mean"))
    strength = F.when(F.col("mean") > 1e-8, F.abs(F.coalesce("slope", F.lit(0.0))) / F.col("mean")).otherwise(0.0)
    out = clean.groupBy("material_id").agg(share(F.coalesce(F.col("kind") == "261", F.lit(False))).alias("receipt_ratio"), share(F.coalesce(F.col("kind") == "262", F.lit(False))).alias("reversal_ratio"), share(day.isin(0, 6)).alias("weekend_ratio"), F.count("*").alias("n"))
    out = out.where(F.col("n") >= default(min_observations, 3)).join(spread, "material_id").join(line, "material_id")
    return out.select("material_id", "receipt_ratio", "reversal_ratio", "weekend_ratio", "weekday_concentration", strength.cast("float").alias("trend_strength"), (F.signum(F.coalesce("slope", F.lit(0.0))) * F.least(F.lit(1.0), strength)).cast("float").alias("growth"))


def compute_domain_specific_statistics(spark: SparkSession, movements_table: DataFrame, time_window_days: int | None = 365, min_observations: int | None = 3) -> DataFrame:
    rows = domain_features(spark, movements_table, time_window_days, min_observations)
    return _described(rows.select(F.array(*(F.col(c).cast("double") for c in DOMAIN)).alias("x")), DOMAIN, ["advanced"] * 6, 92)


def check_statistics_freshness(statistics: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: stat_count, max_samples, current_version, last_updated, is_fresh (30 statistics or more, updated within 7 days)."""
    now = F.current_timestamp() if now is None else now
    found = statistics.agg(F.count("*").alias("stat_count"), F.coalesce(F.max("num_samples"), F.lit(0)).alias("max_samples"), F.coalesce(F.max("version"), F.lit(0)).alias("current_version"), F.max("updated_at").alias("updated"))
    last = F.coalesce(F.col("updated"), now - F.expr("INTERVAL 8 DAYS"))
    return found.select("stat_count", "max_samples", "current_version", last.alias("last_updated"), ((F.col("stat_count") >= 30) & (last >= now - F.expr("INTERVAL 7 DAYS"))).alias("is_fresh"))


def compute_transactional_embeddings(spark: SparkSession, movements_table: DataFrame, statistics: DataFrame, time_window_days: int | None = 365, batch_size: int | None = None, batch_offset: int | None = 0, extracted: DataFrame | None = None) -> DataFrame:
    """material_id, transactional_embedding: standardised features in 128 places, of length 1 unless all are 0.

    A feature without statistics, or without variance, is 0. extracted: rows of extract_ts_features, if they have been made.
    """
    rows = extracted if extracted is not None else extract_ts_features(spark, movements_table, time_window_days, 3, batch_size, batch_offset)
    rows = rows.join(domain_features(spark, movements_table, time_window_days, 1), "material_id", "left")
    found = {r["feature_index"]: r for r in statistics.select("feature_index", "mean_value", "std_value").where(F.col("feature_index") < DIMENSION).limit(DIMENSION).collect()}  # a row a feature
    places = []
    for i in range(DIMENSION):
        s = found.get(i)
        if i not in FILLED or s is None or not s["std_value"]:
            places.append(F.lit(0.0))
            continue
        value = F.get("features", F.lit(i)) if i < 92 else F.col(DOMAIN[i - 92]).cast("double")
        places.append(F.coalesce((value - F.lit(s["mean_value"])) / F.lit(s["std_value"]), F.lit(0.0)))
    raw = rows.select("material_id", F.array(*places).alias("v"))
    length = norm(F.col("v"))
    return raw.withColumn("length", length).select("material_id", F.transform("v", lambda x: F.when(F.col("length") > 1e-8, x / F.col("length")).otherwise(x).cast("float")).alias("transactional_embedding"))
