"""Comparisons of bills of materials and of descriptions, as reports over the base operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.sets import overlap


def component_presence(bom: DataFrame, a: str, b: str) -> DataFrame:
    """presence (SHARED, ONLY_A, ONLY_B), n, components of two products."""
    of = lambda m, name: bom.where(F.col("parent_id") == m).select("child_id").dropna().distinct().withColumn(name, F.lit(1))
    both = of(a, "in_a").join(of(b, "in_b"), "child_id", "full")
    presence = F.when(F.col("in_b").isNull(), "ONLY_A").when(F.col("in_a").isNull(), "ONLY_B").otherwise("SHARED")
    return both.groupBy(presence.alias("presence")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("child_id")), ",").alias("components"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """parent_id, child_id, change (ADDED, REMOVED, QTY_CHANGED), old_quantity, new_quantity between two states of edges with quantities."""
    key = ["parent_id", "child_id"]
    side = lambda df, name: df.groupBy(*key).agg(F.sum(F.col("quantity").cast("double")).alias(name), F.lit(1).alias(f"has_{name}"))
    both = side(old, "old_quantity").join(side(new, "new_quantity"), key, "full")
    change = F.when(F.col("has_old_quantity").isNull(), "ADDED").when(F.col("has_new_quantity").isNull(), "REMOVED").when(~F.col("old_quantity").eqNullSafe(F.col("new_quantity")), "QTY_CHANGED")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "change", "old_quantity", "new_quantity")


def change_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("parent_id").agg(*(F.count(F.when(F.col("change") == c, 1)).alias(c.lower()) for c in ("ADDED", "REMOVED", "QTY_CHANGED")))


def similarity_bands(pairs: DataFrame) -> DataFrame:
    """band, n of pairs with a similarity."""
    s = F.col("similarity")
    band: Column = F.when(s >= 0.8, "high").when(s >= 0.5, "medium").when(s >= 0.2, "low").otherwise("minimal")
    return pairs.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def isolated_products(bom: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """material_id of parents that no pair of at least a similarity names."""
    near = pairs.where(F.col("similarity") >= least).select(F.explode(F.array("material_a", "material_b")).alias("material_id"))
    return bom.select(F.col("parent_id").alias("material_id")).dropna().distinct().join(near, "material_id", "left_anti")


def quality_tiers(materials: DataFrame, pattern: str = r"[-_ ](basic|standard|premium)$") -> DataFrame:
    """family (the name without its tier) and the material of each tier."""
    tier = F.lower(F.regexp_extract("description", f"(?i){pattern}", 1))
    rows = materials.select("material_id", F.regexp_replace("description", f"(?i){pattern}", "").alias("family"), tier.alias("tier")).where("tier <> ''")
    return rows.groupBy("family").agg(*(F.max(F.when(F.col("tier") == t, F.col("material_id"))).alias(t) for t in ("basic", "standard", "premium")))


def substitution_effect(bom: DataFrame, old: str, new: str) -> DataFrame:
    """parent_id, has_new, n_components, n_after of the parents that use a component, were it replaced."""
    edges = bom.select("parent_id", "child_id").dropna().distinct()
    uses = edges.where(F.col("child_id") == old).select("parent_id")
    each = edges.join(uses, "parent_id", "left_semi").groupBy("parent_id").agg(F.max((F.col("child_id") == new).cast("int")).alias("has_new"), F.count("*").alias("n_components"))
    return each.withColumn("n_after", F.col("n_components") - F.col("has_new"))


def language_coverage(makt: DataFrame) -> DataFrame:
    return makt.groupBy("spras").agg(F.count_distinct("matnr").alias("n_materials"), F.count(F.when(F.col("maktx").isNull() | (F.trim("maktx") == ""), 1)).alias("n_empty"))


def preferred_descriptions(makt: DataFrame, languages: list[str]) -> DataFrame:
    """material_id, spras, description in the first of the languages that has one."""
    rank = F.coalesce(*(F.when(F.col("spras") == x, F.lit(i)) for i, x in enumerate(languages)), F.lit(len(languages)))
    w = Window.partitionBy("matnr").orderBy("rank", "spras", "maktx")
    return makt.where("maktx IS NOT NULL").withColumn("rank", rank).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.trim("matnr").alias("material_id"), "spras", F.col("maktx").alias("description"))


def missing_languages(makt: DataFrame, languages: list[str]) -> DataFrame:
    """material_id and the languages that it lacks."""
    have = makt.where("maktx IS NOT NULL").groupBy(F.trim("matnr").alias("material_id")).agg(F.collect_set("spras").alias("have"))
    lacking = F.array_except(F.array(*map(F.lit, languages)), F.col("have"))
    return have.select("material_id", F.array_join(F.array_sort(lacking), ",").alias("missing")).where("missing <> ''")


def _sets(items: DataFrame, *keys: str) -> DataFrame:
    return items.select(*keys, "parent_id", "child_id").where("child_id IS NOT NULL").distinct()


def alternative_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """material_id, components_a, components_b, similarity of the materials that two alternatives' edges both have."""
    a, b = _sets(a), _sets(b)
    size = lambda df, name: df.groupBy("parent_id").agg(F.count("*").alias(name))
    shared = a.join(b, ["parent_id", "child_id"]).groupBy("parent_id").agg(F.count("*").alias("shared"))
    both = size(a, "components_a").join(size(b, "components_b"), "parent_id").join(shared, "parent_id", "left")
    n = F.coalesce("shared", F.lit(0))
    return both.select(F.col("parent_id").alias("material_id"), "components_a", "components_b", overlap(n, F.col("components_a"), F.col("components_b")).alias("similarity"))


def alternative_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """material_id, presence (ONLY_A, ONLY_B, BOTH), child_id of the materials' components in two alternatives."""
    both = _sets(a).withColumn("in_a", F.lit(1)).join(_sets(b).withColumn("in_b", F.lit(1)), ["parent_id", "child_id"], "full")
    presence = F.when(F.col("in_b").isNull(), "ONLY_A").when(F.col("in_a").isNull(), "ONLY_B").otherwise("BOTH")
    return both.select(F.col("parent_id").alias("material_id"), presence.alias("presence"), "child_id")


def alternative_matrix(items: DataFrame) -> DataFrame:
    """material_id, alt_a < alt_b, similarity of every two alternatives (alt, parent_id, child_id) of a material."""
    sets_ = _sets(items, "alt")
    sizes = sets_.groupBy("parent_id", "alt").agg(F.count("*").alias("n"))
    a, b = sizes.toDF("parent_id", "alt_a", "n_a"), sizes.toDF("parent_id", "alt_b", "n_b")
    left, right = sets_.toDF("alt_a", "parent_id", "child_id"), sets_.toDF("alt_b", "parent_id", "child_id")
    shared = left.join(right, ["parent_id", "child_id"]).where("alt_a < alt_b").groupBy("parent_id", "alt_a", "alt_b").agg(F.count("*").alias("shared"))
    pairs = a.join(b, "parent_id").where("alt_a < alt_b").join(shared, ["parent_id", "alt_a", "alt_b"], "left")
    return pairs.select(F.col("parent_id").alias("material_id"), "alt_a", "alt_b", overlap(F.coalesce("shared", F.lit(0)), F.col("n_a"), F.col("n_b")).alias("similarity"))


def language_pivot(mara: DataFrame, makt: DataFrame, languages: dict[str, str]) -> DataFrame:
    """material_id, material_type, material_group and, for each language code, description_<its value>; deleted materials are left out."""
    texts = makt.groupBy(F.col("matnr").alias("_matnr")).agg(*(F.min(F.when(F.col("spras") == code, F.col("maktx"))).alias(f"description_{name}") for code, name in languages.items()))
    live = mara.where("lvorm IS NULL OR lvorm <> 'X'")
    out = live.join(texts, live["matnr"] == texts["_matnr"], "left")
    return out.select(F.col("matnr").alias("material_id"), F.col("mtart").alias("material_type"), F.col("matkl").alias("material_group"), *(f"description_{name}" for name in languages.values()))


def translation_coverage(pivot: DataFrame) -> DataFrame:
    """material_type, n_materials and, for each language of a pivot, how many materials have a description in it."""
    columns = [c for c in pivot.columns if c.startswith("description_")]
    return pivot.groupBy("material_type").agg(F.count("*").alias("n_materials"), *(F.count(c).alias(c.replace("description_", "has_")) for c in columns))


def search_descriptions(makt: DataFrame, pattern: str) -> DataFrame:
    """material_id, language, description of texts in any language that a regular expression finds, whatever the case."""
    return makt.where(F.col("maktx").rlike(f"(?i){pattern}")).select(F.col("matnr").alias("material_id"), F.col("spras").alias("language"), F.col("maktx").alias("description")).distinct()


def late_fusion(similarities: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """material_a, material_b, similarity: the weighted sum of similarities of pairs (material_a, material_b, similarity); a pair that one lacks is 0 in it."""
    parts = [df.select("material_a", "material_b", (F.col("similarity") * weight).alias("part")) for df, weight in similarities.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy("material_a", "material_b").agg(F.sum("part").alias("similarity"))
