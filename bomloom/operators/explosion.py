"""Explosions of ERP bills of materials: one level with validity, the products on top, and all levels below them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.sources.tables import dropped, written

MAX_LEVELS = 20
_FOREVER = "9999-12-31"


def _levels(first: DataFrame, below: Callable[[DataFrame], DataFrame], max_levels: int) -> DataFrame:
    """first, which is read from a table, and what below() makes of each level, until a level is empty; each level is a table, made once."""
    level = out = first
    for _ in range(max_levels - 1):
        level = written(below(level))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def _reached(single: DataFrame, key: list[str], products: DataFrame, names: list[str], followed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(single's rows below products, once for each with its names, single's rows below what is followed), read from one table.

    products have names and, like followed, the columns of key. However many levels there
    are, single is made once and its rows are sent once, to where their key is marked.
    """
    named = products.groupBy(*key).agg(F.collect_list(F.struct(*names)).alias("_products"))
    marks = named.join(followed.select(*key).distinct().withColumn("_followed", F.lit(True)), key, "full")
    rows = written(single.join(marks, key).select(*single.columns, "_products", "_followed"))
    first = rows.select(*single.columns, F.explode("_products").alias("_product"))
    return first.select(*single.columns, *(F.col(f"_product.{c}").alias(c) for c in names)), rows.where("_followed").select(*single.columns)


def _until(rows: DataFrame, *key: str) -> DataFrame:
    """rows with date_to: where the next entry of their key begins, live entries before deleted ones."""
    follows = F.lead("datuv").over(Window.partitionBy(*key).orderBy("lkenz", "datuv"))
    return rows.withColumn("date_to", F.coalesce(follows, F.lit(_FOREVER).cast("date")))


def _marked(c: str) -> Column:
    return F.col(c).isNotNull().alias(c)


def _described(texts: DataFrame, language: str) -> DataFrame:
    return texts.where(F.col("spras") == language).groupBy("matnr").agg(F.min("maktx").alias("maktx"))


def sap_single_level(
    mast: DataFrame, stko: DataFrame, stas: DataFrame, stpo: DataFrame, mara: DataFrame, makt: DataFrame, on: Column, language: str = "EN", usages: tuple[str, ...] = ("2", "E", "V"), alternative: str = "01"
) -> DataFrame:
    """A row per parent, plant, usage and component that is valid on a date, with whether the component is an assembly, and one in force.

    An entry is valid until the next of its bill (or item) begins; deleted ones are not.
    Materials without a description in the language are left out, as are items of other
    than material bills. Dates are dates; a missing plant is XX00.
    """
    texts = _described(makt, language)
    heads = mast.where(F.col("stlan").isin(*usages) & (F.col("stlal") == alternative)).join(texts, "matnr").select("matnr", "maktx", F.coalesce("werks", F.lit("XX00")).alias("werks"), "stlan", "stlnr")
    bills = _until(stko.where((F.col("stlty") == "M") & (F.col("stlal") == alternative)).select("stlnr", _marked("lkenz"), "datuv"), "stlnr").where(~F.col("lkenz") & (F.col("date_to") >= on)).select("stlnr").distinct()
    # Of one alternative, an item's number is its key, by which it is joined as well.
    items = _until(stas.where((F.col("stlty") == "M") & (F.col("stlal") == alternative)).select("stlnr", "stlkn", _marked("lkenz"), "datuv"), "stlnr", "stlkn").where(~F.col("lkenz") & (F.col("date_to") >= on))
    lines = stpo.where(F.col("stlty") == "M").select("stlnr", "stlkn", "posnr", "postp", "idnrk", _marked("rekrs"), "menge", "meins")
    own = heads.select(F.col("matnr").alias("idnrk"), "werks", "stlan", F.col("stlnr").alias("idnrk_stlnr")).join(bills.select(F.col("stlnr").alias("idnrk_stlnr"), F.lit(True).alias("in_force")), "idnrk_stlnr", "left")
    own = own.groupBy("idnrk", "werks", "stlan").agg(F.max("idnrk_stlnr").alias("idnrk_stlnr"), F.max(F.coalesce("in_force", F.lit(False))).alias("in_force"))
    # What is known of components and of heads is brought together first, so that lines, of which there are most, are sent to each once.
    owns = own.groupBy("idnrk").agg(F.collect_list(F.struct("werks", "stlan", "idnrk_stlnr", "in_force")).alias("owns"))
    kinds = mara.select(F.col("matnr").alias("idnrk"), F.col("mtart").alias("idnrk_mtart"), F.col("matkl").alias("idnrk_matkl"))
    components = texts.select(F.col("matnr").alias("idnrk"), F.col("maktx").alias("idnrk_maktx")).join(kinds, "idnrk", "left").join(owns, "idnrk", "left")
    parents = heads.join(bills, "stlnr").join(mara.select("matnr", F.col("mtart").alias("mara_mtart"), F.col("matkl").alias("mara_matkl")), "matnr")
    out = lines.join(items.select("stlnr", "stlkn"), ["stlnr", "stlkn"]).join(components, "idnrk").join(parents, "stlnr")
    fits = lambda x: (x["werks"] == F.col("werks")) & (x["stlan"] == F.col("stlan"))
    out = out.withColumn("own", F.get(F.filter("owns", fits), F.lit(0))).withColumns({c: F.col(f"own.{c}") for c in ("idnrk_stlnr", "in_force")})
    return out.select(
        F.col("matnr").alias("mast_matnr"), F.col("maktx").alias("mast_maktx"), "mara_mtart", "mara_matkl", F.col("werks").alias("mast_werks"), F.col("stlan").alias("mast_stlan"), F.col("stlnr").alias("mast_stlnr"),
        F.col("posnr").alias("stpo_posnr"), F.col("postp").alias("stpo_postp"), F.col("idnrk").alias("stpo_idnrk"), "idnrk_maktx", "idnrk_mtart", "idnrk_matkl", F.coalesce("idnrk_stlnr", F.lit("00000000")).alias("idnrk_stlnr"),
        F.col("rekrs").alias("stpo_rekrs"), F.col("menge").alias("stpo_menge"), F.col("meins").alias("stpo_meins"), F.col("idnrk_stlnr").isNotNull().alias("is_assembly"), F.coalesce("in_force", F.lit(False)).alias("is_active_assembly"),
    )


def sap_collector(mara: DataFrame, mast: DataFrame, makt: DataFrame, language: str = "EN", usage: str = "2") -> DataFrame:
    """All described materials with plant, alternative and usage of their production bills; XX00, X0 and X where there is none."""
    bills = mast.where(F.col("stlan") == usage).select("matnr", "werks", "stlal", "stlan")
    rows = mara.select("matnr", "zzut", "mtart").join(bills, "matnr", "left").join(_described(makt, language), "matnr")
    given = lambda c, otherwise: F.coalesce(c, F.lit(otherwise)).alias(f"matnr_collector_{c}")
    return rows.select(F.col("matnr").alias("matnr_collector"), F.col("maktx").alias("matnr_collector_maktx"), F.col("zzut").alias("matnr_collector_zzut"), F.col("mtart").alias("matnr_collector_mtart"), given("werks", "XX00"), given("stlal", "X0"), given("stlan", "X"))


def sap_explosion(single: DataFrame, collector: DataFrame, kinds: tuple[str, ...] = ("01", "11"), max_levels: int = MAX_LEVELS) -> DataFrame:
    """The single level's rows below each product of the collector, level by level within its plant and usage.

    Components are followed while they are assemblies in force and not recursive; a path
    ends after max_levels, so that cycles do.
    """
    top = ["matnr_collector", "matnr_collector_maktx", "matnr_collector_werks", "matnr_collector_stlan"]
    key, single = ["mast_matnr", "mast_werks", "mast_stlan"], written(single)
    columns = single.drop("mast_werks", "mast_stlan").columns
    products = collector.where(F.col("matnr_collector_zzut").isin(*kinds)).select(*(F.col(f"matnr_collector{a}").alias(c) for a, c in zip(("", "_werks", "_stlan"), key, strict=True)), *top[:2])
    walked = F.expr("is_active_assembly AND NOT stpo_rekrs")
    first, lower = _reached(single, key, products, top[:2], single.where(walked).select(F.col("stpo_idnrk").alias("mast_matnr"), "mast_werks", "mast_stlan"))
    dropped(single)
    first = first.select(F.lit(1).alias("nodelevel"), *top[:2], F.col("mast_werks").alias(top[2]), F.col("mast_stlan").alias(top[3]), *columns)

    def below(level: DataFrame) -> DataFrame:
        followed = level.where(walked).select((F.col("nodelevel") + 1).alias("nodelevel"), *top, F.col("stpo_idnrk").alias("_parent"))
        of = (lower["mast_matnr"] == F.col("_parent")) & (lower["mast_werks"] == F.col("matnr_collector_werks")) & (lower["mast_stlan"] == F.col("matnr_collector_stlan"))
        return followed.join(lower, of).select("nodelevel", *top, *columns)

    return _levels(first, below, max_levels)


def _in_force(df: DataFrame, on: Column, open_start: bool) -> DataFrame:
    begun = F.col("valid_from_date") <= on
    return df.where((begun | F.col("valid_from_date").isNull()) if open_start else begun).where(F.col("valid_to_date").isNull() | (F.col("valid_to_date") >= on))


def d365_versions(versions: DataFrame, on: Column) -> DataFrame:
    return _in_force(versions.where("is_active AND is_approved"), on, False)


def d365_single_level(versions: DataFrame, lines: DataFrame, items: DataFrame, on: Column) -> DataFrame:
    """A row per parent and component of the versions in force on a date; a phantom line (type 1) is no assembly to follow."""
    heads = d365_versions(versions, on).select("bom_id", F.col("item_id").alias("parent_item_id"), "data_area_id")
    names = lambda of: items.select(F.col("item_id").alias(f"{of}_item_id"), F.col("item_name").alias(f"{of}_item_name"), F.col("item_type").alias(f"{of}_item_type"), F.col("item_group_id").alias(f"{of}_item_group_id"), "data_area_id")
    own = heads.select(F.col("parent_item_id").alias("component_item_id"), "data_area_id", F.lit(True).alias("is_assembly")).distinct()
    valid = _in_force(lines, on, True).select("bom_id", "data_area_id", "line_num", "position", "bom_type", F.col("item_id").alias("component_item_id"), "bom_qty", "bom_qty_serie", "unit_id")
    # Lines, of which there are most, are sent to their component and to their head, once each.
    parts = valid.join(names("component"), ["component_item_id", "data_area_id"], "left").join(own, ["component_item_id", "data_area_id"], "left")
    out = parts.join(heads.join(names("parent"), ["parent_item_id", "data_area_id"]), ["bom_id", "data_area_id"])
    assembly, phantom = F.coalesce("is_assembly", F.lit(False)), F.coalesce(F.col("bom_type") == 1, F.lit(False))
    return out.select(
        "parent_item_id", "parent_item_name", "bom_id", "line_num", "position", "bom_type", "component_item_id", "component_item_name", "component_item_type", "component_item_group_id", "bom_qty", "bom_qty_serie", "unit_id",
        assembly.alias("is_assembly"), (assembly & F.coalesce(F.col("bom_type") != 1, F.lit(False))).alias("is_active_assembly"), phantom.alias("is_phantom"), "data_area_id",
    )


def d365_collector(items: DataFrame, versions: DataFrame, on: Column) -> DataFrame:
    """All items, with whether they have a version in force."""
    own = d365_versions(versions, on).select("item_id", "data_area_id", F.lit(True).alias("has")).distinct()
    named = items.join(own, ["item_id", "data_area_id"], "left")
    return named.select(F.col("item_id").alias("collector_item_id"), F.col("item_name").alias("collector_item_name"), F.col("data_area_id").alias("collector_data_area_id"), F.coalesce("has", F.lit(False)).alias("has_active_bom"))


def d365_explosion(single: DataFrame, collector: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """The rows below each item with a version in force, with extended_qty (the product of quantity over series along the path) and hierarchy_path.

    A path never meets an item twice; a series of 0 makes the quantity null.
    """
    top = ["collector_item_id", "collector_item_name", "collector_data_area_id"]
    own = F.col("bom_qty") / F.nullif(F.col("bom_qty_serie"), F.lit(0))
    key, single = ["parent_item_id", "data_area_id"], written(single)
    products = collector.where("has_active_bom").select(F.col("collector_item_id").alias("parent_item_id"), F.col("collector_data_area_id").alias("data_area_id"), "collector_item_name")
    walked = F.expr("is_active_assembly AND NOT is_phantom")
    first, lower = _reached(single, key, products, ["collector_item_name"], single.where(walked).select(F.col("component_item_id").alias("parent_item_id"), "data_area_id"))
    dropped(single)
    first = first.withColumns({"collector_item_id": F.col("parent_item_id"), "collector_data_area_id": F.col("data_area_id")})
    first = first.select(F.lit(1).alias("nodelevel"), *top, *single.columns, own.alias("extended_qty"), F.array("collector_item_id", "component_item_id").alias("nodes"))

    def below(level: DataFrame) -> DataFrame:
        followed = level.where(walked).select((F.col("nodelevel") + 1).alias("nodelevel"), *top, F.col("component_item_id").alias("_parent"), F.col("extended_qty").alias("_qty"), F.col("nodes").alias("_nodes"))
        met = (lower["parent_item_id"] == F.col("_parent")) & (lower["data_area_id"] == F.col("collector_data_area_id"))
        step = followed.join(lower, met).where(~F.array_contains("_nodes", F.col("component_item_id")))
        return step.select("nodelevel", *top, *single.columns, (F.col("_qty") * own).alias("extended_qty"), F.concat("_nodes", F.array("component_item_id")).alias("nodes"))

    found = _levels(first, below, max_levels)
    return found.withColumn("hierarchy_path", F.array_join("nodes", " > ")).drop("nodes")
