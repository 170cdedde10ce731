"""ERP extracts to the canonical tables, and between edge lists and the universal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bomloom.sources import schemas
from bomloom.sources.inputs import default


def _compact_date(c: str | Column) -> Column:
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit("yyyyMMdd")).cast("date")


def _one(texts: DataFrame, language: str, *columns: str) -> DataFrame:
    """One description (the least) of each material in a language."""
    own = texts.where(F.col("spras") == language)
    return own.groupBy(F.trim("matnr").alias("material_id")).agg(*(F.min(F.trim(c)).alias(c) for c in columns))


def sap_to_materials(mara: DataFrame) -> DataFrame:
    live = mara.where("lvorm IS NULL OR trim(lvorm) = ''")
    return live.select(F.trim("matnr").alias("material_id"), F.col("mtart").alias("material_type"), F.col("matkl").alias("material_group"), F.lit("").alias("description"), _compact_date("ersda").alias("created_date"))


def sap_to_materials_with_desc(mara: DataFrame, makt: DataFrame, language: str = "E") -> DataFrame:
    out = sap_to_materials(mara).drop("description").join(_one(makt, language, "maktx"), "material_id", "left")
    return out.select("material_id", "material_type", "material_group", F.coalesce("maktx", F.lit("")).alias("description"), "created_date")


def extract_material_descriptions(makt: DataFrame, language: str = "EN") -> DataFrame:
    out = _one(makt, language, "maktx", "maktg").where("maktx IS NOT NULL OR maktg IS NOT NULL")
    return out.select("material_id", F.concat_ws(" ", "maktx", "maktg").alias("full_text"))


def _either_date(c: str | Column) -> Column:
    """A date written as 20240101 or as 2024-01-01; anything else is null."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(_compact_date(text), text.try_cast("date"))


def sap_to_bom_items(mast: DataFrame, stko: DataFrame, stpo: DataFrame, bom_alternative: str | None = "01", reference_date: str | None = "9999-12-31", bom_usage: str | None = None) -> DataFrame:
    """The components of the newest header, at a date, of each material's bills under an alternative.

    A missing alternative or date means its default. The date may be compact or ISO; to
    one that is neither no dated header is due. bom_usage is accepted and has no effect.
    """
    due = _either_date("datuv") <= _either_date(F.lit(default(reference_date, "9999-12-31")))
    newest = Window.partitionBy("parent_id", "bom_id", "bom_version").orderBy(F.col("datuv").desc_nulls_first())
    heads = stko.where(F.col("datuv").isNull() | due).select(F.col("stlnr").alias("bom_id"), F.col("stlal").alias("bom_version"), "datuv")
    heads = heads.where(F.col("bom_version") == default(bom_alternative, "01")).join(mast.select(F.trim("matnr").alias("parent_id"), F.col("stlnr").alias("bom_id")), "bom_id")
    heads = heads.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    lines = stpo.select(F.col("stlnr").alias("bom_id"), F.trim("idnrk").alias("child_id"), F.col("menge").alias("qty"), F.col("meins").alias("unit"))
    return heads.join(lines, "bom_id").select("bom_id", "parent_id", "child_id", "qty", "unit", _either_date("datuv").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_to"), "bom_version")


def _table(df: DataFrame, schema: StructType, **values: Column) -> DataFrame:
    """Columns of a schema: the given ones as they are, null ones of its types for the rest, and the time of creation."""
    now = {"created_at": F.current_timestamp()}
    return df.select(*((now | values).get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def dynamics365_to_materials(invent: DataFrame) -> DataFrame:
    kind = F.col("ItemType")
    return _table(
        invent, schemas.MATERIALS, material_id=F.col("ItemId"), material_number=F.col("ItemId"), description=F.col("ItemName"),
        material_type=F.when(kind == 0, "ASSEMBLY").when(kind == 1, "FINISHED").when(kind == 2, "COMPONENT").otherwise("OTHER"),
        base_uom=F.lit("EA"), source_system=F.lit("DYNAMICS365"), is_active=F.lit(True),
    )


def dynamics365_to_bom_header(bom_table: DataFrame, bom_version: DataFrame) -> DataFrame:
    """Headers in use, once for each of their versions; without one, with nulls for it."""
    versions = bom_version.select("BOMId", "VersionId", "ActivationDate", "ApprovedStatus")
    return _table(
        bom_table.where("Status = 0").select("BOMId", "ItemId").join(versions, "BOMId", "left"), schemas.BOM_HEADER,
        bom_id=F.col("BOMId"), source_system=F.lit("DYNAMICS365"), source_bom_id=F.col("BOMId"), parent_material_id=F.col("ItemId"), bom_type=F.lit("MANUFACTURING"), alternative_number=F.lit("01"), revision=F.col("VersionId"),
        base_quantity=F.lit(1), base_uom=F.lit("EA"), valid_from=F.col("ActivationDate").cast("date"), is_approved=F.coalesce(F.col("ApprovedStatus") == 1, F.lit(False)),
    )


def dynamics365_to_bom_component(bom_lines: DataFrame) -> DataFrame:
    return _table(
        bom_lines, schemas.BOM_COMPONENT, component_id=F.concat(F.lit("COMP_"), "BOMId", F.lit("_"), F.col("LineNum").cast("string")), bom_id=F.col("BOMId"), line_number=F.col("LineNum"), child_material_id=F.col("ItemId"),
        quantity_per=F.col("Quantity"), quantity_uom=F.lit("EA"), is_fixed_quantity=F.lit(False), scrap_percent=F.coalesce(F.col("ScrapPercent"), F.lit(0)), component_type=F.lit("STOCK"), supply_type=F.lit("PUSH"),
        operation_sequence=F.col("LineNum"), is_alternative=F.lit(False),
    )


def bom_to_items(header: DataFrame, component: DataFrame) -> DataFrame:
    lines = component.select("bom_id", F.col("child_material_id").alias("child_id"), F.col("quantity_per").alias("quantity"))
    return header.select("bom_id", F.col("parent_material_id").alias("parent_id")).join(lines, "bom_id").select("parent_id", "child_id", "quantity")


def items_to_tables(items: DataFrame, source_system: str = "MIGRATED") -> dict[str, DataFrame]:
    """Typed materials, bom_header and bom_component of an edge list."""
    ids = items.select(F.explode(F.array("parent_id", "child_id")).alias("id")).distinct()
    numbered = items.withColumn("rn", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.asc_nulls_last("child_id"))))
    bom_id, system = F.concat(F.lit("BOM_"), "parent_id"), F.lit(source_system)
    return {
        "materials": _table(ids, schemas.MATERIALS, material_id=F.col("id"), material_number=F.col("id"), description=F.lit(""), base_uom=F.lit("EA"), source_system=system, is_active=F.lit(True)),
        "bom_header": _table(
            items.select("parent_id").distinct(), schemas.BOM_HEADER, bom_id=bom_id, source_system=system, source_bom_id=F.col("parent_id"), parent_material_id=F.col("parent_id"), bom_type=F.lit("MANUFACTURING"),
            alternative_number=F.lit("01"), revision=F.lit("MIGRATED"), base_quantity=F.lit(1), base_uom=F.lit("EA"), valid_from=F.lit("2024-01-01").cast("date"), is_approved=F.lit(True),
        ),
        "bom_component": _table(
            numbered, schemas.BOM_COMPONENT, component_id=F.concat(F.lit("COMP_"), "parent_id", F.lit("_"), F.col("rn").cast("string")), bom_id=bom_id, line_number=F.col("rn"), child_material_id=F.col("child_id"),
            quantity_per=F.coalesce("quantity", F.lit(1)), quantity_uom=F.lit("EA"), is_fixed_quantity=F.lit(False), scrap_percent=F.lit(0), component_type=F.lit("STOCK"), supply_type=F.lit("PUSH"), is_alternative=F.lit(False),
        ),
    }


def items_to_bom(items: DataFrame, source_system: str = "MIGRATED") -> DataFrame:
    """The three tables as one of strings: table_type, then their columns by place, under the names of the materials' and col13 to col16.

    A header has no column for its system here: what follows stands one place further to the left.
    """
    parts = items_to_tables(items, source_system)
    parts["bom_header"] = parts["bom_header"].drop("source_system")
    width = len(schemas.BOM_COMPONENT)
    names = [f.name for f in schemas.MATERIALS]
    names += [f"col{i}" for i in range(len(names) + 1, width + 1)]
    out = None
    for kind, df in parts.items():
        cells = [F.col(c).cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (width - len(df.columns))
        rows = df.select(F.lit(kind).alias("table_type"), *(c.alias(n) for c, n in zip(cells, names, strict=True)))
        out = rows if out is None else out.unionAll(rows)
    return out
