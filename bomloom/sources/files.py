"""Bills of materials from files of other systems, by Spark's own readers: each gives parent_id, child_id, quantity.

Ids are taken as they are, trimmed. A line without a quantity, or with one that is no
number, counts 1; lines without a parent or child are left out. Files are read in
parallel; JSON and XML documents one after the other within a file's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of columns in exports, the first of which that a file has is read.
PARENT_NAMES = ["Number", "Parent", "ParentPartNumber", "Parent Part Number", "Assembly"]
CHILD_NAMES = ["ChildNumber", "Child", "ChildPartNumber", "Child Part Number", "Component"]
QUANTITY_NAMES = ["Quantity", "Qty", "QtyPer"]


def _edges(rows: DataFrame, parent: Column, child: Column, quantity: Column) -> DataFrame:
    text = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    out = rows.select(text(parent).alias("parent_id"), text(child).alias("child_id"), F.coalesce(quantity.cast("string").try_cast("double"), F.lit(1.0)).alias("quantity"))
    return out.dropna(subset=["parent_id", "child_id"])


def _quoted(text: Column, name: str) -> Column:
    """The value of a property in braces, of single or double quotes; null without one."""
    found = F.regexp_extract(text, rf"""\b{name}\s*:\s*("([^"]*)"|'([^']*)')""", 1)
    return F.when(found != "", F.substring(found, 2, 1 << 30).substr(F.lit(1), F.length(found) - 2))


def read_cypher(spark: SparkSession, path: str) -> DataFrame:
    """Edges of CREATE statements, one a line: nodes (v:Label {id: "..."}) and relations (whole)<-[:KIND {qty: 2}]-(part), or the other way round with an arrow to the right.

    A node's id is its id or number, else its variable. Variables hold within their file.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.col("line").rlike("^CREATE\\b"))
    node = r"^CREATE\s*\((\w+):\w+\s*\{([^}]*)\}\)"
    props = F.regexp_extract("line", node, 2)
    nodes = lines.where(F.col("line").rlike(node)).select("file", F.regexp_extract("line", node, 1).alias("v"), F.coalesce(_quoted(props, "id"), _quoted(props, "number")).alias("id"))
    nodes = nodes.groupBy("file", "v").agg(F.max("id").alias("id"))
    left, right = r"^CREATE\s*\((\w+)\)\s*<-\[:\w+\s*(\{[^}]*\})?\]-\s*\((\w+)\)", r"^CREATE\s*\((\w+)\)\s*-\[:\w+\s*(\{[^}]*\})?\]->\s*\((\w+)\)"
    to_left = F.col("line").rlike(left)
    at = lambda i, j: F.when(to_left, F.regexp_extract("line", left, i)).otherwise(F.regexp_extract("line", right, j))
    quantity = F.nullif(F.regexp_extract(at(2, 2), r"\bqty\s*:\s*([0-9.]+)", 1), F.lit(""))
    links = lines.where(to_left | F.col("line").rlike(right)).select("file", at(1, 3).alias("whole"), at(3, 1).alias("part"), quantity.alias("quantity"))
    for v in ("whole", "part"):
        links = links.join(nodes.select("file", F.col("v").alias(v), F.col("id").alias(f"{v}_id")), ["file", v], "left").withColumn(f"{v}_id", F.coalesce(f"{v}_id", v))
    return _edges(links, F.col("whole_id"), F.col("part_id"), F.col("quantity"))


def read_cyclonedx(spark: SparkSession, path: str) -> DataFrame:
    """Edges of CycloneDX documents, one or a list of them a file: the component of the metadata over the components, with the property that names a quantity."""
    part = "struct<`bom-ref`: string, name: string, properties: array<struct<name: string, value: string>>>"
    docs = spark.read.schema(f"metadata struct<component: struct<`bom-ref`: string, name: string>>, components array<{part}>").option("multiLine", True).json(path)
    rows = docs.select(F.coalesce(F.col("metadata.component.bom-ref"), F.col("metadata.component.name")).alias("parent"), F.explode("components").alias("c"))
    said = F.filter("c.properties", lambda x: F.lower(x["name"]).endswith(":quantity"))
    return _edges(rows, F.col("parent"), F.coalesce(F.col("c.bom-ref"), F.col("c.name")), F.get(said, F.lit(0))["value"])


def read_item_bills(spark: SparkSession, path: str) -> DataFrame:
    """Edges of JSON lists of records: those of the type BOM have an item and its items, each an item_code and a qty."""
    rows = spark.read.schema("doctype string, item string, items array<struct<item_code: string, qty: string>>").option("multiLine", True).json(path)
    rows = rows.where("doctype = 'BOM'").select("item", F.explode("items").alias("x"))
    return _edges(rows, F.col("item"), F.col("x.item_code"), F.col("x.qty"))


def read_record_xml(spark: SparkSession, path: str) -> DataFrame:
    """Edges of XML data files: record elements of the models mrp.bom (product_tmpl_id) and mrp.bom.line (bom_id, product_id, product_qty), whose fields refer to others by id."""
    records = spark.read.format("xml").schema("_id string, _model string, field array<struct<_name: string, _ref: string, _eval: string, _VALUE: string>>").option("rowTag", "record").load(path)

    def field(name: str) -> Column:
        x = F.get(F.filter("field", lambda f: f["_name"] == name), F.lit(0))
        return F.coalesce(x["_ref"], x["_eval"], x["_VALUE"])

    short = lambda c: F.element_at(F.split(c, "\\."), -1)
    heads = records.where("_model = 'mrp.bom'").select(short(F.col("_id")).alias("bill"), short(field("product_tmpl_id")).alias("parent"))
    heads = heads.groupBy("bill").agg(F.max("parent").alias("parent"))
    lines = records.where("_model = 'mrp.bom.line'").select(short(field("bom_id")).alias("bill"), short(field("product_id")).alias("child"), field("product_qty").alias("quantity"))
    rows = lines.join(heads, "bill")
    return _edges(rows, F.col("parent"), F.col("child"), F.col("quantity"))


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edges of CSV exports with a header, whose columns have one of several usual names."""
    rows = spark.read.option("header", True).csv(path)
    have = {c.lstrip("﻿").strip(): c for c in rows.columns}

    def first(names: list[str]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return _edges(rows, first(PARENT_NAMES), first(CHILD_NAMES), first(QUANTITY_NAMES))
