"""Queries over files of other systems, which are written from the driver's tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.plans.inputs import table
from bomloom.plans.registry import query
from bomloom.sources import files
from bomloom.sources.tables import shared_folder

#: Suppliers over parts, with a quantity that has two digits after the point; one of seven has none.
_LINES = "SELECT 'S' || l_suppkey AS parent_id, 'P' || l_partkey AS child_id, sum(CAST(l_quantity AS BIGINT)) % 400 / 4.0{d} AS q FROM lineitem GROUP BY l_suppkey, l_partkey"
_SQL = "WITH e AS (" + _LINES.format(d="::DOUBLE") + ") SELECT parent_id, child_id, CASE WHEN right(child_id, 1) = '7' THEN 1.0::DOUBLE ELSE q END AS quantity FROM e"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("bomloom_lineitem")
    return spark.sql(_LINES.format(d="D").replace("FROM lineitem", "FROM bomloom_lineitem")).withColumn("q", F.when(~F.col("child_id").endswith("7"), F.col("q")))


#: The parents whose lines are in one file: about as many files more as there are parents more.
_PARENTS = 100


def _by_file(e: DataFrame) -> DataFrame:
    """Edges with the number of the file that a parent's lines go to."""
    n = e.select(F.approx_count_distinct("parent_id")).first()[0]
    return e.withColumn("file", F.pmod(F.xxhash64("parent_id"), F.lit(max(4, -(-n // _PARENTS)))))


def _written(lines: DataFrame, *keys: str) -> str:
    """The path of text files; with keys, a file for each value of the first, whose lines are in the order of the others."""
    path = f"{shared_folder(lines.sparkSession)}/{uuid.uuid4().hex}"
    if keys:
        lines.repartition(keys[0]).sortWithinPartitions(*keys).select("value", keys[0]).write.partitionBy(keys[0]).text(path)
    else:
        lines.write.text(path)
    return path


@query(_SQL)
def read_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _by_file(_edges(spark, sf_dir))
    s, p, q = F.lower("parent_id"), F.lower("child_id"), F.coalesce(F.concat(F.lit(" {qty: "), "q", F.lit(', unit:"EA"}')), F.lit(""))
    # Variables hold within a file, so each has the nodes that its relations name.
    nodes = e.select("file", F.concat(F.lit("CREATE ("), s, F.lit(":Asset {id: '"), "parent_id", F.lit("'})")).alias("value")).distinct()
    nodes = nodes.unionAll(e.select("file", F.concat(F.lit("CREATE ("), p, F.lit(':Part {number:"'), "child_id", F.lit('", cost: 5.30})')).alias("value")).distinct())
    left = e.where("length(child_id) % 2 = 0").select("file", F.concat(F.lit("CREATE ("), s, F.lit(")<-[:BELONGS_TO"), q, F.lit("]-("), p, F.lit(")")).alias("value"))
    right = e.where("length(child_id) % 2 = 1").select("file", F.concat(F.lit("CREATE ("), p, F.lit(")-[:BELONGS_TO"), q, F.lit("]->("), s, F.lit(")")).alias("value"))
    return files.read_cypher(spark, _written(nodes.unionAll(left).unionAll(right), "file"))


@query(_SQL)
def read_cyclonedx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _by_file(_edges(spark, sf_dir))
    said = F.when(F.col("q").isNotNull(), F.array(F.struct(F.lit("cdx:device:quantity").alias("name"), F.col("q").cast("string").alias("value"))))
    part = F.struct(F.col("child_id").alias("bom-ref"), F.lit("a part").alias("name"), said.alias("properties"))
    docs = e.groupBy("file", "parent_id").agg(F.collect_list(part).alias("components"))
    doc = F.struct(F.struct(F.struct(F.col("parent_id").alias("bom-ref")).alias("component")).alias("metadata"), "components")
    return files.read_cyclonedx(spark, _written(docs.select("file", doc.alias("doc")).groupBy("file").agg(F.to_json(F.collect_list("doc")).alias("value")), "file"))


@query(_SQL)
def read_item_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _by_file(_edges(spark, sf_dir))
    bills = e.groupBy("file", "parent_id").agg(F.collect_list(F.struct(F.col("child_id").alias("item_code"), F.col("q").alias("qty"))).alias("items"))
    records = bills.select("file", F.struct(F.lit("BOM").alias("doctype"), F.col("parent_id").alias("item"), "items").alias("r"))
    return files.read_item_bills(spark, _written(records.groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value")), "file"))


@query(_SQL)
def read_record_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _by_file(_edges(spark, sf_dir))
    head = F.concat(F.lit("<record id='m.bom_"), "parent_id", F.lit("' model='mrp.bom'><field name='product_tmpl_id' ref='product."), "parent_id", F.lit("'/></record>"))
    quantity = F.coalesce(F.concat(F.lit("<field name='product_qty'>"), "q", F.lit("</field>")), F.lit(""))
    line = F.concat(F.lit("<record id='l_"), "parent_id", F.lit("_"), "child_id", F.lit("' model='mrp.bom.line'><field name='bom_id' ref='bom_"), "parent_id", F.lit("'/><field name='product_id' ref='"), "child_id", F.lit("'/>"), quantity, F.lit("</record>"))
    records = e.select("file", "parent_id").distinct().select("file", head.alias("value")).unionAll(e.select("file", line.alias("value"))).withColumn("part", F.lit(1))
    ends = F.array(F.struct(F.lit(0).alias("part"), F.lit("<odoo><data noupdate='1'>").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("</data></odoo>").alias("value")))
    records = records.unionByName(e.select("file").distinct().select("file", F.explode(ends).alias("x")).select("file", "x.*"))
    return files.read_record_xml(spark, _written(records, "file", "part"))


@query(_SQL)
def read_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e.select(F.col("parent_id").alias("Number"), F.concat(F.lit(" "), "child_id").alias("ChildNumber"), F.lit("x, y").alias("Note"), F.col("q").alias("Qty")).write.option("header", True).csv(path)
    return files.read_export_csv(spark, path)
