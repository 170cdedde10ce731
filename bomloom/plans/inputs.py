"""The driver's tables as bills of materials, movements and descriptions, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over the parts that they ordered."""
    lines, orders = (table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.concat(F.lit("C"), "o_custkey").alias("parent_id"), F.concat(F.lit("P"), "l_partkey").alias("child_id")).distinct()


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("parent_id"), F.concat(F.lit("P"), "l_partkey").alias("child_id"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers over their parts."""
    return _supplied(spark, sf_dir).distinct()


def dag(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Regions over nations over suppliers over parts over brands; with repeats, a supplier's part comes as often as it was supplied."""
    t = {n: table(spark, sf_dir, n) for n in ("nation", "supplier", "part")}
    link = lambda df, a, p, b, c: df.select(F.concat(F.lit(a), p).alias("parent_id"), F.concat(F.lit(b), c).alias("child_id"))
    out = link(t["nation"], "R", "n_regionkey", "N", "n_nationkey").unionAll(link(t["supplier"], "N", "s_nationkey", "S", "s_suppkey"))
    return out.unionAll((_supplied if repeats else suppliers)(spark, sf_dir)).unionAll(link(t["part"], "P", "p_partkey", "", "p_brand"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of suppliers."""
    kind = F.when(F.col("l_returnflag") == "A", "261").when(F.col("l_returnflag") == "R", "262").otherwise("311")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("material_id"), F.col("l_shipdate").cast("date").alias("movement_date"), F.col("l_quantity").alias("quantity"), kind.alias("movement_type"))


def makt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions in languages."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("matnr"), F.col("lang").alias("spras"), F.col("text").alias("maktx"), F.col("source").alias("maktg"))


#: ERP extracts made of the driver's tables, in SQL that Spark and DuckDB read alike. Some rows lack a plant, a description or an approval, are deleted, or are written oddly.
ERP = {
    "mara": "SELECT concat(' P', p_partkey, ' ') AS matnr, p_type AS mtart, p_brand AS matkl, CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE concat('202', p_partkey % 5, '0', 1 + p_partkey % 9, '15') END AS ersda, CASE p_partkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE NULL END AS lvorm FROM {part}",
    "makt_of_parts": "SELECT concat('P', p_partkey, ' ') AS matnr, CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE 'D' END AS spras, concat(p_name, ' ') AS maktx FROM {part} WHERE p_partkey % 11 <> 0 UNION ALL SELECT concat('P', p_partkey), 'E', upper(p_name) FROM {part} WHERE p_partkey % 3 = 0",
    "mast": "SELECT concat('S', s_suppkey, ' ') AS matnr, concat('0', s_suppkey) AS stlnr FROM {supplier}",
    "stko": "SELECT concat('0', l_suppkey) AS stlnr, concat('0', l_linenumber) AS stlal, CASE WHEN l_linenumber = 3 THEN cast(max(cast(l_shipdate AS date)) AS string) ELSE replace(cast(max(cast(l_shipdate AS date)) AS string), '-', '') END AS datuv FROM {lineitem} GROUP BY l_suppkey, l_linenumber, year(l_shipdate)",
    "stpo": "SELECT concat('0', l_suppkey) AS stlnr, concat(' ', l_partkey) AS stlkn, concat(' P', l_partkey, ' ') AS idnrk, sum(l_quantity) AS menge, CASE WHEN l_partkey % 2 = 0 THEN 'EA' ELSE 'KG' END AS meins FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    "invent": "SELECT concat('P', p_partkey) AS ItemId, p_name AS ItemName, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_partkey % 5 END AS ItemType FROM {part}",
    "bom_table": "SELECT concat('B', s_suppkey) AS BOMId, concat('S', s_suppkey) AS ItemId, cast(s_suppkey % 3 = 1 AS int) AS Status FROM {supplier}",
    "bom_version": "SELECT concat('B', l_suppkey) AS BOMId, cast(l_linenumber AS string) AS VersionId, min(l_shipdate) AS ActivationDate, CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE l_linenumber % 3 END AS ApprovedStatus FROM {lineitem} WHERE l_suppkey % 5 <> 0 GROUP BY l_suppkey, l_linenumber",
    "bom_lines": "SELECT concat('B', l_suppkey) AS BOMId, cast(l_partkey AS int) AS LineNum, concat('P', l_partkey) AS ItemId, sum(l_quantity) AS Quantity, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE max(l_tax) END AS ScrapPercent FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    # Suppliers are products over parts; every tenth part is an assembly of others, some of which contain each other.
    "heads": "SELECT concat('S', s_suppkey) AS matnr, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'W1' END AS werks, CASE WHEN s_suppkey % 9 = 8 THEN 'Z' ELSE '2' END AS stlan, concat('B', s_suppkey) AS stlnr, '01' AS stlal FROM {supplier} UNION ALL SELECT concat('P', p_partkey), CASE WHEN p_partkey % 30 = 0 THEN NULL ELSE 'W1' END, '2', concat('Q', p_partkey), '01' FROM {part} WHERE p_partkey % 10 = 0",
    "bills": "SELECT 'M' AS stlty, concat('B', s_suppkey) AS stlnr, '01' AS stlal, date '2020-01-01' AS datuv, cast(NULL AS string) AS lkenz FROM {supplier} UNION ALL SELECT 'M', concat('B', s_suppkey), '01', date '2023-06-01', 'X' FROM {supplier} WHERE s_suppkey % 6 = 5 UNION ALL SELECT CASE WHEN p_partkey % 70 = 0 THEN 'D' ELSE 'M' END, concat('Q', p_partkey), '01', date '2021-01-01', cast(NULL AS string) FROM {part} WHERE p_partkey % 10 = 0",
    "lines": "SELECT concat('B', l_suppkey) AS stlnr, concat('K', l_partkey) AS stlkn, min(l_linenumber) AS posnr, 'L' AS postp, concat('P', l_partkey) AS idnrk, CASE WHEN l_partkey % 40 = 0 THEN 'X' ELSE cast(NULL AS string) END AS rekrs, max(l_quantity) AS menge, 'EA' AS meins FROM {lineitem} GROUP BY l_suppkey, l_partkey UNION ALL SELECT concat('Q', p_partkey), concat('K', p_partkey + 1), 1, 'L', concat('P', p_partkey + 1), NULL, 2.0, 'EA' FROM {part} WHERE p_partkey % 10 = 0 UNION ALL SELECT concat('Q', p_partkey), concat('K', p_partkey + 10), 2, 'L', concat('P', CASE WHEN p_partkey % 50 = 40 THEN p_partkey - 40 ELSE p_partkey + 10 END), NULL, 0.5, 'KG' FROM {part} WHERE p_partkey % 10 = 0",
    "nodes": "SELECT concat('S', s_suppkey) AS matnr, 'FERT' AS mtart, 'G1' AS matkl, CASE WHEN s_suppkey % 2 = 0 THEN '01' ELSE '02' END AS zzut, s_name AS name FROM {supplier} UNION ALL SELECT concat('P', p_partkey), 'HALB', p_brand, '11', p_name FROM {part} WHERE p_partkey % 13 <> 12",
}


def erp(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An ERP extract by its name in ERP."""
    return spark.sql(ERP[name], **{t: table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem") if f"{{{t}}}" in ERP[name]})


#: The same relations as common table expressions.
SQL = {
    "baskets": "SELECT DISTINCT 'C' || o_custkey AS parent_id, 'P' || l_partkey AS child_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "suppliers": "SELECT DISTINCT 'S' || l_suppkey AS parent_id, 'P' || l_partkey AS child_id FROM lineitem",
    "dag": "SELECT 'R' || n_regionkey AS parent_id, 'N' || n_nationkey AS child_id FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem UNION ALL SELECT 'P' || p_partkey, p_brand FROM part",
    "movements": "SELECT 'S' || l_suppkey AS material_id, l_shipdate::DATE AS movement_date, l_quantity AS quantity, CASE l_returnflag WHEN 'A' THEN '261' WHEN 'R' THEN '262' ELSE '311' END AS movement_type FROM lineitem",
    "makt": "SELECT doc_id::VARCHAR AS matnr, lang AS spras, text AS maktx, source AS maktg FROM documents",
}


SQL |= {name: text.format(part="part", supplier="supplier", lineitem="lineitem") for name, text in ERP.items()}


def with_sql(body: str, *names: str, recursive: bool = False) -> str:
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' * recursive}{head}{', ' * bool(names)}{body}"
