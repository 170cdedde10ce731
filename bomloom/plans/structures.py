"""Queries over whole structures: total quantities, cycles and families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.operators import families, quantities, truth
from bomloom.plans import queries as base
from bomloom.plans.inputs import baskets, dag, erp, table, with_sql
from bomloom.plans.registry import query

_QUANTITY = "1 + length(child_id) % 3 + 0.5::DOUBLE"
_PATHS = "e AS (SELECT parent_id AS p, child_id AS c, sum(" + _QUANTITY + ") AS q FROM dag GROUP BY ALL), w AS (SELECT p AS root, c, q FROM e UNION ALL SELECT root, e.c, w.q * e.q FROM w JOIN e ON w.c = e.p) SELECT root AS material_id, c AS component, sum(q) AS quantity FROM w GROUP BY ALL"


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag(spark, sf_dir).withColumn("quantity", 1 + F.length("child_id") % 3 + 0.5)


@query(with_sql(_PATHS, "dag", recursive=True))
def total_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all components below all regions, nations, suppliers and parts; quantities are halves and products of them, so sums are exact."""
    return quantities.total_quantities(_weighted(spark, sf_dir))


def _assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and assemblies over parts, some of which contain each other."""
    heads, lines = erp(spark, sf_dir, "heads"), erp(spark, sf_dir, "lines")
    return heads.join(lines, "stlnr").select(F.col("matnr").alias("parent_id"), F.col("idnrk").alias("child_id"), F.col("menge").cast("double").alias("quantity"))


_BELOW = "e AS (SELECT DISTINCT matnr AS p, idnrk AS c FROM heads JOIN lines USING (stlnr)), asm AS (SELECT e.* FROM e WHERE p LIKE 'P%' AND c IN (SELECT p FROM e)), r AS (SELECT p, c FROM asm UNION SELECT r.p, asm.c FROM r JOIN asm ON r.c = asm.p), loop AS (SELECT DISTINCT p FROM r WHERE p = c), bad AS (SELECT p FROM loop UNION SELECT r.p FROM r WHERE c IN (SELECT p FROM loop) UNION SELECT e.p FROM e WHERE c IN (SELECT p FROM loop) OR c IN (SELECT r.p FROM r WHERE c IN (SELECT p FROM loop)))"
#: On a cycle, or between two: there is a way from a cycle to it, and one from it to a cycle.
_CYCLIC = _BELOW + " SELECT p AS material_id, p IN (SELECT p FROM loop) OR (p IN (SELECT r.c FROM r WHERE r.p IN (SELECT p FROM loop)) AND p IN (SELECT r.p FROM r WHERE r.c IN (SELECT p FROM loop))) AS on_cycle FROM bad"


@query(with_sql(_CYCLIC, "heads", "lines", recursive=True))
def materials_without_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.materials_without_totals(_assemblies(spark, sf_dir))


_KINDS = "s AS (SELECT DISTINCT p_brand || '/' || p_size AS p, p_type AS c FROM part), n AS (SELECT p, count(*) AS n FROM s GROUP BY 1), j AS (SELECT a.p AS a, b.p AS b FROM s a JOIN s b ON a.c = b.c AND a.p <> b.p JOIN n x ON x.p = a.p JOIN n y ON y.p = b.p GROUP BY a.p, b.p, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.6), r AS (SELECT p AS a, p AS b FROM n UNION SELECT r.a, j.b FROM r JOIN j ON r.b = j.a), f AS (SELECT a AS material_id, min(b) AS family_id FROM r GROUP BY 1) SELECT material_id, family_id, count(*) OVER (PARTITION BY family_id) AS size FROM f"


@query(with_sql(_KINDS, recursive=True))
def product_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and sizes over the types that they come in."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("parent_id"), F.col("p_type").alias("child_id"))
    return families.product_families(spark, parts, 0.6)


_DRAWN = f"m AS (SELECT parent_id AS id, row_number() OVER (ORDER BY parent_id) - 1 AS place FROM (SELECT DISTINCT parent_id FROM baskets)), t AS (SELECT count(*) * (count(*) - 1) // 2 AS total FROM m), q AS (SELECT {base._HASH.format(x="'42:' || i")} % total AS number, min(i) AS i FROM range(9000) r(i), t GROUP BY 1 ORDER BY min(i) LIMIT 3000), w AS (SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.place < y.place JOIN q ON q.number = y.place * (y.place - 1) // 2 + x.place), n AS (SELECT parent_id, count(*) AS n FROM baskets GROUP BY 1), g AS (SELECT a, b, (SELECT count(*) FROM baskets c JOIN baskets d ON c.child_id = d.child_id WHERE c.parent_id = a AND d.parent_id = b) AS shared FROM w), s AS (SELECT a, b, shared, shared::DOUBLE / (k.n + l.n - shared) AS similarity FROM g JOIN n k ON k.parent_id = a JOIN n l ON l.parent_id = b)"


@query(with_sql(_DRAWN + f" SELECT a AS material_a, b AS material_b, shared AS shared_components, similarity, {base._RELATION.format(s='similarity')} AS relationship_type FROM s", "baskets"))
def sampled_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing is the operator: 3,000 of all pairs of customers."""
    return truth.sampled_ground_truth(baskets(spark, sf_dir), 3000)
