"""The operators as functions of Spark SQL.

    register(spark, bom_table="bom_items", movements_table="goods_movements")
    spark.sql("SELECT * FROM find_similar_materials_jaccard('PUMP-A', 10, min_similarity => 0.2)")
    spark.sql("SELECT p.id, s.* FROM products p, LATERAL materials_sharing_components(p.id, 3) s")

They are SQL functions, so a call becomes part of the query's own plan: filters, pruning
and join strategies reach into it, and nothing runs in Python. A function reads the
tables that it was registered with; register() again, with a prefix, for other ones.
Those that also list materials of similarity 0 take constants; per row of a query,
materials_sharing_components lists the others.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from bomloom.sources.inputs import check_identifier

_SCALARS = {
    "jaccard_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(array_compact(a)) + size(array_compact(b)) = 0 THEN 0D ELSE size(array_intersect(array_compact(a), array_compact(b))) / size(array_union(array_compact(a), array_compact(b))) END",
    "dice_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(array_compact(a)) + size(array_compact(b)) = 0 THEN 0D ELSE 2D * size(array_intersect(array_compact(a), array_compact(b))) / (size(array_distinct(array_compact(a))) + size(array_distinct(array_compact(b)))) END",
    "l2sq_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> power(x - y, 2)), 0D, (s, x) -> s + x)",
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1 - coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D)",
}
_EDGES = "edges AS (SELECT DISTINCT CAST(parent_id AS STRING) AS p, CAST(child_id AS STRING) AS c FROM {bom} WHERE parent_id IS NOT NULL AND child_id IS NOT NULL)"
_SCORED = (
    _EDGES
    + """, own AS (SELECT c FROM edges WHERE p = query_material_id), counted AS (SELECT edges.p AS m, count(own.c) AS shared, count(*) AS size FROM edges LEFT JOIN own ON own.c = edges.c WHERE edges.p <> query_material_id GROUP BY edges.p),
scored AS (SELECT m, shared, size + n - shared AS total, CAST(shared / (size + n - shared) AS DOUBLE) AS s FROM counted JOIN (SELECT count(*) AS n FROM own) ON n > 0)"""
)
_HISTORY = "history AS (SELECT CAST(material_id AS STRING) AS m, min(CAST(movement_date AS DATE)) AS first_usage, max(CAST(movement_date AS DATE)) AS last_usage, (year(max(CAST(movement_date AS DATE))) - year(min(CAST(movement_date AS DATE)))) * 12L + month(max(CAST(movement_date AS DATE))) - month(min(CAST(movement_date AS DATE))) AS months FROM {movements} GROUP BY 1)"
#: Five levels below each material; those beyond iterations fall away when a call's plan is made.
_LEVELS = (
    "pairs AS (SELECT DISTINCT CAST(parent_id AS STRING) AS p, CAST(child_id AS STRING) AS c FROM {bom} WHERE parent_id IS NOT NULL), l1 AS (SELECT p AS m, c FROM pairs), "
    + ", ".join(f"l{d} AS (SELECT DISTINCT l{d - 1}.m, pairs.c FROM l{d - 1} JOIN pairs ON pairs.p = l{d - 1}.c WHERE iterations >= {d})" for d in range(2, 6))
    + ", prints AS (SELECT m, c, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT m, c FROM l{d}" for d in range(1, 6))
    + ") GROUP BY m, c)"
)
_TABLES = {
    "bom": {
        "find_similar_materials_jaccard(query_material_id STRING, k INT, min_similarity DOUBLE DEFAULT 0D) RETURNS TABLE (material_id STRING, similarity DOUBLE, shared_components BIGINT, total_components BIGINT)": f"WITH {_SCORED} SELECT m, s, shared, total FROM (SELECT *, row_number() OVER (ORDER BY s DESC, m) AS place FROM scored WHERE s >= min_similarity) WHERE place <= k",
        "materials_sharing_components(query_material_id STRING, k INT, min_similarity DOUBLE DEFAULT 0D) RETURNS TABLE (material_id STRING, similarity DOUBLE, shared_components BIGINT, total_components BIGINT)": f"WITH {_EDGES}, sizes AS (SELECT p, count(*) AS n FROM edges GROUP BY p), met AS (SELECT own.p AS q, other.p AS m, count(*) AS shared FROM edges own JOIN edges other ON own.c = other.c AND own.p <> other.p WHERE own.p = query_material_id GROUP BY own.p, other.p), scored AS (SELECT met.m, shared, x.n + y.n - shared AS total, CAST(shared / (x.n + y.n - shared) AS DOUBLE) AS s FROM met JOIN sizes x ON x.p = met.q JOIN sizes y ON y.p = met.m) SELECT m, s, shared, total FROM (SELECT *, row_number() OVER (ORDER BY s DESC, m) AS place FROM scored WHERE s >= min_similarity) WHERE place <= k",
        "aggregate_material_components() RETURNS TABLE (material_id STRING, components ARRAY<STRING>)": f"WITH {_EDGES} SELECT p, array_sort(collect_list(c)) FROM edges GROUP BY p",
        "wl_fingerprint(material STRING, iterations INT DEFAULT 3) RETURNS TABLE (component STRING, occurrence BIGINT)": f"WITH {_LEVELS} SELECT c, n FROM prints WHERE m = material",
        "find_similar_materials_wl_kernel(query_material_id STRING, k INT, iterations INT DEFAULT 3, min_similarity DOUBLE DEFAULT 0D) RETURNS TABLE (material_id STRING, similarity DOUBLE)": f"WITH {_LEVELS}, own AS (SELECT c, n FROM prints WHERE m = query_material_id), counted AS (SELECT prints.m, sum(prints.n) AS total, sum(CASE WHEN own.n IS NULL THEN 0 ELSE least(prints.n, own.n) END) AS common FROM prints LEFT JOIN own ON own.c = prints.c WHERE prints.m <> query_material_id GROUP BY prints.m), scored AS (SELECT m, CAST(common / (total + q - common) AS DOUBLE) AS s FROM counted CROSS JOIN (SELECT coalesce(sum(n), 0) AS q FROM own)) SELECT m, s FROM (SELECT *, row_number() OVER (ORDER BY s DESC, m) AS place FROM scored WHERE s >= min_similarity) WHERE place <= k",
    },
    "bom movements": {
        "cold_start_analogs(query_material_id STRING, k INT, min_history_months INT DEFAULT 0, min_similarity DOUBLE DEFAULT 0D) RETURNS TABLE (material_id STRING, similarity DOUBLE, shared_components BIGINT, total_components BIGINT, history_months BIGINT, first_usage DATE, last_usage DATE)": f"WITH {_SCORED}, {_HISTORY} SELECT m, s, shared, total, months, first_usage, last_usage FROM (SELECT scored.m, s, shared, total, coalesce(months, 0L) AS months, first_usage, last_usage, row_number() OVER (ORDER BY s DESC, scored.m) AS place FROM scored LEFT JOIN history ON history.m = scored.m WHERE s >= min_similarity AND coalesce(months, 0L) >= min_history_months) WHERE place <= k",
    },
    "movements": {
        "material_history() RETURNS TABLE (material_id STRING, first_usage DATE, last_usage DATE, history_months BIGINT)": f"WITH {_HISTORY} SELECT m, first_usage, last_usage, months FROM history",
    },
    "header component": {
        "bom_explosion_1level(material STRING) RETURNS TABLE (parent_material_id STRING, child_material_id STRING, quantity_per DOUBLE)": "SELECT h.parent_material_id, c.child_material_id, CAST(c.quantity_per AS DOUBLE) FROM {header} h JOIN {component} c ON c.bom_id = h.bom_id WHERE h.parent_material_id = material",
        "bom_where_used(material STRING) RETURNS TABLE (parent_material_id STRING, child_material_id STRING, quantity_per DOUBLE)": "SELECT h.parent_material_id, c.child_material_id, CAST(c.quantity_per AS DOUBLE) FROM {header} h JOIN {component} c ON c.bom_id = h.bom_id WHERE c.child_material_id = material",
        "bom_common_components(material_1 STRING, material_2 STRING) RETURNS TABLE (child_material_id STRING)": "SELECT c.child_material_id FROM {header} h JOIN {component} c ON c.bom_id = h.bom_id WHERE h.parent_material_id = material_1 INTERSECT SELECT c.child_material_id FROM {header} h JOIN {component} c ON c.bom_id = h.bom_id WHERE h.parent_material_id = material_2",
    },
}


def register(spark: SparkSession, bom_table: str | None = None, movements_table: str | None = None, header_table: str | None = None, component_table: str | None = None, prefix: str = "") -> list[str]:
    """Register, for this session, the scalar functions and those whose tables are given; returns the names. A function of the same name is replaced."""
    tables = {name: check_identifier(t, f"{name}_table") for name, t in (("bom", bom_table), ("movements", movements_table), ("header", header_table), ("component", component_table)) if t is not None}
    wanted = dict(_SCALARS)
    for needs, functions in _TABLES.items():
        if tables.keys() >= set(needs.split()):
            wanted |= {head: body.format(**tables) for head, body in functions.items()}
    for head, body in wanted.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
    return [prefix + head.split("(")[0] for head in wanted]
