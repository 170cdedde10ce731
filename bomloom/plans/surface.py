"""Queries through the functions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bomloom import sql
from bomloom.plans import queries as base
from bomloom.plans.inputs import dag, movements, suppliers, table, with_sql
from bomloom.plans.registry import query


def _registered(spark: SparkSession, sf_dir: str) -> None:
    for name, view in (("suppliers", suppliers), ("movements", movements), ("dag", dag)):
        view(spark, sf_dir).createOrReplaceTempView(f"bomloom_{name}")
    sql.register(spark, "bomloom_suppliers", "bomloom_movements", prefix="supplier_")
    sql.register(spark, "bomloom_dag", prefix="dag_")


_HUNDREDTH = base._HUNDREDTH


@query(base._best("suppliers", "q.parent_id = 'S1'", 0.01, 10))
def sql_similar_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _registered(spark, sf_dir)
    return spark.sql("SELECT 'S1' AS query_id, * FROM supplier_find_similar_materials_jaccard('S1', 10, min_similarity => 0.01)")


@query(base._best("suppliers", f"regexp_matches(q.parent_id, '{_HUNDREDTH}')", 0.001, 5))
def sql_materials_sharing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    _registered(spark, sf_dir)
    return spark.sql(f"SELECT q.id AS query_id, s.* FROM (SELECT DISTINCT parent_id AS id FROM bomloom_suppliers WHERE parent_id RLIKE '{_HUNDREDTH}') q, LATERAL supplier_materials_sharing_components(q.id, 5) s")


@query(base._analogs("q.parent_id = 'S1'"))
def sql_cold_start_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _registered(spark, sf_dir)
    return spark.sql("SELECT 'S1' AS query_id, * FROM supplier_cold_start_analogs('S1', 10, min_history_months => 12)")


@query(with_sql(base._LEVELS.format(t="dag", n=3) + " SELECT component, occurrence FROM fp WHERE material_id = 'N1'", "dag", recursive=True))
def sql_wl_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    _registered(spark, sf_dir)
    return spark.sql("SELECT * FROM dag_wl_fingerprint('N1')")


@query(base._wl_best("SELECT 'N1' AS material_id", 10))
def sql_similar_wl(spark: SparkSession, sf_dir: str) -> DataFrame:
    _registered(spark, sf_dir)
    return spark.sql("SELECT 'N1' AS query_id, * FROM dag_find_similar_materials_wl_kernel('N1', 10)")


@query(f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.v AS av, b.v AS bv, a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT x, y, round({base._COSINE.replace('a.v', 'av').replace('b.v', 'bv')}, 6) AS cosine, round({base._L2.replace('a.v', 'av').replace('b.v', 'bv')}, 6) AS l2 FROM p")
def sql_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector to the next one."""
    _registered(spark, sf_dir)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("bomloom_vectors")
    return spark.sql("SELECT a.vec_id AS x, b.vec_id AS y, round(dag_cosine_distance(a.embedding, b.embedding), 6) AS cosine, round(dag_l2sq_distance(a.embedding, b.embedding), 6) AS l2 FROM bomloom_vectors a JOIN bomloom_vectors b ON b.vec_id = a.vec_id + 1")


@query("WITH s AS (SELECT p_brand, list(DISTINCT p_type) AS a, list(DISTINCT p_type) FILTER (p_size > 25) AS b FROM part GROUP BY 1) SELECT p_brand, CASE WHEN b IS NULL THEN 0.0 ELSE len(b)::DOUBLE / len(a) END AS jaccard, CASE WHEN b IS NULL THEN 0.0 ELSE 2.0 * len(b)::DOUBLE / (len(a) + len(b)) END AS dice FROM s")
def sql_set_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that a brand comes in, against those of its large sizes."""
    _registered(spark, sf_dir)
    table(spark, sf_dir, "part").createOrReplaceTempView("bomloom_parts")
    return spark.sql("WITH s AS (SELECT p_brand, collect_set(p_type) AS a, collect_set(CASE WHEN p_size > 25 THEN p_type END) AS b FROM bomloom_parts GROUP BY 1) SELECT p_brand, dag_jaccard_similarity(a, b) AS jaccard, dag_dice_similarity(a, b) AS dice FROM s")
