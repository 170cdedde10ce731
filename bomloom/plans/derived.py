"""Queries of small operators over inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.functions import vectors
from bomloom.operators import compare, metrics, statistics
from bomloom.operators import movements as moves
from bomloom.plans import queries as base
from bomloom.plans.inputs import movements, suppliers, table, with_sql
from bomloom.plans.registry import query


@query("WITH s AS (SELECT l_returnflag AS flag, l_suppkey, count(*) AS n, max(l_linenumber) AS v, min(l_shipdate) AS u FROM lineitem GROUP BY ALL), t AS (SELECT max(u) + INTERVAL 7 DAY AS now FROM s WHERE flag = 'A') SELECT flag, count(*) AS stat_count, max(n) AS max_samples, max(v) AS current_version, max(u) AS last_updated, count(*) >= 30 AND max(u) >= any_value(now) - INTERVAL 7 DAY AS is_fresh FROM s, t GROUP BY 1")
def statistics_freshness_of_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each return flag's suppliers as statistics, at a time when those of one flag are just fresh."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_suppkey").agg(F.count("*").alias("num_samples"), F.max("l_linenumber").alias("version"), F.min("l_shipdate").alias("updated_at"))
    now = rows.where("flag = 'A'").agg(F.max("updated_at") + F.expr("INTERVAL 7 DAYS")).first()[0]
    out = None
    for flag in ("A", "N", "R"):
        one = statistics.check_statistics_freshness(rows.where(F.col("flag") == flag), F.lit(now)).withColumn("flag", F.lit(flag))
        out = one if out is None else out.unionAll(one)
    return out.where("stat_count > 0")


_SCALE = "sqrt({w} / {t}::DOUBLE)::FLOAT"


def _fused_sql() -> str:
    weights = {0: (0.5, 0.5, 0.0), 1: (1.0, 1.0, 2.0), 2: (0.0, 1.0, 0.0)}
    at = lambda m, place: "CASE label % 4 " + " ".join(f"WHEN {k} THEN " + (f"(embedding[{place}] * {_SCALE.format(w=w[m], t=sum(w))})::DOUBLE" if w[m] else "0.0::DOUBLE") for k, w in weights.items()) + " END"
    return f"SELECT vec_id, CASE WHEN label % 4 < 3 THEN 768 END AS length, {at(0, 1)} AS structural, {at(1, 1)} AS textual, {at(2, 64)} AS transactional FROM embeddings"


@query(_fused_sql())
def fuse_embeddings_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the right lengths made of the given ones, under weights that go by their label; those of one label in four are negative."""
    e = table(spark, sf_dir, "embeddings")
    modes = {"structural": 4, "textual": 6, "transactional": 2}
    weights = {"structural": (0.5, 1.0, 0.0, -1.0), "textual": (0.5, 1.0, 1.0, 1.0), "transactional": (0.0, 2.0, 0.0, 1.0)}
    of = {m: F.get(F.array(*map(F.lit, w)), (F.col("label") % 4).cast("int")) for m, w in weights.items()}
    v = F.col("fused")
    fused = e.withColumn("fused", vectors.fuse_embeddings({m: F.concat(*["embedding"] * n) for m, n in modes.items()}, of))
    places = {"structural": 0, "textual": 256, "transactional": 767}
    return fused.select("vec_id", F.when(v.isNotNull(), F.size(v)).alias("length"), *(F.get(v, F.lit(i)).cast("double").alias(m) for m, i in places.items()))


_CTES, _FOUND = base._PREDECESSORS.rsplit("\nSELECT ", 1)


@query(with_sql(base._pairs("suppliers", "a.parent_id IN ('S1','S2','S3') AND b.parent_id <> a.parent_id") + _CTES + f", f AS (SELECT DISTINCT query_id AS q, predecessor_id AS p FROM (SELECT {_FOUND})), k AS (SELECT 'S' || a.s_suppkey AS q, 'S' || b.s_suppkey AS p FROM supplier a JOIN supplier b ON a.s_nationkey % 2 = b.s_nationkey % 2 AND a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey IN (1, 2, 3)), counts AS (SELECT count(*) FILTER (f.q IS NOT NULL AND k.q IS NOT NULL) AS tp, count(*) FILTER (k.q IS NULL) AS fp, count(*) FILTER (f.q IS NULL) AS fn FROM f FULL JOIN k ON f.q = k.q AND f.p = k.p) SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM counts", "suppliers", "movements"))
def predecessor_metrics_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred predecessors against suppliers of nations of the same parity."""
    found = moves.infer_predecessors(spark, ["S1", "S2", "S3"], min_similarity=0.0, min_confidence=0.0, bom_table=suppliers(spark, sf_dir), movements_table=movements(spark, sf_dir))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), (F.col("s_nationkey") % 2).alias("kind"))
    a, b = s.where("id IN ('S1', 'S2', 'S3')").withColumnRenamed("id", "query_id"), s.withColumnRenamed("id", "predecessor_id")
    return metrics.predecessor_metrics(found, a.join(b, "kind").where("query_id <> predecessor_id"))


_TIERED = "CASE p_partkey % 4 WHEN 0 THEN '-basic' WHEN 1 THEN ' Standard' WHEN 2 THEN '_PREMIUM' ELSE '' END"


@query(f"WITH m AS (SELECT 'P' || p_partkey AS id, p_brand || '/' || p_size AS family, lower(substr({_TIERED}, 2)) AS tier FROM part WHERE p_partkey % 4 < 3) SELECT family, max(id) FILTER (tier = 'basic') AS basic, max(id) FILTER (tier = 'standard') AS standard, max(id) FILTER (tier = 'premium') AS premium FROM m GROUP BY 1")
def quality_tiers_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts named by brand and size, three of four with a tier."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("material_id"), F.concat("p_brand", F.lit("/"), "p_size", F.expr(_TIERED)).alias("description"))
    return compare.quality_tiers(parts)


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions of a fifth as many materials."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit(" M"), F.floor(F.col("doc_id") / 5)).alias("matnr"), F.col("lang").alias("spras"), F.substring("text", 1, 40).alias("maktx"))


_TRANSLATED = "m AS (SELECT 'M' || (doc_id // 5) AS material_id, lang AS spras, substr(text, 1, 40) AS maktx FROM documents)"


@query(f"WITH {_TRANSLATED} SELECT material_id, spras, maktx AS description FROM m WHERE maktx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY CASE spras WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, spras NULLS FIRST, maktx) = 1")
def preferred_descriptions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.preferred_descriptions(_translated(spark, sf_dir), ["de", "fr"])


@query(f"WITH {_TRANSLATED}, h AS (SELECT DISTINCT material_id, spras FROM m WHERE maktx IS NOT NULL) SELECT m.material_id, string_agg(l, ',' ORDER BY l) AS missing FROM (SELECT DISTINCT material_id FROM h) m, (VALUES ('de'), ('en'), ('es'), ('fr')) v(l) WHERE (m.material_id, l) NOT IN (SELECT material_id, spras FROM h WHERE spras IS NOT NULL) GROUP BY 1")
def missing_languages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missing_languages(_translated(spark, sf_dir), ["de", "en", "es", "fr"])
