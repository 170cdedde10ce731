"""Queries over what is stored: indexes, tables that are replaced by key, and streams into them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.operators import embeddings, graph, minhash, refresh, vector_index
from bomloom.plans import queries as base
from bomloom.plans.inputs import dag, suppliers, table, with_sql
from bomloom.plans.registry import query
from bomloom.sources.schemas import EMBEDDINGS_DIRTY
from bomloom.sources.stored import KeyedTable
from bomloom.sources.tables import shared_folder, written
from bomloom.streaming.dirty import stream_marks


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _indexed(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    e, asked = _vectors(spark, sf_dir)
    index = vector_index.VectorIndex.build(e, _place(spark), metric)
    return index.search(asked, 10, index.probes_for(0.97)).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query()
def vector_index_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "cosine")


@query()
def vector_index_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "l2sq")


@query(base._KNN.format(d=base._L2))
def vector_index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing every cell, the index gives what exact search gives; part of the vectors is added later."""
    e, asked = _vectors(spark, sf_dir)
    index = vector_index.VectorIndex.build(e.where("vec_id % 3 <> 1"), _place(spark), "l2sq")
    index.add(e.where("vec_id % 3 = 1"))
    return index.search(asked, 10, len(index.centers)).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query()
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, queries, recall of the ten nearest, probes, cells, scanned_share."""
    e, asked = _vectors(spark, sf_dir)
    out = None
    for metric in ("cosine", "l2sq"):
        index = vector_index.VectorIndex.build(e, _place(spark), metric)
        probes = index.probes_for(0.97)
        row = vector_index.recall(index.search(asked, 10, probes), embeddings.vector_top_k(e, asked, 10, metric))
        row = row.select(F.lit(metric).alias("metric"), "queries", "recall", F.lit(probes).alias("probes"), F.lit(len(index.centers)).alias("cells"), F.lit(index.scanned_share(asked, probes)).alias("scanned_share"))
        out = row if out is None else out.unionAll(row)
    return out


@query(with_sql(base._pairs("suppliers", "a.parent_id < b.parent_id") + " SELECT a AS class_a, b AS class_b, shared AS shared_components, similarity FROM j WHERE similarity >= 0.16", "suppliers"))
def minhash_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At so low a bound each value is a band of its own, and a pair at it is missed once in some 10^9 times; no two suppliers have the same parts."""
    return minhash.minhash_similar_pairs(spark, 0.16, suppliers(spark, sf_dir))


@query(with_sql("s AS (SELECT p_brand || '/' || p_size AS parent_id, p_type AS child_id FROM part GROUP BY ALL), l AS (SELECT parent_id, list(child_id ORDER BY child_id) AS c FROM s GROUP BY 1) SELECT parent_id AS material_id, min(parent_id) OVER (PARTITION BY c) AS class_id FROM l"))
def component_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and sizes over the types that they come in; many have the same."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("parent_id"), F.col("p_type").alias("child_id"))
    return minhash.component_classes(spark, parts)


def _earlier(bom: DataFrame) -> DataFrame:
    """The state before: some edges were not there, and some that are gone were. Distinct if bom is."""
    kept = bom.where((F.pmod(F.xxhash64("parent_id", "child_id"), F.lit(50)) > 0) & (F.col("parent_id") != "S3"))
    gone = bom.where("parent_id LIKE 'S%7'").select("parent_id", F.concat(F.lit("old"), "parent_id").alias("child_id")).distinct()
    return kept.unionByName(gone).unionByName(bom.where("parent_id LIKE 'S%5'").select(F.concat(F.lit("gone"), "parent_id").alias("parent_id"), "child_id"))


def _refreshed(spark: SparkSession, old: DataFrame, new: DataFrame, levels: int | None, compute) -> DataFrame:
    """What a table of compute(bom, ids) over old holds after a refresh to new of what is marked; old and new are tables, as they are read several times."""
    whole = compute(old, None)
    stored = KeyedTable.create(spark, _place(spark), whole.schema, "material_id")
    stored.replace(whole)
    marks = KeyedTable.create(spark, _place(spark), EMBEDDINGS_DIRTY, "material_id")
    refresh.mark(marks, refresh.touched(old, new, levels))
    refresh.refresh_marked(stored, marks, lambda ids: compute(new, ids))
    return stored.read()


@query(with_sql(base._MINHASH + " SELECT * FROM m", "suppliers"))
def refreshed_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def compute(bom: DataFrame, ids: DataFrame | None) -> DataFrame:
        own = bom if ids is None else bom.join(ids.withColumnRenamed("material_id", "parent_id"), "parent_id", "left_semi")
        return embeddings.compute_jaccard_embeddings(spark, own)

    now = written(suppliers(spark, sf_dir))
    return _refreshed(spark, written(_earlier(now)), now, 0, compute)


@query(with_sql(base._LEVELS.format(t="dag", n=3) + " SELECT * FROM fp", "dag", recursive=True))
def refreshed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of three levels changes with the edges of its material and of what lies up to two levels below."""
    now = written(graph.distinct_edges(dag(spark, sf_dir, repeats=True)))
    return _refreshed(spark, written(_earlier(now)), now, 2, lambda bom, ids: graph.fingerprints(bom, 3, ids, stored=True))


@query("WITH o AS (SELECT p_partkey, p_name, round(p_retailprice, 2) AS price FROM part WHERE p_partkey % 4 <> 3), n AS (SELECT p_partkey, upper(p_name) AS p_name, round(p_retailprice + 1, 2) AS price FROM part WHERE p_partkey % 2 = 1) SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)) WHERE p_partkey % 10 <> 0")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are stored; half of them come with new values, some twice; some are deleted."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("price"))
    stored = KeyedTable.create(spark, _place(spark), part.schema, "p_partkey", 16)
    stored.upsert(part.where("p_partkey % 4 <> 3"))
    changed = part.where("p_partkey % 2 = 1").select("p_partkey", F.upper("p_name").alias("p_name"), F.round(F.col("price") + 1, 2).alias("price"))
    stored.upsert(changed.unionAll(changed.where("p_partkey % 3 = 0").withColumn("price", F.col("price") - 5)))
    stored.delete(part.where("p_partkey % 10 = 0").select("p_partkey"))
    stored.vacuum()
    return stored.read()


@query("SELECT 'U' || user_id AS material_id, arg_max(event_type, (ts, event_type)) AS reason, max(ts) AS marked_at FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1")
def streamed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of changes in several micro-batches, of which the latest of each user stays."""
    changes = written(table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("material_id"), F.col("event_type").alias("reason"), F.col("ts").alias("marked_at")).repartition(6))
    marks = KeyedTable.create(spark, _place(spark), EMBEDDINGS_DIRTY, "material_id", 8)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(changes.bomloom_path)
    stream_marks(stream, marks, _place(spark)).awaitTermination()
    return marks.read()
