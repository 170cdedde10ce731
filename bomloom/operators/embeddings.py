"""Embeddings of materials, their fusion, and exact search in vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom.functions.vectors import cosine_distance, embed_text, fuse_embeddings, l2sq_distance
from bomloom.operators.erp import extract_material_descriptions
from bomloom.operators.minhash import SEEDS, signatures
from bomloom.sources.inputs import default, edges, relation
from bomloom.sources.tables import written

#: Vectors of a slice, and queries that are compared with them at once.
_SLICE, _AT_ONCE = 5_000, 256


def compute_jaccard_embeddings(spark: SparkSession, bom_table: DataFrame | str | None = "bom_items") -> DataFrame:
    """material_id, seed, minhash_value, num_components: for each seed the least hash of a material's components."""
    pairs = edges(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table"))
    each = signatures(pairs).select("material_id", F.posexplode("signature").alias("seed", "least"), F.col("size").cast("int").alias("num_components"))
    return each.select("material_id", "seed", F.col("least").cast("float").alias("minhash_value"), "num_components")


def estimated_jaccard(minhash: DataFrame, pairs: DataFrame) -> DataFrame:
    """material_a, material_b, similarity for pairs: the share of seeds with equal values.

    Values are joined where they are equal, so a pair is a row for each that agrees, not for each seed.
    """
    minhash, wanted = written(minhash.select("material_id", "seed", "minhash_value")), pairs.select("material_a", "material_b").distinct()
    known = minhash.select("material_id").distinct()
    for side in ("material_a", "material_b"):
        wanted = wanted.join(known.withColumnRenamed("material_id", side), side, "left_semi")
    of = lambda side: minhash.withColumnRenamed("material_id", side).join(pairs.select(side).distinct(), side, "left_semi")
    equal = of("material_a").join(of("material_b"), ["seed", "minhash_value"]).groupBy("material_a", "material_b").agg(F.count("*").alias("equal"))
    return wanted.join(equal, ["material_a", "material_b"], "left").select("material_a", "material_b", (F.coalesce("equal", F.lit(0)) / SEEDS).alias("similarity"))


def compute_textual_embeddings(makt: DataFrame, language: str = "EN", provider: str = "local") -> DataFrame:
    texts = extract_material_descriptions(makt, language)
    return texts.select("material_id", embed_text(F.col("full_text"), F.lit(provider)).alias("textual_embedding"))


def compute_fused_embeddings(embeddings: DataFrame, weights_structural: float | None = 0.5, weights_textual: float | None = 0.5, weights_transactional: float | None = 0.0) -> DataFrame:
    """material_id, combined_embedding, fusion_weights of the materials that have every vector of a weight other than 0."""
    weights = {"structural": default(weights_structural, 0.5), "textual": default(weights_textual, 0.5), "transactional": default(weights_transactional, 0.0)}
    total = sum(weights.values())
    rows = embeddings
    for m, w in weights.items():
        if w != 0:
            rows = rows.where(F.col(f"{m}_embedding").isNotNull())
    fused = fuse_embeddings({m: F.col(f"{m}_embedding") for m in weights}, {m: F.lit(float(w)) for m, w in weights.items()})
    shares = F.struct(*(F.lit(w / total if total else None).cast("float").alias(m) for m, w in weights.items()))
    return rows.select("material_id", fused.alias("combined_embedding"), shares.alias("fusion_weights"))


def _nearest(k: int, metric: str):
    """The k nearest of a slice of vectors to each of a block of queries: matrix products say which may be, exact sums of them in order which are."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows = {"query_id": [], "vec_id": [], "distance": []}
        if vectors.num_rows and queries.num_rows:
            x, y = (t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1) for t in (vectors, queries))
            ids, asked = (t.column(c).to_numpy() for t, c in ((vectors, "vec_id"), (queries, "query_id")))
            squares = (x**2).sum(1)
            for i in range(0, len(asked), _AT_ONCE):
                q = y[i : i + _AT_ONCE]
                own = (q**2).sum(1)
                if metric == "cosine":
                    lengths = np.sqrt(own)[:, None] * np.sqrt(squares)
                    near, error = 1 - np.divide(q @ x.T, lengths, out=np.zeros_like(lengths), where=lengths > 0), np.full(len(q), 1e-9)
                else:
                    near, error = own[:, None] + squares - 2 * (q @ x.T), 1e-12 * (own + squares.max())
                near[asked[i : i + _AT_ONCE, None] == ids] = np.inf
                # By the error of the products more than the k-th: nothing that may be among the k is left out.
                reach = np.partition(near, k - 1, axis=1)[:, k - 1] + error if k <= len(ids) else np.full(len(q), np.inf)
                for j, query in enumerate(asked[i : i + _AT_ONCE]):
                    at = np.flatnonzero((near[j] <= reach[j]) & (near[j] < np.inf))
                    if metric == "cosine":
                        total = lambda v: np.cumsum(v, axis=-1)[..., -1]
                        length = np.sqrt(total(q[j] * q[j])) * np.sqrt(total(x[at] * x[at]))
                        d = 1 - np.divide(total(x[at] * q[j]), length, out=np.zeros(len(at)), where=length > 0)
                    else:
                        d = np.cumsum((x[at] - q[j]) ** 2, axis=1)[:, -1]
                    for distance, vec in sorted(zip(d.tolist(), ids[at].tolist(), strict=True))[:k]:
                        rows["query_id"].append(query), rows["vec_id"].append(vec), rows["distance"].append(distance)
        types = {"query_id": queries.schema.field("query_id").type, "vec_id": vectors.schema.field("vec_id").type, "distance": pa.float64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in rows.items()})

    return run


def _shape(df: DataFrame) -> tuple[int, int, int, bool]:
    """(rows, least and greatest length of vectors, whether all are numbers)."""
    e = F.col("embedding")
    bad = e.isNull() | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n, least, most, odd = df.agg(F.count("*"), F.min(F.size(e)), F.max(F.size(e)), F.max(bad)).first()
    return n, least or 0, most or 0, not odd


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 2_000) -> DataFrame:
    """query_id, vec_id, distance: the k nearest of vectors (vec_id, embedding) to each query (query_id, embedding), itself aside.

    Slices of vectors meet blocks of queries, both of bounded size, so a task holds one of
    each; only the k best per query of each slice are shuffled. Where vectors have
    different lengths or elements that are no numbers, they are compared one by one, with
    queries broadcast a block at a time (Spark pushes the window's limit below the shuffle).
    """
    distance = {"cosine": cosine_distance, "l2sq": l2sq_distance}[metric]
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = lambda near: near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    (rows, *lengths, good), (asked, *wanted, fit) = _shape(vectors), _shape(queries)
    n = max(1, -(-asked // block))
    if good and fit and len({*lengths, *wanted}) == 1 and lengths[0] > 0:
        kinds, slices = {**dict(queries.dtypes), **dict(vectors.dtypes)}, max(1, -(-rows // _SLICE))
        everywhere = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
        left = vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice"), everywhere(n).alias("block"))
        right = queries.where("query_id IS NOT NULL").select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block"), everywhere(slices).alias("slice"))
        key = ["slice", "block"]
        return ranked(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(k, metric), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, distance double"))
    queries = queries.select("query_id", F.col("embedding").alias("wanted"))
    out = None
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        near = ranked(vectors.join(F.broadcast(part), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", distance(F.col("embedding"), F.col("wanted")).alias("distance")))
        out = near if out is None else out.unionAll(near)
    return out


def reciprocal_rank_fusion(rankings: dict[str, tuple[DataFrame, float]], k: int = 60, missing: int = 1000) -> DataFrame:
    """query_id, vec_id, score: the weighted sum of 1 / (k + rank) over rankings (query_id, vec_id, rank); missing is the rank where one has none."""
    out = None
    for name, (ranks, _) in rankings.items():
        own = ranks.select("query_id", "vec_id", F.col("rank").alias(name))
        out = own if out is None else out.join(own, ["query_id", "vec_id"], "full")
    score = sum((F.lit(w) / (k + F.coalesce(F.col(name), F.lit(missing))) for name, (_, w) in rankings.items()), F.lit(0.0))
    return out.select("query_id", "vec_id", score.alias("score"))
