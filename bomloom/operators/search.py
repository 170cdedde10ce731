"""Search by shared components.

One inverted-index join finds, for all queries at once, the materials that share a
component; sizes complete the score; a window keeps the best k of each query. Materials
that share nothing score 0 and only fill up what is left of k, so of them no more than
the 2k first by id can be needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom.functions.sets import overlap
from bomloom.operators.order import numbered
from bomloom.sources.inputs import default, edges, relation, required
from bomloom.sources.tables import written

Queries = str | list | DataFrame
#: Above all sizes: a code is a material's number times this, and its size.
_SIZES = 1 << 31
#: The most holders of a component in one row.
HOLDERS = 2_000
#: About so many times do two materials meet in a task that counts them, so that its counts stay in memory.
MEETINGS = 2_000_000
#: The most ids that are broadcast.
NAMES = 500_000


def query_ids(spark: SparkSession, queries: Queries) -> DataFrame:
    """Distinct query_id of one id, a list of ids, or the first column of a DataFrame."""
    if isinstance(queries, DataFrame):
        return queries.select(F.col(queries.columns[0]).cast("string").alias("query_id")).dropna().distinct()
    ids = queries if isinstance(queries, list) else [required(queries, "query_material_id")]
    return spark.createDataFrame([(str(x),) for x in ids], "query_id string").distinct()


def best(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k rows of each query of highest similarity; equal ones by material_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *(keys or ("material_id",)))
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("parent_id").alias("material_id")).agg(F.count("*").alias("size"))


def named(pairs: DataFrame) -> DataFrame:
    """material_id, size, code of the parents of distinct edges, as a table: codes are in the order of ids, and hold the size."""
    return _named(sizes(pairs))


def _named(sized: DataFrame) -> DataFrame:
    ids = numbered(sized, "n", F.col("material_id"))
    return written(ids.select("material_id", "size", (F.col("n") * _SIZES + F.col("size")).alias("code")))


def size_of(code: Column) -> Column:
    return code % _SIZES


def coded(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """code, child_id of the edges whose parents are in names."""
    return pairs.join(names.select(F.col("material_id").alias("parent_id"), "code"), "parent_id").select("code", "child_id")


def holders(edges_: DataFrame) -> DataFrame:
    """child_id, block, codes: the sorted codes of those that hold a component, HOLDERS of them a row, one block after the other."""
    place = F.row_number().over(Window.partitionBy("child_id").orderBy("code"))
    blocks = edges_.withColumn("block", F.floor((place - 1) / HOLDERS))
    return blocks.groupBy("child_id", "block").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def together(edges_: DataFrame) -> DataFrame:
    """a < b, shared: in how many components (code, child_id) two codes meet.

    Lists of holders are sent to the first of a pair, and are divided into pairs where
    these are counted, so that no pair is sent for each component.
    """
    lists = written(holders(edges_))
    return _dealt(_others(lists), _meetings(lists), "a").select("a", F.explode("others").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _others(lists: DataFrame) -> DataFrame:
    """a, others: for each code in lists (child_id, block, codes), those after it that hold the same."""
    within = lists.select("codes", F.posexplode("codes").alias("i", "a")).where("i < size(codes) - 1").select("a", F.slice("codes", F.col("i") + 2, F.size("codes")).alias("others"))
    later = lists.where("block > 0").select("child_id", F.col("block").alias("later"), F.col("codes").alias("others"))
    across = lists.join(later, "child_id").where("block < later").select(F.explode("codes").alias("a"), "others")
    return within.unionAll(across)


def _meetings(lists: DataFrame) -> int:
    """How often two holders meet in lists (child_id, codes)."""
    n = lists.groupBy("child_id").agg(F.sum(F.size("codes").cast("double")).alias("n"))
    return int(n.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0])


def _dealt(rows: DataFrame, meetings: int, key: str) -> DataFrame:
    """rows by key, in so many parts that MEETINGS of the meetings come to a part."""
    parts = math.ceil(meetings / MEETINGS)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def with_names(found: DataFrame, names: DataFrame, **columns: str) -> DataFrame:
    """found with the ids of its columns of codes, by the columns' new names; up to NAMES of them go to the pairs, so that no pair is sent for its ids."""
    if names.count() <= NAMES:
        names = F.broadcast(names)
    for code, name in columns.items():
        found = found.join(names.select(F.col("code").alias(code), F.col("material_id").alias(name)), code)
    return found


def fill(found: DataFrame, queries: DataFrame, materials: DataFrame, k: int) -> DataFrame:
    """(query_id, material_id) of materials that found lacks, enough of them to fill each query up to k."""
    first = materials.select("material_id").orderBy("material_id").limit(2 * k + 1)
    short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    # At most 2k + 1 rows on one side: each query meets a bounded list, not all materials.
    return short.crossJoin(F.broadcast(first)).where("material_id <> query_id").join(found.select("query_id", "material_id"), ["query_id", "material_id"], "left_anti")


def _best_met(k: int, min_similarity: float):
    """A function of one query's rows (query, codes): the k materials that meet it in the best share of components, equal ones by code."""

    def best_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, parts, waiting, query = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                query = batch.column("query")[0].as_py()
                parts.append(batch.column("codes").flatten().to_numpy())
                waiting += len(parts[-1])
            if waiting > MEETINGS or batch is None:
                # Counts so far, and what has come since.
                met, more = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
                both = np.concatenate([codes, met])
                order = np.argsort(both, kind="stable")
                both, numbers = both[order], np.concatenate([counts, more])[order]
                starts = np.flatnonzero(np.diff(both, prepend=-1))
                codes, counts, parts, waiting = both[starts], np.add.reduceat(numbers, starts) if len(starts) else numbers, [], 0
        if query is None:
            return
        others = codes != query
        codes, counts = codes[others], counts[others]
        similarity = counts / (query % _SIZES + codes % _SIZES - counts)
        near = np.flatnonzero(similarity >= min_similarity)
        if len(near) > k:
            near = near[similarity[near] >= np.partition(similarity[near], len(near) - k)[len(near) - k]]
        near = near[np.lexsort((codes[near], -similarity[near]))[:k]]
        yield pa.RecordBatch.from_pydict({"query": np.full(len(near), query, np.int64), "material": codes[near], "shared_components": counts[near], "similarity": similarity[near]})

    return best_met


def _scored(pairs: DataFrame, queries: DataFrame, k: int, min_similarity: float, eligible: DataFrame | None = None) -> DataFrame:
    """The k best of each query, those that share nothing included; equal ones by material_id."""
    pairs = written(pairs)
    names = named(pairs)
    known = names.join(queries, names["material_id"] == queries["query_id"]).select("query_id", F.col("code").alias("query"))
    searched = names if eligible is None else names.join(eligible.select("material_id"), "material_id", "left_semi")
    own = written(coded(pairs, names.join(known.select(F.col("query_id").alias("material_id")), "material_id", "left_semi")).withColumnRenamed("code", "query"))
    lists = written(holders(coded(pairs, searched).join(own.select("child_id"), "child_id", "left_semi")))
    # What is sent to a query are lists; its materials are counted and ranked where they come together.
    asked = own.groupBy("child_id").agg(F.count("*").alias("n")).join(lists, "child_id")
    sent = asked.agg(F.coalesce(F.sum(F.col("n") * F.size("codes")), F.lit(0))).first()[0]
    met = own.join(lists, "child_id").select("query", "codes")
    first = written(_dealt(met, sent // 4, "query").groupBy("query").applyInArrow(_best_met(k, min_similarity), "query long, material long, shared_components long, similarity double"))
    n, a, b = F.col("shared_components"), size_of(F.col("query")), size_of(F.col("material"))
    columns = ["query_id", "material_id", "similarity", "shared_components", (a + b - n).alias("total_components")]
    out = with_names(first, names, query="query_id", material="material_id").select(*columns)
    if min_similarity <= 0:
        # A query that is short of k has all that it shares something with among its first.
        rest = fill(out.select("query_id", "material_id"), known.select("query_id"), searched, k)
        size = lambda side, name: names.select(F.col("material_id").alias(side), F.col("size").alias(name))
        rest = rest.join(size("query_id", "own"), "query_id").join(size("material_id", "size"), "material_id")
        zero = F.lit(0).cast("long")
        out = out.unionByName(rest.select("query_id", "material_id", F.lit(0.0).alias("similarity"), zero.alias("shared_components"), (F.col("own") + F.col("size")).alias("total_components")))
    return out


def find_similar_materials_jaccard(spark: SparkSession, queries: Queries, k: int, min_similarity: float | None = 0.0, bom_table: DataFrame | str | None = "bom_items") -> DataFrame:
    """query_id, material_id, similarity, shared_components, total_components: for each query the k most similar; a query that has no components has no rows."""
    k, least = required(k, "k"), default(min_similarity, 0.0)
    pairs = edges(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table"))
    return best(_scored(pairs, query_ids(spark, queries), k, least), k)


def history(movements: DataFrame) -> DataFrame:
    """material_id, first_usage, last_usage, history_months."""
    date = F.col("movement_date").cast("date")
    months: Column = (F.year("last_usage") - F.year("first_usage")) * 12 + F.month("last_usage") - F.month("first_usage")
    return movements.groupBy(F.col("material_id").cast("string").alias("material_id")).agg(F.min(date).alias("first_usage"), F.max(date).alias("last_usage")).withColumn("history_months", months.cast("long"))


def cold_start_analogs(spark: SparkSession, queries: Queries, k: int, min_history_months: int | None = 0, min_similarity: float | None = 0.0, bom_table: DataFrame | str | None = "bom_items", movements_table: DataFrame | str | None = "goods_movements") -> DataFrame:
    """The most similar materials that have a history of so many months, with its span."""
    k, months, least = required(k, "k"), default(min_history_months, 0), default(min_similarity, 0.0)
    pairs = edges(relation(spark, default(bom_table, "bom_items"), ["parent_id", "child_id"], "bom_table"))
    spans = history(relation(spark, default(movements_table, "goods_movements"), ["material_id", "movement_date"], "movements_table"))
    eligible = None if months <= 0 else spans.where(F.col("history_months") >= months)
    scored = best(_scored(pairs, query_ids(spark, queries), k, least, eligible), k)
    return scored.join(spans, "material_id", "left").select(
        "query_id", "material_id", "similarity", "shared_components", "total_components", F.coalesce("history_months", F.lit(0).cast("long")).alias("history_months"), "first_usage", "last_usage"
    )


def prefix_candidates(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """material_a < material_b, a few of which may be less similar than the bound; all pairs of at least the bound are among them.

    They share one of their rarest components, are near enough in size, and would reach the
    bound if they had all of the common ones, which weren't compared, in common.
    """
    names = named(pairs)
    frequency = pairs.groupBy("child_id").agg(F.count("*").alias("frequency"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("frequency", "child_id"))
    common = lambda size: F.greatest(F.ceil(size * min_similarity - 1e-9) - 1, F.lit(0))
    rare = coded(pairs, names).join(frequency, "child_id").withColumn("place", place).where(F.col("place") <= size_of(F.col("code")) - common(size_of(F.col("code"))))
    a, b = size_of(F.col("a")), size_of(F.col("b"))
    near = F.least(a, b) >= min_similarity * F.greatest(a, b) - 1e-9
    # Of two sets in one order of components, only one has common ones that the other may have anywhere.
    reached = F.col("shared") + common(F.greatest(a, b)) >= min_similarity / (1 + min_similarity) * (a + b) - 1e-6
    met = together(rare.select("code", "child_id")).where(near & reached).select("a", "b")
    return with_names(met, names, a="material_a", b="material_b").select("material_a", "material_b")


def _coded_similarities(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """a < b, shared_components, similarity of every two codes that share a component."""
    found = together(coded(pairs, names)).withColumnRenamed("shared", "shared_components")
    return found.withColumn("similarity", overlap(F.col("shared_components"), size_of(F.col("a")), size_of(F.col("b"))))


def all_similarities(spark: SparkSession, bom_table: DataFrame | str) -> DataFrame:
    """shared_components, similarity: a row for each pair of all_pairs_jaccard(), for reports that need no ids."""
    pairs = written(edges(relation(spark, bom_table, ["parent_id", "child_id"], "bom_table")))
    return _coded_similarities(pairs, named(pairs)).select("shared_components", "similarity")


def all_pairs_jaccard(spark: SparkSession, bom_table: DataFrame | str, min_similarity: float = 0.0) -> DataFrame:
    """material_a < material_b that share a component, with their similarity of at least min_similarity.

    With a bound above 0 a component list is searched by its prefix only: two sets that
    reach it share one of their rarest components, so common ones needn't be joined on.
    """
    pairs = written(edges(relation(spark, bom_table, ["parent_id", "child_id"], "bom_table")))
    columns = ["material_a", "material_b", "shared_components"]
    if min_similarity <= 0:
        names = named(pairs)
        return with_names(_coded_similarities(pairs, names), names, a="material_a", b="material_b").select(*columns, "similarity")
    candidates = written(prefix_candidates(pairs, min_similarity))
    left = candidates.join(pairs.withColumnRenamed("parent_id", "material_a"), "material_a")
    shared = left.join(pairs.withColumnRenamed("parent_id", "material_b"), ["material_b", "child_id"]).groupBy("material_a", "material_b").agg(F.count("*").alias("shared_components"))
    size = sizes(pairs)
    out = shared.join(size.select(F.col("material_id").alias("material_a"), F.col("size").alias("size_a")), "material_a").join(size.select(F.col("material_id").alias("material_b"), F.col("size").alias("size_b")), "material_b")
    similarity = overlap(F.col("shared_components"), F.col("size_a"), F.col("size_b"))
    return out.select(*columns, similarity.alias("similarity")).where(F.col("similarity") >= min_similarity)


def fused_with_groups(spark: SparkSession, bom_table: DataFrame | str, groups: DataFrame, weight: float, group_weight: float) -> DataFrame:
    """material_a < material_b that share a component or a group (material_id, group), similarity: weight times their Jaccard, and group_weight if they share a group.

    As compare.late_fusion() of both, but lists of a component's holders and of a group's
    members are sent to the first of a pair, and pairs are made and added there.
    """
    pairs = written(edges(relation(spark, bom_table, ["parent_id", "child_id"], "bom_table")))
    members = written(groups.select(F.col("material_id").cast("string").alias("material_id"), F.col("group").alias("child_id")).dropna().distinct())
    sized = sizes(pairs).unionAll(members.select("material_id", F.lit(0).cast("long"))).groupBy("material_id").agg(F.max("size").alias("size"))
    names = _named(sized)
    holding = written(holders(coded(pairs, names)))
    grouped = written(holders(members.join(names, "material_id").select("code", "child_id")))
    rows = _others(holding).withColumn("near", F.lit(False)).unionAll(_others(grouped).withColumn("near", F.lit(True)))
    met = _dealt(rows, _meetings(holding) + _meetings(grouped), "a").select("a", "near", F.explode("others").alias("b"))
    found = met.groupBy("a", "b").agg(F.count(F.when(~F.col("near"), 1)).alias("shared"), F.bool_or("near").alias("near"))
    similarity = weight * overlap(F.col("shared"), size_of(F.col("a")), size_of(F.col("b"))) + F.when(F.col("near"), group_weight).otherwise(0.0)
    return with_names(found.select("a", "b", similarity.alias("similarity")), names, a="material_a", b="material_b").select("material_a", "material_b", "similarity")
