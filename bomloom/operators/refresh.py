"""Incremental refresh of stored embeddings: which materials a change touches, and replacing just these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.operators.graph import MAX_DEPTH
from bomloom.sources.inputs import edges
from bomloom.sources.stored import KeyedTable
from bomloom.sources.tables import written


def changed_parents(old: DataFrame, new: DataFrame) -> DataFrame:
    """material_id, reason: parents whose distinct edges (parent_id, child_id) differ. insert: only new has the parent; delete: only old; else update."""
    key = ["parent_id", "child_id"]
    both = edges(old).withColumn("old", F.lit(1)).join(edges(new).withColumn("new", F.lit(1)), key, "full")
    each = both.groupBy(F.col("parent_id").alias("material_id")).agg(F.count("old").alias("old"), F.count("new").alias("new"), F.count("*").alias("n"))
    reason = F.when(F.col("old") == 0, "insert").when(F.col("new") == 0, "delete").otherwise("update")
    return each.where("old < n OR new < n").select("material_id", reason.alias("reason"))


def with_ancestors(changed: DataFrame, *boms: DataFrame, levels: int | None = None) -> DataFrame:
    """material_id, reason: changed, and what lies up to levels steps above it over the edges of any of boms (reason update); all that lies above without levels.

    Edges of the old state count too: what lost its way down to a change is touched as
    well. One join a level; materials that were met aren't followed again, so cycles end.
    """
    links = edges(boms[0])
    for bom in boms[1:]:
        links = links.unionAll(edges(bom))
    links = written(links.distinct()) if levels is None or levels > 0 else links
    return _upwards(changed, links, levels)


def touched(old: DataFrame, new: DataFrame, levels: int | None = None) -> DataFrame:
    """As with_ancestors() of changed_parents() over old and new, whose edges are read and sent once.

    A parent's edges of both states come together, which tells whether it changed; only
    the edges of the others can lead to further materials. One parent's edges are sorted
    in one task.
    """
    state = lambda bom, bit: bom.select(F.col("parent_id").cast("string").alias("parent_id"), F.col("child_id").cast("string").alias("child_id")).dropna().withColumn("state", F.lit(bit))
    each = state(old, 1).unionAll(state(new, 2)).repartition("parent_id").groupBy("parent_id", "child_id").agg(F.bit_or("state").alias("state"))
    own = Window.partitionBy("parent_id")
    each = written(each.select("parent_id", "child_id", F.bit_or("state").over(own).alias("states"), F.bit_and("state").over(own).alias("common")))
    reason = F.when(F.col("states") == 2, "insert").when(F.col("states") == 1, "delete").otherwise("update")
    changed = each.where("common <> 3").groupBy(F.col("parent_id").alias("material_id")).agg(F.min(reason).alias("reason"))
    return _upwards(changed, each.where("common = 3").select("parent_id", "child_id"), levels)


def _upwards(changed: DataFrame, links: DataFrame, levels: int | None) -> DataFrame:
    front = written(changed.select("material_id", "reason"))
    met, step = front, 0
    while (levels is None or step < min(levels, MAX_DEPTH)) and not front.isEmpty():
        above = links.join(front.select(F.col("material_id").alias("child_id")), "child_id", "left_semi").select(F.col("parent_id").alias("material_id")).distinct()
        front = written(above.join(met, "material_id", "left_anti").withColumn("reason", F.lit("update")))
        met, step = met.unionAll(front), step + 1
    return met


def mark(marks: KeyedTable, found: DataFrame, at: Column | None = None) -> int:
    """Store found (material_id, reason) as marks; of a material that is marked already the later mark stays."""
    return merge_marks(marks, found.withColumn("marked_at", F.current_timestamp() if at is None else at))


def merge_marks(marks: KeyedTable, new: DataFrame) -> int:
    """Of new and stored marks (material_id, reason, marked_at) the latest of each material stays; equally late ones by reason.

    The order and number of merges doesn't matter, nor whether one is repeated.
    """
    old = marks.read().join(new.select("material_id").distinct(), "material_id", "left_semi")
    latest = F.max(F.struct("marked_at", "reason")).alias("x")
    rows = new.select("material_id", "reason", "marked_at").unionByName(old.select("material_id", "reason", "marked_at"))
    return marks.replace(rows.where("material_id IS NOT NULL").groupBy("material_id").agg(latest).select("material_id", "x.reason", "x.marked_at"))


def refresh(table: KeyedTable, dirty: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the rows of dirty materials (material_id) by those that compute(dirty) gives; materials for which it gives none go."""
    ids = written(dirty.select("material_id").distinct())
    return table.replace(compute(ids), ids)


def refresh_marked(table: KeyedTable, marks: KeyedTable, compute: Callable[[DataFrame], DataFrame]) -> int:
    """refresh() what is marked, then delete the marks that it read; those made later stay. Returns how many materials were refreshed."""
    read = marks.version()
    seen = marks.read(read)
    n = seen.count()
    refresh(table, seen, compute)
    now = marks.read()
    later = now.join(seen.select("material_id", F.col("marked_at").alias("seen_at")), "material_id").where("marked_at > seen_at").drop("seen_at")
    marks.replace(later, seen.select("material_id"))
    return n
