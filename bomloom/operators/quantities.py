"""Total quantities of components, and what cycles prevent from having them.

A material's totals follow from those of its direct components, so materials are taken
in the order in which they can be: first those whose components are no parents, then
those whose components have all been taken, and so on. Each pair of a material and a
component is made once, however many paths lead from one to the other, and no path is
listed. What is never taken lies on a cycle or above one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomloom.sources.tables import dropped, written


def _links(bom: DataFrame) -> DataFrame:
    """p, c, q: each pair of a parent and a child once, with the sum of its lines; a null quantity counts as 0."""
    q = F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    rows = bom.select(F.col("parent_id").cast("string").alias("p"), F.col("child_id").cast("string").alias("c"), q.alias("q")).dropna(subset=["p", "c"])
    return rows.groupBy("p", "c").agg(F.sum("q").alias("q"))


def _peeled(links: DataFrame, node: str, towards: str) -> tuple[DataFrame, DataFrame]:
    """(node, round) of what is peeled, and the nodes left: a node goes once all that its links lead towards are gone or have no links on."""
    rows = links.select(F.col(node).alias("node"), F.col(towards).alias("to"))
    nodes = written(rows.select("node").distinct())
    # Links to what has gone, or never had links, hold nothing; each round's are made from the rest of the round before.
    left = written(rows.join(nodes.withColumnRenamed("node", "to"), "to", "left_semi"))
    done, rounds = None, 0
    while True:
        held = written(left.select("node").distinct())
        ready = written(nodes.join(held, "node", "left_anti"))
        if ready.isEmpty():
            return done if done is not None else ready.withColumn("round", F.lit(0)), nodes
        done = ready.withColumn("round", F.lit(rounds)) if done is None else done.unionAll(ready.withColumn("round", F.lit(rounds)))
        rest = written(left.join(ready.withColumnRenamed("node", "to"), "to", "left_anti"))
        dropped(left)
        left, nodes, rounds = rest, held, rounds + 1


def materials_without_totals(bom: DataFrame) -> DataFrame:
    """material_id, on_cycle: parents that lie on a cycle of edges (parent_id, child_id), or between two, and those that only lie above one."""
    links = written(_links(bom.withColumn("quantity", F.lit(1.0))))
    _, above = _peeled(links, "p", "c")
    inner = links.join(above.withColumnRenamed("node", "p"), "p", "left_semi").join(above.withColumnRenamed("node", "c"), "c", "left_semi")
    _, on = _peeled(inner, "c", "p")
    return above.join(on.withColumn("on_cycle", F.lit(True)), "node", "left").select(F.col("node").alias("material_id"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def total_quantities(bom: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """material_id, component, quantity: how much of each component lies below a material, over all paths and levels.

    bom: parent_id, child_id, quantity; lines of the same pair add up, rows with a null
    id don't count, and a null quantity counts as 0. roots (its first column) limits the
    materials, else all parents have rows. Materials on or above a cycle have none;
    materials_without_totals() names them.
    """
    links = written(_links(bom))
    rounds, _ = _peeled(links, "p", "c")
    rounds = written(rounds)
    depth = rounds.agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]
    ordered = written(links.join(rounds.withColumnRenamed("node", "p"), "p"), "round")
    totals = None
    for k in range(depth):
        own = ordered.where(F.col("round") == k).select("p", "c", "q")
        rows = own.select("p", F.col("c").alias("component"), F.col("q").alias("quantity"))
        if totals is not None:
            below = own.join(totals.select(F.col("material_id").alias("c"), "component", "quantity"), "c")
            rows = rows.unionAll(below.select("p", "component", (F.col("q") * F.col("quantity")).alias("quantity")))
        new = written(rows.groupBy(F.col("p").alias("material_id"), "component").agg(F.sum("quantity").alias("quantity")))
        totals = new if totals is None else totals.unionAll(new)
    if totals is None:
        totals = links.select(F.col("p").alias("material_id"), F.col("c").alias("component"), F.col("q").alias("quantity")).limit(0)
    if roots is not None:
        totals = totals.join(roots.select(F.col(roots.columns[0]).cast("string").alias("material_id")).distinct(), "material_id", "left_semi")
    return totals
