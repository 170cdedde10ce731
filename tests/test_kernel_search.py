"""Kernel search with bounds, against kernel search over all fingerprints."""

import random

import pytest
from pyspark.sql import functions as F

from bomloom.operators import graph


def rows(df):
    return sorted((r.query_id, r.material_id, round(r.similarity, 12)) for r in df.collect())


@pytest.mark.parametrize("seed, k, iterations, least", [(1, 3, 3, 0.0), (2, 1, 1, 0.2), (3, 50, 5, 0.0), (4, 4, None, 0.5)])
def test_equals_search_over_all(spark, seed, k, iterations, least):
    draw = random.Random(seed)
    edges = [(f"m{draw.randrange(30)}", f"m{draw.randrange(45)}") for _ in range(110)] + [("m1", None), ("lone", None), ("m2", "m2")]
    bom = spark.createDataFrame(edges, "parent_id string, child_id string")
    queries = ["m1", "m2", "m7", "m44", "lone", "nobody"]
    assert rows(graph.find_similar_materials_wl_bounded(spark, queries, k, iterations, least, bom)) == rows(graph.find_similar_materials_wl_kernel(spark, queries, k, iterations, least, bom))


def test_empty_table(spark):
    bom = spark.createDataFrame([], "parent_id string, child_id string")
    assert graph.find_similar_materials_wl_bounded(spark, "m1", 3, bom_table=bom).count() == 0


def test_expands_few_of_families(spark):
    """500 families of 20 products each with rare parts of their own, and screws that all hold: a search in one makes less than a tenth of the rows."""
    products = spark.range(10_000).select("id", F.expr("id div 20").alias("family"))
    own = products.select(F.concat(F.lit("m"), "id").alias("parent_id"), F.explode(F.expr("transform(sequence(0, 9), i -> concat('c', family, '-', pmod(hash(id, i), 12)))")).alias("child_id"))
    screws = products.select(F.concat(F.lit("m"), "id"), F.explode(F.array(*map(F.lit, ("screw", "nut")))))
    bom = own.unionAll(screws)
    pairs = graph.written(graph.distinct_edges(bom))
    own, totals = graph.kernel_queries(pairs, spark.createDataFrame([("m4321",)], "query_id string"))
    scored, others = graph.kernel_candidates(pairs, own, totals, 5, 0.0)
    expanded = graph.fingerprints(pairs, 3, scored.unionByName(others, allowMissingColumns=True).select("material_id")).count()
    assert expanded * 10 < graph.fingerprints(pairs, 3).count()
    assert rows(graph.find_similar_materials_wl_bounded(spark, "m4321", 5, bom_table=bom)) == rows(graph.find_similar_materials_wl_kernel(spark, "m4321", 5, bom_table=bom))


@pytest.mark.parametrize("seed, k, least", [(5, 3, 0.0), (6, 1, 0.3), (7, 40, 0.0)])
def test_frequent_components_are_not_joined_on(spark, monkeypatch, seed, k, least):
    """With components of more than two holders looked up, the rows are those of every component joined on."""
    draw = random.Random(seed)
    edges = [(f"m{draw.randrange(30)}", f"m{int(45 * draw.random() ** 2)}") for _ in range(110)] + [("m1", None), ("lone", None), ("only", "m1"), ("last", "m1")]
    bom = spark.createDataFrame(edges, "parent_id string, child_id string")
    queries = ["m1", "m2", "m7", "lone", "only", "nobody"]
    monkeypatch.setattr(graph, "FREQUENT", 10**6)
    expected = rows(graph.find_similar_materials_wl_kernel(spark, queries, k, 3, least, bom))
    monkeypatch.setattr(graph, "FREQUENT", 2)
    assert rows(graph.find_similar_materials_wl_kernel(spark, queries, k, 3, least, bom)) == expected
    assert rows(graph.find_similar_materials_wl_bounded(spark, queries, k, 3, least, bom)) == expected


def test_few_meetings_at_a_part_of_all(spark):
    """400 products share one screw; a search counts it for few of the pairs that it makes."""
    products = spark.range(400).select(F.concat(F.lit("m"), "id").alias("parent_id"), F.expr("id div 10").alias("family"))
    bom = products.select("parent_id", F.explode(F.expr("transform(sequence(0, 9), i -> concat('c', family, '-', i))")).alias("child_id")).unionAll(products.select("parent_id", F.lit("screw")))
    prints = graph.written(graph.fingerprints(bom, 3))
    totals = prints.groupBy("material_id").agg(F.sum("occurrence").alias("total"))
    own = graph.written(prints.select(F.col("material_id").alias("query_id"), "component", F.col("occurrence").alias("own")))
    graph.FREQUENT, before = 100, graph.FREQUENT
    try:
        assert graph._kernel_common(own, prints, totals, 5, 0.0).count() == 400 * 9
    finally:
        graph.FREQUENT = before


def test_pairs_by_component_and_by_pair(spark, monkeypatch):
    draw = random.Random(8)
    bom = spark.createDataFrame([(f"m{draw.randrange(20)}", f"m{draw.randrange(30)}") for _ in range(90)], "parent_id string, child_id string")
    pairs = spark.createDataFrame([(f"m{draw.randrange(20)}", f"m{draw.randrange(22)}") for _ in range(60)], "a string, b string")
    found = lambda: sorted((r.material_a, r.material_b, round(r.similarity, 12)) for r in graph.wl_kernel_similarity(spark, pairs, 3, bom).collect())
    monkeypatch.setattr(graph, "_MEETINGS", 0)
    expected = found()
    monkeypatch.setattr(graph, "_MEETINGS", 1 << 40)
    assert expected and found() == expected


def test_totals_lie_within_their_bounds(spark):
    """A group of assemblies is known to be large without its fingerprint."""
    edges = [("top", f"a{i}") for i in range(10)] + [(f"a{i}", f"p{i * 30 + j}") for i in range(10) for j in range(40)] + [(f"p{i}", f"b{i % 5}") for i in range(310)]
    pairs = graph.distinct_edges(spark.createDataFrame(edges, "parent_id string, child_id string"))
    totals = {r.material_id: r.n for r in graph.fingerprints(pairs, 3).groupBy("material_id").agg(F.sum("occurrence").alias("n")).collect()}
    bounds = {r.material_id: r for r in graph.total_bounds(pairs, 3).collect()}
    assert all(bounds[m].least <= n + 1e-9 <= bounds[m].most + 1e-6 for m, n in totals.items()) and bounds["top"].least > 300


def test_what_all_hold_is_not_walked_up_from(spark, monkeypatch):
    """Five queries over 400 products that share one nut, and little else: a score with the nut alone is far below the tenth, so few are candidates."""
    draw = random.Random(9)
    edges = [(f"m{i}", f"c{draw.randrange(800)}") for i in range(400) for _ in range(20)] + [(f"m{i}", f"nut{j}") for i in range(400) for j in range(6)]
    pairs = graph.written(graph.distinct_edges(spark.createDataFrame(edges, "parent_id string, child_id string")))
    monkeypatch.setattr(graph, "FREQUENT", 100)
    ids = spark.createDataFrame([(f"m{i}",) for i in range(5)], "query_id string")
    own, totals = graph.kernel_queries(pairs, ids)
    scored, others = graph.kernel_candidates(pairs, own, totals, 10, 0.0)
    assert scored.count() + others.count() < 5 * 100
    asked = [f"m{i}" for i in range(5)]
    assert rows(graph.find_similar_materials_wl_bounded(spark, asked, 10, bom_table=pairs)) == rows(graph.find_similar_materials_wl_kernel(spark, asked, 10, bom_table=pairs))
    # A query that holds little else than the nuts: those that share them are walked up to where totals tell nothing apart.
    more = pairs.unionAll(spark.createDataFrame([("lone", "nut1"), *((f"x{i}", f"y{i}") for i in range(900)), *((f"z{i}", "nut1") for i in range(300))], "parent_id string, child_id string"))
    assert rows(graph.find_similar_materials_wl_bounded(spark, ["lone", "m3"], 10, bom_table=more)) == rows(graph.find_similar_materials_wl_kernel(spark, ["lone", "m3"], 10, bom_table=more))


def test_levels_below_a_child_are_streamed(spark):
    """A merge join holds its right side's rows of a key: those are the parents of a child, of which a region of many suppliers has few."""
    pairs = graph.written(spark.createDataFrame([("r", "n"), ("n", "s"), ("s", "p")], "parent_id string, child_id string"))
    plan = graph.fingerprints(pairs, 2, stored=True)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner") :]
    assert join.index("AS component") < join.index("Relation")
