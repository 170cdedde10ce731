"""Edge cases of the operators that the queries' tables don't hold."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bomloom.functions import features, sets, vectors
from bomloom.operators import graph, search, statistics
from bomloom.operators import movements as moves
from bomloom.sources import inputs, schemas


def bom(spark, pairs):
    return spark.createDataFrame(pairs, "parent_id string, child_id string")


PUMPS = [("PUMP-A", c) for c in ("SEAL", "BEARING", "MOTOR")] + [("PUMP-B", c) for c in ("SEAL", "BEARING", "MOTOR", "GASKET")] + [("PUMP-C", c) for c in ("FILTER", "VALVE")]


def test_search_keeps_zero_rows(spark):
    rows = search.find_similar_materials_jaccard(spark, "PUMP-A", 3, bom_table=bom(spark, PUMPS)).orderBy(F.desc("similarity")).collect()
    assert [tuple(r)[1:] for r in rows] == [("PUMP-B", 0.75, 3, 4), ("PUMP-C", 0.0, 0, 5)]


def test_unknown_query(spark):
    assert search.find_similar_materials_jaccard(spark, "nobody", 3, bom_table=bom(spark, PUMPS)).count() == 0
    rows = graph.find_similar_materials_wl_kernel(spark, "nobody", 5, bom_table=bom(spark, PUMPS)).collect()
    assert {(r.material_id, r.similarity) for r in rows} == {("PUMP-A", 0.0), ("PUMP-B", 0.0), ("PUMP-C", 0.0)}


def test_errors(spark):
    with pytest.raises(ValueError, match="k must not be NULL"):
        search.find_similar_materials_jaccard(spark, "A", None, bom_table=bom(spark, PUMPS))
    with pytest.raises(ValueError, match="missing required column"):
        inputs.relation(spark, bom(spark, PUMPS), ["parent_id", "quantity"], "bom_table")
    with pytest.raises(ValueError, match="Invalid identifier for bom_table: a;b"):
        inputs.relation(spark, "a;b", [], "bom_table")
    with pytest.raises(ValueError, match="must not be empty"):
        inputs.relation(spark, "", [], "bom_table")
    with pytest.raises(AnalysisException):
        inputs.relation(spark, "no_such_table", [], "bom_table")
    assert inputs.check_identifier("täble.x_1", "t") == "täble.x_1"


def test_wl_scalar(spark):
    edges = bom(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("B", "D"), ("X", "B"), ("X", "C"), ("X", "D"), ("C", "D"), ("Y", None)])
    pairs = spark.createDataFrame([("A", "A"), ("A", "X"), ("X", "A"), ("q", "r"), ("q", "q"), ("A", "Y"), ("Y", "Y")], "a string, b string")
    for iterations in (0, 1, 3, 99, None):
        got = {(r[0], r[1]): r[2] for r in graph.wl_kernel_similarity(spark, pairs, iterations, edges).collect()}
        assert got["A", "A"] == got["q", "q"] == 1.0 and got["q", "r"] == got["A", "Y"] == 0.0
        assert got["A", "X"] == got["X", "A"] and 0 <= got["A", "X"] <= 1
        found = {r.material_id: r.similarity for r in graph.find_similar_materials_wl_kernel(spark, "A", 9, iterations, bom_table=edges).collect()}
        assert math.isclose(found["X"], got["A", "X"])


def test_complete_graph_and_long_cycle(spark):
    n = 30
    edges = bom(spark, [(f"N{i}", f"N{j}") for i in range(n) for j in range(n) if i != j])
    assert graph.fingerprints(edges, 1000).count() == n * n
    assert graph.bom_dfs_neighborhood(edges, "N0", 2_000_000_000).count() == n
    assert graph.bom_dfs_neighborhood(bom(spark, [("A", "B"), ("B", "A")]), "A", 5).count() == 2
    assert graph.bom_dfs_neighborhood(bom(spark, [("R", "L1"), ("L1", "L2")]), "R", 1).count() == 1


def test_predecessor_scores(spark):
    days = spark.createDataFrame([("2023-06-30", "2023-01-01"), ("2022-12-02", "2023-01-01"), ("2024-01-01", "2023-01-01"), ("2022-01-01", "2023-01-01")], "d string, s string").select(F.col("d").cast("date").alias("d"), F.col("s").cast("date").alias("s"))
    got = [r[0] for r in days.select(moves.temporal_score(F.col("d"), F.col("s"))).collect()]
    assert np.allclose(got, [1 - 180 / 180 * 0.3, 0.7 - 30 / 90 * 0.3, 0.3, 0.0])


def test_predecessor_found(spark):
    shared = [(p, f"c{i}") for p in ("OLD", "NEW") for i in range(8)]
    weeks = [(f"2023-{1 + i // 4:02d}-{1 + 7 * (i % 4):02d}", i) for i in range(40)]
    moved = [("OLD", d, 100.0 - 2 * i) for d, i in weeks] + [("NEW", d, 5.0 + 3 * i) for d, i in weeks]
    movements = spark.createDataFrame(moved, "material_id string, movement_date string, quantity double")
    row = moves.infer_predecessors(spark, "NEW", bom_table=bom(spark, shared), movements_table=movements).first()
    assert row.predecessor_id == "OLD" and row.correlation < -0.9 and row.similarity == 1.0


def test_nested_sets(spark):
    df = spark.sql("SELECT array(array(1,2), array(3,4)) a, array(array(1,2), array(5,6)) b")
    assert math.isclose(df.select(sets.jaccard_similarity(F.col("a"), F.col("b"))).first()[0], 1 / 3)


def test_fusion_length_and_null(spark):
    short = {m: F.array_repeat(F.lit(1.0), n - (m == "textual")) for m, n in vectors.DIMENSIONS.items()}
    one = {m: F.lit(1.0) for m in short}
    assert spark.range(1).select(vectors.fuse_embeddings(short, one)).first()[0] is None
    assert len(spark.range(1).select(vectors.fuse_embeddings(short, one | {"textual": F.lit(0.0)})).first()[0]) == 768
    assert spark.range(1).select(vectors.fuse_embeddings(short, one | {"structural": F.lit(float("nan"))})).first()[0] is None


def test_features():
    assert len(features.NAMES) == 92 == len(set(features.NAMES))
    x = np.array([1.0, 3.0, 2.0, 5.0, 4.0, 6.0])
    f = dict(zip(features.NAMES, features.features(x), strict=True))
    assert f["mean"] == 3.5 and f["length"] == 6 and f["number_peaks"] == 2 and f["maximum"] == 6
    assert math.isclose(f["fft_coefficient__attr_real__coeff_0"], 21) and math.isclose(f["absolute_energy"], 91)
    for odd in (np.array([2.0]), np.array([2.0, 2.0]), np.full(9, 7.0), np.arange(3000.0)):
        assert np.isfinite(features.features(odd)).all()


def test_entropies_of_long_series():
    x = np.random.default_rng(6).integers(1, 51, 1500).astype(float)
    f, r = dict(zip(features.NAMES, features.features(x), strict=True)), 0.2 * x.std()
    for lag, name in ((1, ""), (2, "__lag_2")):
        near = [np.abs(y[:, None] - y) <= r for y in (x[j * lag :] for j in range(3))]
        n, m = len(x) - lag, len(x) - 2 * lag
        two = (near[0][:n, :n] & near[1][:n, :n]).sum(1)
        three = (near[0][:m, :m] & near[1][:m, :m] & near[2]).sum(1)
        assert math.isclose(f["approximate_entropy" + name], np.log(two / n).mean() - np.log(three / m).mean())
        assert math.isclose(f["sample_entropy" + name], -math.log((three - 1).sum() / (two[:m] - 1).sum()))


def test_transactional_embedding(spark):
    rows = [(m, f"2024-01-{d:02d}", float((d * k) % 7 + 1)) for m, k in (("A", 2), ("B", 3), ("C", 5)) for d in range(1, 29)]
    moved = spark.createDataFrame(rows, "material_id string, movement_date string, quantity double")
    found = statistics.recompute_embedding_statistics(spark, moved)
    assert found.count() == 98
    for r in statistics.compute_transactional_embeddings(spark, moved, found).collect():
        v = np.array(r.transactional_embedding)
        assert len(v) == 128 and not v[30:92].any() and not v[98:].any() and math.isclose(np.linalg.norm(v), 1, rel_tol=1e-5)
    assert statistics.extract_ts_features(spark, moved, batch_size=1, batch_offset=1).first().material_id == "B"


def test_freshness_of_nothing(spark):
    row = statistics.check_statistics_freshness(spark.createDataFrame([], schemas.STATISTICS)).first()
    assert (row.stat_count, row.is_fresh) == (0, False)


def test_schemas(spark):
    header = schemas.conform(spark.createDataFrame([("b", "m")], "bom_id string, parent_material_id string"), schemas.BOM_HEADER)
    row = header.first()
    assert row.base_quantity == 1 and row.is_approved is False
    material = schemas.conform(spark.createDataFrame([("m",)], "material_id string"), schemas.MATERIALS).first()
    assert material.is_active and material.material_number is None
    component = schemas.conform(spark.createDataFrame([("c", "x", "n"), ("c", "b", "m")], "component_id string, bom_id string, child_material_id string"), schemas.BOM_COMPONENT)
    materials = schemas.conform(spark.createDataFrame([("m",)], "material_id string"), schemas.MATERIALS)
    assert {tuple(r) for r in schemas.violations(materials, header, component).collect()} == {("bom_component_pk", "c", 2), ("component_bom_fk", "x", 1), ("component_child_fk", "n", 1)}
    assert {tuple(r) for r in schemas.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3)], "k string, v int"), "k").collect()} == {("a", 1), ("b", 3)}
