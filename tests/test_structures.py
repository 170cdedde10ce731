"""Total quantities, cycles, families and the functions of SQL, against plain versions and the DataFrame operators."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bomloom import sql
from bomloom.operators import families, graph, quantities, search

LINES = "parent_id string, child_id string, quantity double"


def plain_totals(lines):
    """(totals by paths, parents that can't have them, those of them on a cycle or between two)."""
    links = defaultdict(float)
    for p, c, q in lines:
        if p is not None and c is not None:
            links[p, c] += q or 0.0
    below = defaultdict(list)
    for (p, c), q in links.items():
        below[p].append((c, q))
    reach = {p: set() for p in below}
    for p in below:
        todo = [p]
        while todo:
            for c, _ in below.get(todo.pop(), []):
                if c not in reach[p]:
                    reach[p].add(c)
                    todo.append(c)
    loops = {p for p in below if p in reach[p]}
    above = {p for p in below if p in loops or reach[p] & loops}
    on = {p for p in above if p in loops or any(p in reach[x] for x in loops)}
    totals = defaultdict(float)

    def walk(root, at, q):
        for c, k in below.get(at, []):
            totals[root, c] += q * k
            walk(root, c, q * k)

    for p in below.keys() - above:
        walk(p, p, 1.0)
    return dict(totals), above, on


CASES = {
    "diamond": [("A", "B", 2.0), ("A", "C", 1.0), ("B", "D", 3.0), ("C", "D", 4.0), ("D", "E", 0.5), ("A", "B", 1.0), ("A", "E", None), (None, "A", 1.0), ("A", None, 1.0)],
    "cycles": [("A", "B", 1.0), ("B", "A", 1.0), ("B", "M", 1.0), ("M", "X", 2.0), ("X", "Y", 1.0), ("Y", "X", 1.0), ("T", "A", 1.0), ("Y", "L", 3.0), ("L", "K", 2.0), ("S", "S", 1.0), ("U", "L", 1.0)],
    "none": [],
    "deep": [(f"n{i}", f"n{i + 1}", 2.0) for i in range(12)] + [("n0", "n6", 1.0)],
}


@pytest.mark.parametrize("case", [*CASES, 1, 2])
def test_total_quantities(spark, case):
    rng = random.Random(case)
    lines = CASES[case] if case in CASES else [(f"n{rng.randrange(20)}", f"n{rng.randrange(20 if case == 2 else 40)}", float(rng.randrange(1, 4))) for _ in range(30)]
    bom = spark.createDataFrame(lines, LINES).withColumn("round", F.lit(1)).withColumn("node", F.lit("x"))
    totals, above, on = plain_totals(lines)
    assert {(r.material_id, r.component): r.quantity for r in quantities.total_quantities(bom).collect()} == totals
    assert {r.material_id: r.on_cycle for r in quantities.materials_without_totals(bom).collect()} == {p: p in on for p in above}
    roots = spark.createDataFrame([("A",), ("n0",), ("nobody",)], "id string")
    assert {(r.material_id, r.component) for r in quantities.total_quantities(bom, roots).collect()} == {k for k in totals if k[0] in ("A", "n0")}


def plain_groups(pairs):
    group = {}
    for a, b in pairs:
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            group.update(dict.fromkeys(gb, ga))
    return {x: min(g) for x, g in group.items()}


def test_connected(spark):
    rng = random.Random(9)
    hub = [("hub", f"h{i}") for i in range(200)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    rng.shuffle(chain)
    some = [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)]
    for pairs in (hub, chain, some, hub + chain + some, [("a", "a")], [("b", "a"), ("a", "b"), ("a", "b")], []):
        got = families.connected(spark.createDataFrame([*pairs, (None, "x")], "x string, y string").repartition(3)).collect()
        assert {r.member: r["first"] for r in got} == plain_groups(pairs) and len(got) == len({r.member for r in got})


def test_families(spark):
    rows = [(p, c) for p, cs in {"a": "123456789", "b": "12345678", "c": "1234567x", "d": "xyz", "e": "xyz", "f": "q"}.items() for c in cs]
    bom = spark.createDataFrame([*rows, ("g", None)], "parent_id string, child_id string")
    got = {r.material_id: (r.family_id, r["size"]) for r in families.product_families(spark, bom, 0.7).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1)}
    assert families.product_families(spark, bom.limit(0)).count() == 0


@pytest.fixture(scope="module")
def registered(spark):
    rng = random.Random(2)
    rows = [(f"m{rng.randrange(12)}", f"c{rng.randrange(15)}") for _ in range(70)] + [(f"c{i}", f"d{i % 3}") for i in range(9)] + [("m1", None), (None, "c1")]
    spark.createDataFrame(rows, "parent_id string, child_id string").createOrReplaceTempView("sql_bom")
    moves = [(f"m{i}", f"2024-0{1 + i % 6}-05", 1.0) for i in range(9)] + [(f"m{i}", f"2025-0{1 + i % 4}-05", 1.0) for i in range(0, 9, 2)]
    spark.createDataFrame(moves, "material_id string, movement_date string, quantity double").createOrReplaceTempView("sql_moves")
    spark.createDataFrame([("b1", "p1"), ("b2", "p2")], "bom_id string, parent_material_id string").createOrReplaceTempView("sql_header")
    spark.createDataFrame([("b1", "x", 2.0), ("b1", "y", 1.0), ("b2", "x", 3.0)], "bom_id string, child_material_id string, quantity_per double").createOrReplaceTempView("sql_component")
    return sql.register(spark, "sql_bom", "sql_moves", "sql_header", "sql_component", prefix="t_")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_sql_functions_equal_the_operators(spark, registered):
    assert len(registered) == len(set(registered)) == 14
    for query, k, least in (("m1", 4, 0.0), ("m5", 50, 0.2), ("nobody", 3, 0.0)):
        want = search.find_similar_materials_jaccard(spark, query, k, least, "sql_bom").drop("query_id")
        assert sorted(rows_of(spark.sql(f"SELECT * FROM t_find_similar_materials_jaccard('{query}', {k}, {least})"))) == sorted(rows_of(want))
        want = graph.find_similar_materials_wl_kernel(spark, query, k, 2, least, "sql_bom").drop("query_id")
        assert sorted(rows_of(spark.sql(f"SELECT * FROM t_find_similar_materials_wl_kernel('{query}', {k}, 2, {least})"))) == sorted(rows_of(want))
        want = search.cold_start_analogs(spark, query, k, 3, least, "sql_bom", "sql_moves").drop("query_id")
        assert sorted(rows_of(spark.sql(f"SELECT * FROM t_cold_start_analogs('{query}', {k}, 3, {least})"))) == sorted(rows_of(want))
    for n in (1, 5):
        want = graph.fingerprints(spark.table("sql_bom"), n).where("material_id = 'm1'").drop("material_id")
        assert sorted(rows_of(spark.sql(f"SELECT * FROM t_wl_fingerprint('m1', iterations => {n})")), key=str) == sorted(rows_of(want), key=str)


def test_sql_functions_in_queries(spark, registered):
    got = spark.sql("SELECT q.id, s.material_id, s.similarity FROM (SELECT DISTINCT parent_id AS id FROM sql_bom WHERE parent_id LIKE 'm%') q, LATERAL t_materials_sharing_components(q.id, 2, min_similarity => 0.05) s")
    ids = [r[0] for r in spark.sql("SELECT DISTINCT parent_id FROM sql_bom WHERE parent_id LIKE 'm%'").collect()]
    want = search.find_similar_materials_jaccard(spark, ids, 2, 0.05, "sql_bom").select("query_id", "material_id", "similarity")
    assert sorted(rows_of(got)) == sorted(rows_of(want))
    assert rows_of(spark.sql("SELECT * FROM t_bom_where_used('x') ORDER BY 1")) == [("p1", "x", 2.0), ("p2", "x", 3.0)]
    assert rows_of(spark.sql("SELECT * FROM t_bom_explosion_1level('p1') ORDER BY 2")) == [("p1", "x", 2.0), ("p1", "y", 1.0)]
    assert rows_of(spark.sql("SELECT * FROM t_bom_common_components('p1', 'p2')")) == [("x",)]
    sets = "VALUES (1, array('A','B','C'), array('B','C','D')), (2, array('A','A','B'), array('B','B','C')), (3, array(), array()), (4, NULL, array('A')), (5, array('A', NULL), array('A', NULL))"
    got = spark.sql(f"SELECT id, t_jaccard_similarity(a, b), t_dice_similarity(a, b) FROM ({sets}) v(id, a, b) ORDER BY id")
    assert [(i, None if x is None else round(x, 4), None if y is None else round(y, 4)) for i, x, y in rows_of(got)] == [(1, 0.5, 0.6667), (2, 0.3333, 0.5), (3, 0.0, 0.0), (4, None, None), (5, 1.0, 1.0)]
    assert rows_of(spark.sql("SELECT t_cosine_distance(array(0D), array(1D)), t_l2sq_distance(array(1D, 2D), array(2D, 0D))")) == [(1.0, 5.0)]


def test_sql_function_names(spark):
    assert sql.register(spark, prefix="only_") == ["only_jaccard_similarity", "only_dice_similarity", "only_l2sq_distance", "only_cosine_distance"]
    with pytest.raises(ValueError, match="Invalid identifier"):
        sql.register(spark, "a; DROP TABLE b")
