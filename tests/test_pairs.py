"""Pairs by shared components: what is compared, and lists in blocks."""

import itertools
import random

import pyarrow as pa
import pytest

from bomloom.operators import compare, metrics, search
from bomloom.plans.queries import QUERIES


def links(spark, sets):
    return spark.createDataFrame([(p, c) for p, cs in sets.items() for c in cs], "parent_id string, child_id string")


def drawn(n, size, of, seed=1):
    r = random.Random(seed)
    return {f"m{i}": set(r.sample([f"c{j}" for j in range(of)], size)) for i in range(n)}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_pairs_far_below_the_bound_are_no_candidates(spark):
    """At a low bound nearly every two share a rare component; few of them can reach it."""
    sets = drawn(60, 40, 1200)
    sets["near"] = set(sorted(sets["m0"])[:20]) | {f"d{i}" for i in range(20)}
    found = {(r.material_a, r.material_b) for r in search.prefix_candidates(links(spark, sets), 0.16).collect()}
    similar = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.16}
    assert ("m0", "near") in similar and similar <= found and len(found) < 20


@pytest.mark.parametrize("bound", [0.0, 0.05, 0.3, 0.9])
def test_lists_of_holders_in_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "HOLDERS", 3)
    sets = drawn(25, 6, 14) | {"x": {"c0"}, "y": {"c0"}, "alone": {"z"}}
    got = {(r.material_a, r.material_b): (r.shared_components, round(r.similarity, 9)) for r in search.all_pairs_jaccard(spark, links(spark, sets), bound).collect()}
    pairs = itertools.combinations(sorted(sets), 2)
    assert got == {(a, b): (len(sets[a] & sets[b]), round(jaccard(sets[a], sets[b]), 9)) for a, b in pairs if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= bound}


def test_search_by_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "HOLDERS", 3)
    sets = drawn(20, 5, 12) | {"alone": {"z"}}
    got = {}
    for r in search.find_similar_materials_jaccard(spark, [*sets, "nobody"], 4, bom_table=links(spark, sets)).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.material_id))
    assert {q: sorted(found) for q, found in got.items()} == {q: sorted((-jaccard(sets[q], sets[m]), m) for m in sets if m != q)[:4] for q in sets}


@pytest.mark.parametrize("name", ["similarity_calibration", "similarity_bands"])
def test_reports_on_pairs_send_no_pair_twice(spark, name, capsys):
    """Pairs are counted where lists of holders meet; joins with ids, or with themselves, would send each again."""
    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "Join" not in plan.split("Generate")[0]


def test_calibration_of_other_scores(spark):
    truth = spark.createDataFrame([("a", "b", "variant"), ("a", "c", "variant"), ("b", "c", "unrelated")], "material_a string, material_b string, relationship_type string")
    scored = spark.createDataFrame([("a", "b", 0.5), ("x", "y", 1.0)], "material_a string, material_b string, similarity double")
    got = {r.relationship_type: tuple(r)[1:] for r in metrics.calibration(scored, truth).collect()}
    assert got == {"variant": (2, 0.25, 0.0, 0.5), "unrelated": (1, 0.0, 0.0, 0.0)}


def test_many_meetings_are_dealt_to_more_tasks(spark, monkeypatch):
    sets = drawn(20, 5, 12)
    expected = sorted(tuple(r) for r in search.all_pairs_jaccard(spark, links(spark, sets)).collect())
    monkeypatch.setattr(search, "MEETINGS", 10)
    found = search.all_pairs_jaccard(spark, links(spark, sets))
    assert found.count() and sorted(tuple(r) for r in found.collect()) == expected
    meetings = sum(len([1 for x in sets.values() if c in x]) * (len([1 for x in sets.values() if c in x]) - 1) // 2 for c in {c for x in sets.values() for c in x})
    pairs = search.written(search.edges(links(spark, sets)))
    assert search.together(search.coded(pairs, search.named(pairs))).rdd.getNumPartitions() >= meetings // 10


def test_ranking_counts_as_lists_come(spark, monkeypatch):
    """A query's lists are counted a part at a time; ranked are whole counts, and no window sorts every material that a query meets."""
    best = search._best_met(2, 0.1)
    monkeypatch.setattr(search, "MEETINGS", 3)
    code = lambda n, size: n << 31 | size
    lists = [[code(1, 4), code(2, 2), code(3, 4)], [code(1, 4), code(2, 2)], [code(1, 4), code(3, 4), code(4, 9)], [code(1, 4), code(4, 9)]]
    batches = [pa.RecordBatch.from_pydict({"query": pa.array([code(1, 4)] * len(x), pa.int64()), "codes": pa.array(x, pa.list_(pa.int64()))}) for x in (lists[:1], lists[1:3], lists[3:])]
    (found,) = best(iter(batches))
    assert found.to_pydict() == {"query": [code(1, 4)] * 2, "material": [code(2, 2), code(3, 4)], "shared_components": [2, 2], "similarity": [0.5, 2 / 6]}
    empty = best(iter([batches[0].slice(0, 0)]))
    assert sum(b.num_rows for b in empty) == 0


def test_equal_ones_are_ranked_by_id(spark):
    sets = {f"m{i:02d}": {"x", f"y{i}"} for i in range(30)}
    got = {}
    for r in search.find_similar_materials_jaccard(spark, list(sets), 3, bom_table=links(spark, sets)).collect():
        got.setdefault(r.query_id, []).append(r.material_id)
    assert {q: sorted(x) for q, x in got.items()} == {q: [m for m in sorted(sets) if m != q][:3] for q in sets}


def test_fused_pairs_are_not_sent(spark, monkeypatch):
    """The rows of late fusion of both kinds of pairs, without an exchange after pairs are made."""
    monkeypatch.setattr(search, "HOLDERS", 4)
    sets = drawn(14, 4, 20) | {"alone": {"z"}}
    places = [(m, i % 4) for i, m in enumerate([*sets, "bare", "empty"])] + [("alone", None)]
    groups = spark.createDataFrame(places, "material_id string, group int")
    near = groups.toDF("material_a", "group").join(groups.toDF("material_b", "group"), "group").where("material_a < material_b").selectExpr("material_a", "material_b", "1.0D AS similarity")
    expected = compare.late_fusion({"parts": (search.all_pairs_jaccard(spark, links(spark, sets)), 0.7), "place": (near, 0.3)})
    found = search.fused_with_groups(spark, links(spark, sets), groups, 0.7, 0.3)
    rows = lambda df: sorted((r.material_a, r.material_b, round(r.similarity, 12)) for r in df.collect())
    assert rows(found) == rows(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange hashpartitioning" not in plan.split("Generate")[0]
