"""Drawn pairs and their ground truth."""

import pytest

from bomloom.operators import truth


@pytest.mark.parametrize(("total", "n"), [(100, 7), (100, 50), (100, 51), (100, 99), (100, 100), (100, 400), (0, 5), (1, 1), (10_000_000_000, 500)])
def test_numbers(spark, total, n):
    got = [r.number for r in truth.drawn_numbers(spark, total, n, 3).collect()]
    assert len(got) == len(set(got)) == min(n, total) and all(0 <= x < total for x in got)


def test_pairs(spark):
    ids = [f"m{i:02}" for i in range(30)]
    table = spark.createDataFrame([(x,) for x in [*ids, None, ids[3], ids[3]]], "id string")
    pairs = lambda df, n, seed: sorted(map(tuple, truth.drawn_pairs(df, n, seed).collect()))
    got = pairs(table, 60, 1)
    assert len(got) == len(set(got)) == 60 and all(a < b for a, b in got)
    assert pairs(table.repartition(7), 60, 1) == got != pairs(table, 60, 2)
    assert pairs(table, 10_000, 1) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    assert pairs(table.limit(0), 5, 1) == [] and pairs(table.limit(1), 5, 1) == []
    drawn = [p for seed in range(40) for p in pairs(table, 30, seed)]
    assert len(set(drawn)) > 0.9 * 435 and max(map(drawn.count, set(drawn))) < 15


def test_truth(spark):
    bom = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "y"), ("c", "x"), ("d", "z"), ("e", None)], "parent_id string, child_id string")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in truth.sampled_ground_truth(bom, 99).collect()}
    assert got == {("a", "b"): (2, 1.0, "identical"), ("a", "c"): (1, 0.5, "partial_overlap"), ("b", "c"): (1, 0.5, "partial_overlap"), ("a", "d"): (0, 0.0, "unrelated"), ("b", "d"): (0, 0.0, "unrelated"), ("c", "d"): (0, 0.0, "unrelated")}
