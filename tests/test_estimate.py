"""Min-hash estimates for given pairs."""

from bomloom.operators import embeddings


def test_repeated_unknown_and_disjoint_pairs(spark):
    """A pair that is given twice is one row, whose share isn't counted twice; one that agrees in nothing is 0; unknown materials have no row."""
    bom = spark.createDataFrame([(p, c) for p, cs in {"a": "xyz", "b": "xyz", "c": "w"}.items() for c in cs], "parent_id string, child_id string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "nobody"), ("nobody", "a")], "material_a string, material_b string")
    rows = embeddings.estimated_jaccard(embeddings.compute_jaccard_embeddings(spark, bom), pairs).collect()
    assert sorted(map(tuple, rows)) == [("a", "b", 1.0), ("a", "c", 0.0)]
