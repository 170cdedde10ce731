"""The vector index, min-hash search, tables replaced by key, refresh and streams into them, on small made-up tables."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomloom.operators import embeddings, graph, minhash, refresh, search, vector_index
from bomloom.sources.schemas import EMBEDDINGS_DIRTY
from bomloom.sources.stored import KeyedTable, Overtaken
from bomloom.streaming.dirty import stream_marks

VECTORS = "vec_id long, embedding array<float>"


@pytest.fixture
def place(spark, tmp_path):
    return lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"


def clustered(n=3000, dims=16, seed=3):
    """Vectors around 60 places, a third of all equal to one."""
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(60, dims))
    rows = places[rng.integers(0, 60, n)] + rng.normal(size=(n, dims)) * 0.15
    rows[rng.random(n) < 1 / 3] = places[0]
    return [(i, r.tolist()) for i, r in enumerate(rows)]


def asked(vectors, modulus=100):
    return vectors.where(f"vec_id % {modulus} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def ranked(found):
    return [tuple(r) for r in found.select("query_id", "vec_id", F.round("distance", 6)).orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_index_finds_most_and_scans_little(spark, place, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "BLOCK", 200)  # the hot cell has several blocks
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 5)
    vectors = spark.createDataFrame(clustered(), VECTORS)
    index = vector_index.VectorIndex.build(vectors, place(), metric)
    assert index.vectors().count() == 3000 and index.vectors().select("cell", "block").distinct().count() > len(index.centers)
    truth = embeddings.vector_top_k(vectors, asked(vectors), 10, metric)
    probes = index.probes_for(0.95)
    found = index.search(asked(vectors), 10, probes)
    assert vector_index.recall(found, truth).first().recall >= 0.9 and index.scanned_share(asked(vectors), probes) < 0.6
    assert ranked(index.search(asked(vectors), 10, len(index.centers))) == ranked(truth)
    assert ranked(vector_index.VectorIndex(spark, index.path).search(asked(vectors), 10, probes)) == ranked(found)


def test_index_of_odd_vectors(spark, place):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [1.0, 0.1]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("e", [None, 1.0]), (None, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    index = vector_index.VectorIndex.build(vectors, place(), "cosine", cells=2)
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("q", [0.0, 0.0]), ("n", None), ("s", [1.0])], "query_id string, embedding array<double>")
    got = {}
    for r in index.search(queries, 3, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.distance, 4)))
    assert got == {"a": [("b", 0.0), ("b", 0.005), (None, 0.2929)], "q": [(None, 1.0), ("a", 1.0), ("b", 1.0)]}
    empty = vector_index.VectorIndex.build(vectors.limit(0), place())
    assert empty.search(queries, 3).count() == 0 and empty.probes_for() == 1
    with pytest.raises(ValueError, match="metric"):
        vector_index.VectorIndex.build(vectors, place(), "l1")


def test_index_takes_more(spark, place):
    rows = clustered(600)
    vectors = spark.createDataFrame(rows, VECTORS)
    index = vector_index.VectorIndex.build(vectors.where("vec_id < 300"), place(), "l2sq")
    index.add(vectors.where("vec_id >= 300"))
    assert ranked(index.search(asked(vectors, 50), 5, 99)) == ranked(embeddings.vector_top_k(vectors, asked(vectors, 50), 5, "l2sq"))


def bom(spark, rows):
    return spark.createDataFrame(rows, "parent_id string, child_id string")


def sets(seed=1):
    """Groups of near copies, a group of equal sets, sets with one common component, nulls and repeats."""
    rng, rows = random.Random(seed), []
    for g in range(40):
        base = [f"c{rng.randrange(5000)}" for _ in range(30)]
        for k in range(5):
            own = base[:]
            for _ in range(k):
                own[rng.randrange(30)] = f"c{rng.randrange(5000)}"
            rows += [(f"m{g}-{k}", c) for c in own]
    rows += [(f"same{i}", f"s{j}") for i in range(150) for j in range(4)]
    rows += [(f"few{i}", c) for i in range(120) for c in ("common", f"f{i}", f"g{i % 60}")]
    return [*rows, (None, "c1"), ("nothing", None), rows[0], rows[0]]


@pytest.mark.parametrize(("bound", "meeting"), [(0.5, 500), (0.5, 3), (0.8, 500), (0.8, 3), (0.95, 500)])
def test_minhash_pairs(spark, bound, meeting):
    table = bom(spark, sets())
    of = {r.material_id: r.class_id for r in minhash.component_classes(spark, table).collect()}
    assert of["same7"] == "same0" and of["m3-0"] == "m3-0" and "nothing" not in of
    exact = {(of[r.material_a], of[r.material_b]): (r.shared_components, r.similarity) for r in search.all_pairs_jaccard(spark, table, bound).collect()}
    exact = {(min(p), max(p)): x for p, x in exact.items() if p[0] != p[1]}
    got = {(r.class_a, r.class_b): (r.shared_components, r.similarity) for r in minhash.minhash_similar_pairs(spark, bound, table, meeting=meeting).collect()}
    assert all(exact[p] == x for p, x in got.items()) and len(got) >= 0.97 * len(exact) and exact
    assert minhash.minhash_similar_pairs(spark, bound, table.limit(0)).count() == 0


def test_minhash_bounds(spark):
    assert minhash.bands(0.16) == (128, 1) and all(1 - (1 - s**r) ** n >= 0.995 for s in (0.3, 0.5, 0.8, 0.95) for n, r in [minhash.bands(s)])
    with pytest.raises(ValueError, match="above 0"):
        minhash.minhash_similar_pairs(spark, 0.0, bom(spark, []))


ROWS = "k string, v int, w string"


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_replace_by_key(spark, place):
    rows = lambda *x: spark.createDataFrame(x, ROWS)
    table = KeyedTable.create(spark, place(), rows().schema, "k", 4)
    assert content(table) == [] and table.version() == 0
    table.replace(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), (None, 4, "n")))
    assert content(table) == [("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), (None, 4, "n")]
    for _ in range(2):  # again changes nothing
        table.replace(rows(("a", 9, "z"), (None, 5, "m")))
        assert content(table) == [("a", 9, "z"), ("b", 3, None), (None, 5, "m")]
    table.upsert(rows(("c", 1, "p"), ("c", 2, "o"), ("b", None, "q")))
    assert content(table) == [("a", 9, "z"), ("b", None, "q"), ("c", 2, "o"), (None, 5, "m")]
    table.delete(spark.createDataFrame([("a",), ("nobody",), (None,)], "k string"))
    assert content(table) == [("b", None, "q"), ("c", 2, "o")]
    assert sorted(r.k for r in table.read(2).collect() if r.k) == ["a", "b"]  # earlier versions stay readable
    table.replace(spark.createDataFrame([("d", 1, 2)], "k string, v long, more int"))  # columns that the table lacks, and that rows lack
    assert ("d", 1, None) in content(table)
    before = content(table)
    table.vacuum()
    assert content(table) == before and content(KeyedTable(spark, table.path)) == before
    version = table.version()
    assert table.replace(rows()) == version and content(table) == before
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, place()).read()
    with pytest.raises(Overtaken):
        KeyedTable.create(spark, table.path, rows().schema, "k") if version == 0 else table._name(version, {})


def test_only_touched_buckets_are_written(spark, place):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit("x").alias("w"))
    table = KeyedTable.create(spark, place(), rows.schema, "k", 8)
    table.replace(rows)
    before = table._about()[1]["folders"]
    table.replace(rows.where("k = '17'").withColumn("v", F.lit(2)))
    after = table._about()[1]["folders"]
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    assert table.read().where("v = 2").count() == 1 and table.read().count() == 200


def test_failed_and_overtaken_writers(spark, place, monkeypatch):
    rows = spark.createDataFrame([("a", 1, "x")], ROWS)
    table = KeyedTable.create(spark, place(), rows.schema, "k", 4)
    table.replace(rows)
    name, changed = KeyedTable._name, rows.withColumn("v", F.lit(2))

    def dies(self, version, about):
        raise OSError("lost")

    monkeypatch.setattr(KeyedTable, "_name", dies)
    with pytest.raises(OSError, match="lost"):
        table.replace(changed)
    assert content(table) == [("a", 1, "x")]

    def overtaken(self, version, about):
        name(self, version, self._about()[1])  # another writer's version of the same number
        name(self, version, about)

    monkeypatch.setattr(KeyedTable, "_name", overtaken)
    with pytest.raises(Overtaken):
        table.replace(changed)
    monkeypatch.setattr(KeyedTable, "_name", name)
    assert content(table) == [("a", 1, "x")] and table.version() == 2
    table.replace(changed)
    table.vacuum()
    assert content(table) == [("a", 2, "x")] and len(table._names("data")) == 1


OLD = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("X", "Y"), ("L", "M"), ("M", "L"), ("Q", "R"), ("Z", "D"), (None, "A"), ("A", "B")]
NEW = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "F"), ("X", "Y"), ("L", "M"), ("M", "L"), ("N", "L"), ("M", "K"), ("Z", "D"), ("X", None)]


def test_what_a_change_touches(spark):
    old, new = bom(spark, OLD), bom(spark, NEW)
    changed = refresh.changed_parents(old, new)
    assert {tuple(r) for r in changed.collect()} == {("D", "update"), ("M", "update"), ("N", "insert"), ("Q", "delete")}
    of = lambda levels: {r.material_id for r in refresh.with_ancestors(changed, old, new, levels=levels).collect()}
    assert of(0) == {"D", "M", "N", "Q"} and of(1) == of(0) | {"C", "Z", "L"} and of(2) == of(1) | {"B"} and of(None) == of(2) | {"A"}


@pytest.mark.parametrize("levels", [1, 3])
def test_refresh_equals_recomputation(spark, place, levels):
    rng = random.Random(levels)
    for _ in range(2):
        edge = lambda: (f"n{rng.randrange(25)}", f"n{rng.randrange(25)}")
        rows = [edge() for _ in range(50)]
        old, new = bom(spark, rows), bom(spark, rows[5:] + [edge() for _ in range(5)])
        whole = graph.fingerprints(old, levels)
        stored = KeyedTable.create(spark, place(), whole.schema, "material_id", 4)
        stored.replace(whole)
        marks = KeyedTable.create(spark, place(), EMBEDDINGS_DIRTY, "material_id", 4)
        refresh.mark(marks, refresh.with_ancestors(refresh.changed_parents(old, new), old, new, levels=levels - 1))
        assert refresh.refresh_marked(stored, marks, lambda ids, new=new: graph.fingerprints(new, levels, ids)) > 0
        assert content(stored) == sorted(map(tuple, graph.fingerprints(new, levels).collect()), key=str) and marks.read().count() == 0


def test_later_marks_stay(spark, place):
    marks = KeyedTable.create(spark, place(), EMBEDDINGS_DIRTY, "material_id", 4)
    at = lambda t: F.lit(t).cast("timestamp")
    found = spark.createDataFrame([("a", "update"), ("b", "insert"), (None, "update")], "material_id string, reason string")
    refresh.mark(marks, found, at("2024-01-02 00:00:00"))
    refresh.mark(marks, found.where("material_id = 'a'").withColumn("reason", F.lit("delete")), at("2024-01-01 00:00:00"))
    assert {(r.material_id, r.reason) for r in marks.read().collect()} == {("a", "update"), ("b", "insert")}
    stored = KeyedTable.create(spark, place(), spark.createDataFrame([], "material_id string, n int").schema, "material_id", 4)

    def compute(ids):
        refresh.mark(marks, found.where("material_id = 'b'"), at("2024-02-01 00:00:00"))  # marked while the refresh runs
        return ids.withColumn("n", F.lit(1))

    assert refresh.refresh_marked(stored, marks, compute) == 2
    assert {r.material_id for r in marks.read().collect()} == {"b"} and content(stored) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("files", [1, 2, 7])
def test_any_cut_of_a_stream(spark, place, files):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["insert", "update"]), rng.choice([f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 00:00:00", None])) for _ in range(60)]
    changes = spark.createDataFrame(rows * 2, "material_id string, reason string, marked_at string").withColumn("marked_at", F.col("marked_at").cast("timestamp"))
    source = place()
    changes.repartition(7).write.parquet(source)
    marks = KeyedTable.create(spark, place(), EMBEDDINGS_DIRTY, "material_id", 4)
    checkpoint = place()
    for _ in range(2):  # started again, it reads nothing new
        stream_marks(spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files).parquet(source), marks, checkpoint).awaitTermination()
    stream_marks(spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files).parquet(source), marks, place()).awaitTermination()  # all again, as after a lost checkpoint
    want = {}
    for material, reason, at in rows:
        if material and at:
            want[material] = max(want.get(material, ("", "")), (at, reason))
    assert {r.material_id: (str(r.marked_at), r.reason) for r in marks.read().collect()} == want


def test_stream_without_repeats(spark, place):
    changes = spark.createDataFrame([("a", "update", "2024-01-01 00:00:00")] * 5 + [("a", "delete", "2024-01-01 01:00:00")], "material_id string, reason string, marked_at string").withColumn("marked_at", F.col("marked_at").cast("timestamp"))
    source = place()
    changes.write.parquet(source)
    marks = KeyedTable.create(spark, place(), EMBEDDINGS_DIRTY, "material_id", 4)
    stream_marks(spark.readStream.schema(changes.schema).parquet(source), marks, place(), "1 day").awaitTermination()
    assert [r.reason for r in marks.read().collect()] == ["delete"]


@pytest.mark.parametrize("levels", [None, 0, 1, 2])
def test_touched_is_what_changed_and_lies_above(spark, levels):
    old = bom(spark, [("a", "b"), ("b", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("gone", "a"), ("top", "gone"), (None, "a"), ("n", None)])
    new = bom(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "f"), ("x", "y"), ("new", "x"), ("over", "new"), ("top", "x"), ("a", "a")])
    rows = lambda df: sorted(tuple(r) for r in df.select("material_id", "reason").collect())
    got = rows(refresh.touched(old, new, levels))
    assert got == rows(refresh.with_ancestors(refresh.changed_parents(old, new), old, new, levels=levels)) and ("gone", "delete") in got and ("new", "insert") in got and ("n", "update") not in got


def test_refresh_reads_its_edges_once(spark, monkeypatch):
    from bomloom.plans import stored

    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    edges = [("a", "b"), ("b", "c"), ("S3", "b"), ("S7", "a"), ("S5", "S7")]
    monkeypatch.setattr(stored, "dag", lambda *_, **__: bom(spark, edges).withColumn("child_id", F.udf(count)("child_id")))
    assert stored.refreshed_fingerprints(spark, "").count() > 0 and made.value == len(edges)


def test_edges_are_sent_to_signatures_of_their_parent(spark):
    """Nothing is sent once values are made of edges: a signature is 128 values."""
    plan = minhash.signatures(bom(spark, [("a", "b"), ("a", "c")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Exchange")
