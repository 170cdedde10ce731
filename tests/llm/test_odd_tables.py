"""Empty tables, null and repeated ids, clashing names, and the pipeline."""

import hashlib

import numpy as np
import pytest
from brute import fingerprint, leaks, line_dedup, quality
from conftest import KINDS, SF, wide

import corpus_pipeline
from bomloom.llm import alignment, decontam, fim, langid, lines, lm, mixing, packing, queries, rules, simhash, suffix_index, toxicity

ITEMS, LABELS = "item_id string, text string", "doc_id long, quality int, toxic int"


def all_of(spark, docs):
    """Every operator over documents, by name."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (2, None, None), (2, 0, 0)], LABELS)
    items = spark.createDataFrame([("a", "one two"), (None, "x"), ("a", "one two"), ("b", None)], ITEMS)
    return {
        "op1": suffix_index.op1_suffix_array_dedup(docs),
        "op2": toxicity.op2_toxicity(docs, labels),
        "op3": langid.op3_language_id(docs),
        "op4": simhash.op4_simhash_dedup(docs),
        "op5": rules.op5_quality_rules(docs),
        "op6": lm.op6_lm_scoring(docs),
        "op7": lines.op7_line_dedup(docs),
        "op8": packing.op8_best_fit_packing(docs),
        "op10": decontam.op10_decontamination(docs, items),
        "op11": fim.op11_fill_in_middle(docs),
        "op12": alignment.op12_tokenizer_alignment(docs),
        "op13": mixing.op13_source_mixing(docs),
    }


def test_names():
    assert len(queries.queries()) == 14 and {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in queries.queries()}


def test_empty_tables(spark, empty):
    assert {k: v.count() for k, v in all_of(spark, empty).items()} == dict.fromkeys(("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10", "op11", "op12", "op13"), 0)
    none = spark.createDataFrame([], ITEMS)
    docs = wide(spark, [(1, "one two three")])
    assert not decontam.op10_decontamination(docs, none).first().contaminated
    assert toxicity.op2_toxicity(docs, spark.createDataFrame([], LABELS)).first().predicted == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, None), (None, "a b c"), (7, "one two three " * 9), (7, "one two three " * 9), (7, None), (3, "one two three " * 9), (8, "")]
    docs = wide(spark, rows)
    for name, out in all_of(spark, docs).items():
        got = out.collect()
        ids = [r.doc_id for r in got]
        if name == "op8":
            assert set(ids) == {None, 3, 7, 8} and len(got) == len(rows)
        else:
            assert sorted(map(str, ids)) == sorted(str(i) for i, _ in rows), name
        if name == "op1":
            assert sorted(r.n_removed for r in got if r.doc_id == 7) == [0, 126, 126] and all(r.n_removed == 0 for r in got if r.doc_id == 3)
        if name == "op4":
            assert {r.component_id for r in got if r.doc_id in (3, 7) and r.fingerprint != "0" * 16} == {3}
            assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {7}


def test_only_nulls(spark):
    docs = spark.createDataFrame([(None,) * 9] * 3, KINDS)
    for name, out in all_of(spark, docs).items():
        assert out.count() == 3, name
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 1


def test_very_long_texts(spark):
    """Two megabytes in one text, and its copy, are treated as whole as any other."""
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 12)) for _ in range(28_000)]
    long = "\n".join(lines)
    docs = wide(spark, [(2, long), (1, long), (3, "a short one of some words")])
    items = spark.createDataFrame([("tail", lines[-1])], ITEMS)
    got = {name: {r.doc_id: r for r in out.collect() if r.doc_id < 3} for name, out in all_of(spark, docs).items() if name not in ("op2", "op3", "op8")}
    size = len(long.encode())
    assert size > 2_000_000 and (got["op1"][1].n_removed, got["op1"][2].n_removed, got["op1"][2].n_spans) == (0, size, 1)
    assert got["op4"][1].fingerprint == got["op4"][2].fingerprint == f"{fingerprint(long):016x}" and got["op4"][2].component_id == 1
    assert got["op5"][1].n_words == 12 * len(lines) and got["op6"][1].n_tokens == 12 * len(lines) + 1
    assert (got["op7"][1].n_lines, got["op7"][2].n_removed) == (len(lines), len(lines))
    assert (got["op11"][1].n, got["op11"][1].restored_sha256) == (12 * len(lines), hashlib.sha256(long.encode()).hexdigest())
    assert got["op12"][1].n_links == got["op12"][2].n_links > 12 * len(lines) and got["op13"][1]["size"] == 12 * len(lines)
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.op10_decontamination(docs, items).collect()}
    assert found[1] == found[2] == (12 * len(lines), 12)
    pieces = packing.op8_best_fit_packing(docs).where("doc_id = 1").agg({"length": "sum", "piece": "max"}).first()
    assert pieces[0] > 12 * len(lines) or pieces[1] > 12 * len(lines)


def test_ids_that_are_no_integers(spark):
    docs = spark.createDataFrame([("a", "one two three")], "doc_id string, text string")
    for operator in (suffix_index.removed_spans, lines.dedup_lines):
        with pytest.raises(TypeError, match="integers"):
            operator(docs)


def brute_pipeline(rows, items):
    """Documents before packing: doc_id -> text."""
    kept = [(i, t) for i, t in rows if not quality(t)[5]]
    left = [(i, x[0]) for i, x in line_dedup(kept).items() if x[2] < x[1] or not x[1]]
    return kept, left, leaks(left, items)


def test_stages(spark, docs, texts):
    """Each stage on all that its predecessor kept, against the plain versions."""
    now = corpus_pipeline.quality_rules(spark, docs, SF)
    assert now.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in now.collect()]
    assert {i for i, _ in rows} <= {i for i, t in texts if not quality(t)[5]} and rows
    now = corpus_pipeline.line_dedup(spark, now, SF)
    assert now.columns == docs.columns
    want = {i: x[0] for i, x in line_dedup(rows).items() if x[2] < x[1] or not x[1]}
    got = {r.doc_id: r for r in now.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) and r.ord == r.doc_id for r in got.values())
    near = corpus_pipeline.near_dedup(spark, now, SF)
    prints = {i: fingerprint(t) for i, t in want.items()}
    for r in near.collect():
        assert all(np.bitwise_count(np.uint64(prints[r.doc_id] ^ p)) > 4 for i, p in prints.items() if i < r.doc_id)
    clean = corpus_pipeline.decontamination(spark, near, SF)
    assert clean.columns == docs.columns and clean.count() == near.count()
    assert {r.doc_id for r in corpus_pipeline.best_fit_packing(spark, clean, SF).collect()} == {r.doc_id for r in clean.collect()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, empty, stage):
    assert stage(spark, empty, SF).count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    whole = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert whole and all(r[1] <= 2048 for r in whole)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
