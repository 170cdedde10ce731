"""The operators' queries against plain versions, on a small corpus of odd texts and on the smallest tables."""

import math
from collections import Counter

import numpy as np
import pytest
from brute import ASCII_LOWER, WORD, base_scores, components, fingerprint, held_out, kept, leaks, line_dedup, quality, removed
from conftest import SF

from bomloom.llm import decontam, lines, lm, rules, simhash, suffix_index

BOTH = pytest.mark.parametrize("which", ["odd", "real"])


@pytest.fixture
def case(which, docs, texts, real):
    return (docs, texts) if which == "odd" else real


@BOTH
def test_suffix_dedup(case):
    table, rows = case
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.op1_suffix_array_dedup(table).collect()}
    assert got == removed(rows)
    assert any(x[1] for x in got.values())


def test_suffix_dedup_of_anchors_with_many_runs(spark):
    """Every text has one anchor, the lowest of many strings; pairs also share what stands before it, or after it."""
    rng = np.random.default_rng(8)
    say = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    many = say(5000)
    lowest = int(np.argmin(suffix_index.mix(suffix_index.Hasher(np.frombuffer(many.encode(), np.uint8)).every(suffix_index.ANCHOR))))
    anchor, rows = many[lowest : lowest + suffix_index.ANCHOR], []
    for i in range(300):
        shared = say(40)
        pair = [shared + anchor + say(40) if i % 2 else say(40) + anchor + shared for _ in range(2)]
        rows += [say(60) + text + say(60) for text in pair]
    rows = list(enumerate(rows[i] for i in rng.permutation(len(rows))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.op1_suffix_array_dedup(docs).collect()}
    want = removed(rows)
    assert [i for i in want if got[i] != want[i]] == [] and sum(x[1] > 0 for x in want.values()) == 300


def test_suffix_dedup_of_long_texts(spark):
    """Texts that are taken in parts share stretches across the parts' ends, at other places."""
    rng = np.random.default_rng(9)
    say = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    one, two = say(600_000), say(560_000)
    rows = [(1, one), (2, two[:100_000] + one[200_000:320_000] + two[100_000:] + one[:49] + two[:49] + one[524_250:524_330]), (3, one[262_100:262_200] + two[-60:] + say(30))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.op1_suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed(rows) and got[2][2] >= 2


@BOTH
def test_simhash(case):
    table, rows = case
    prints = {i: fingerprint(t) for i, t in rows}
    named = components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash_dedup(table).collect()}
    assert got == {i: (f"{p:016x}", named[i]) for i, p in prints.items()}
    assert len(set(named.values())) < len(rows)
    stay = [r.doc_id for r in simhash.first_of_groups(table).select("doc_id").collect()]
    assert sorted(stay) == sorted(set(named.values()))


def test_one_row_of_each_group_with_repeated_keys(spark):
    one, two = "a first text of some words that say one thing", "and another which has nothing in common with it at all"
    rows = [(7, one), (7, two), (3, one), (9, two), (None, one), (None, "x y z"), (None, "x y z"), (5, one)]
    kept = [tuple(r) for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(3, one), (7, two), (None, "x y z")], key=str)


@BOTH
def test_quality(case):
    table, rows = case
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.op5_quality_rules(table).collect()}
    assert got == {i: quality(t) for i, t in rows}
    verdicts = {r.doc_id: r.kept for r in rules.op5_quality_rules(table).collect()}
    assert verdicts == {i: kept(t) for i, t in rows} and set(verdicts.values()) == {True, False}
    assert sorted(r.doc_id for r in rules.kept_rows(table).collect()) == sorted(i for i, t in rows if kept(t))


def test_quality_policies(docs):
    ledger = rules.measure(docs).cache()
    for policy, names in rules.POLICIES.items():
        judged = rules.judge(ledger, policy).collect()
        without = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in rules.ablations(ledger, policy).collect()}
        for rule in names:
            bit, others = rules.mask((rule,)), rules.mask(tuple(n for n in names if n != rule))
            kept = sum(not r.failures & others for r in judged)
            assert without[rule] == (sum(bool(r.failures & bit) for r in judged), kept - sum(r.kept for r in judged), kept)


def test_ablations_of_all_policies(docs):
    ledger = rules.measure(docs).cache()
    got = {tuple(r) for r in rules.quality_rule_ablations(docs).collect()}
    assert got == {(p, *r) for p in rules.POLICIES for r in rules.ablations(ledger, p).collect()} and len(got) == sum(map(len, rules.POLICIES.values()))


@BOTH
def test_base_scores(case):
    table, rows = case
    want = base_scores(rows)
    for r in lm.op6_lm_scoring(table).collect():
        held, n_tokens, n_known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and np.isfinite(r.score) and r.score < 0


def test_model_beats_base(real):
    rows = [r for r in lm.op6_lm_scoring(real[0]).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_of_a_plain_model(docs, texts):
    """Without what the filter wrongly finds, scores are those of quantised counts in dictionaries, and probabilities sum to 1."""
    train = [t for i, t in texts if not held_out(i, 7, 2)]
    tokens = lambda t: [*WORD.findall((t or "").translate(ASCII_LOWER)), None]
    one, two = Counter(), Counter()
    for t in train:
        seq = tokens(t)
        one.update(seq)
        two.update(zip(["start", *seq], [w if w is None else (w,) for w in seq], strict=False))
    quantised = lambda n: float(lm.dequantised(lm.level(np.array([n])))[0])
    single, pairs = {w: quantised(n) for w, n in one.items()}, {p: quantised(n) for p, n in two.items()}
    mass, followers, total = Counter(), Counter(), sum(single.values()) + len(single) + 1
    for (u, _), n in pairs.items():
        mass[u] += n
        followers[u] += 1
    p = lambda u, w: (pairs.get((u, w if w is None else (w,)), 0) + max(1, followers[u]) * (single.get(w, 0) + 1) / total) / (mass[u] + max(1, followers[u]))
    for u in list(mass)[:200]:
        assert sum(p(u, w) for w in single) + p(u, "an unknown one") == pytest.approx(1)
    want = {i: sum(math.log10(p(u, w)) for u, w in zip(["start", *tokens(t)], tokens(t), strict=False)) for i, t in texts}
    got = {r.doc_id: r.score for r in lm.score(docs, ~lm.held_out("doc_id", 7, 2), bits=60).collect()}
    assert got == pytest.approx(want)
    near = {r.doc_id: r.score for r in lm.op6_lm_scoring(docs).collect()}
    assert np.mean([abs(near[i] - want[i]) < 0.01 * abs(want[i]) for i in want]) > 0.9


def test_a_stored_model_scores_other_texts(spark, docs, texts):
    model = lm.fit(docs, ~lm.held_out("doc_id", 7, 2))
    whole = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.op6_lm_scoring(docs).collect()}
    some = docs.where("doc_id % 3 = 0")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(some, model=model).collect()}
    assert got and all(v == pytest.approx(whole[i]) for i, v in got.items())


@BOTH
def test_lines(case):
    table, rows = case
    if table is not None and len(rows) > 100:
        rows = [(i, t) for i, t in rows if i % 4 == 0]
        table = table.where("doc_id % 4 = 0")
    want = line_dedup(rows)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_near) for r in lines.dedup_lines(table).collect()}
    texts = dict(rows)
    assert {i: x[1:] for i, x in got.items()} == {i: x[1:] for i, x in want.items()}
    assert {i: x[0] for i, x in got.items()} == {i: None if texts[i] is None else x[0] for i, x in want.items()}
    assert lines.dedup_lines(table).columns == [*table.columns, "n_lines", "n_removed", "n_near"]


def test_near_lines_of_another_least_length(docs, texts):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_near) for r in lines.dedup_lines(docs, min_near=5).collect()}
    assert got == {i: x[1:] for i, x in line_dedup(texts, 5).items()} != {i: x[1:] for i, x in line_dedup(texts).items()}


@BOTH
def test_decontamination(spark, which, case):
    table, rows = case
    if which == "odd":
        words = [t.split() for _, t in rows if t and len(t.split()) > 40]
        items = [("b", " ".join(words[0][3:25])), ("a", " ".join(words[0][10:22])), ("é", "x"), ("c", " ".join(words[1][:4]).upper()), ("none", None), ("empty", " .. "), ("d", "nowhere in the corpus at all")]
        benchmark = spark.createDataFrame(items, "item_id string, text string")
    else:
        benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
        items = [(str(r.item_id), r.text) for r in benchmark.collect()]
    want = leaks(rows, items)
    got = decontam.op10_decontamination(table, benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert any(x[4] for x in want.values())


def test_decontamination_in_blocks(spark, docs, texts, monkeypatch):
    rows = [(f"i{k}", t[:200]) for k, (_, t) in enumerate(texts) if t and k % 3 == 0]
    monkeypatch.setattr(decontam, "BLOCK", 900)
    got = decontam.op10_decontamination(docs, spark.createDataFrame(rows, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == leaks(texts, rows)


def test_decontamination_in_blocks_of_null_and_repeated_ids(spark, texts, monkeypatch):
    items = [(f"i{k}", t[:200]) for k, (_, t) in enumerate(texts) if t and k % 3 == 0]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else i, t) for k, (i, t) in enumerate(texts)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    whole = Counter((r.doc_id, r.text) for r in decontam.without_passages(docs, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK", 900)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op10_decontamination(docs, benchmark).collect())
    assert got == Counter((i, *leaks([(0, t)], items)[0]) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in decontam.without_passages(docs, benchmark).collect()) == whole


def test_passages_are_cut(spark, docs, texts):
    text = next(t for _, t in texts if t and len(t.split()) > 40)
    benchmark = spark.createDataFrame([("a", " ".join(text.split()[:14]))], "item_id string, text string")
    left = decontam.without_passages(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert not any(r.contaminated for r in decontam.op10_decontamination(left, benchmark).collect() if r.doc_id in {i for i, t in texts if t == text})
