"""Held-out accuracy of the trained operators, round trips of packing, extraction of pages, and parts of the methods."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import components
from conftest import SF, SF_LARGE, SF_MORE

from bomloom.llm import decontam, html, langid, lm, packing, simhash, suffix_index, toxicity
from bomloom.llm._arrow import Chunk


def test_toxicity_held_out(spark):
    """The labels are noisy: some toxic ones have no toxic word."""
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet")
    scored = toxicity.op2_toxicity(spark.read.parquet(f"{SF_LARGE}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in scored if r.toxic == 1]
    clean = [r for r in scored if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


def test_toxicity_bounds_rows_of_repeated_ids(spark, monkeypatch):
    """Many texts of one id are one row, as are repeats of a row, and ids are bounded."""
    monkeypatch.setattr(toxicity, "MAX_ROWS", 30)
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 20)
    docs = spark.range(4000).selectExpr("id % 40 AS doc_id", "concat('text ', id div 80) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    rows = toxicity.sample(docs, labels).collect()
    assert 20 <= len(rows) == len({r.doc_id for r in rows}) <= 40 and {r.toxic for r in rows} >= {0, 1}
    once = spark.range(40).selectExpr("id AS doc_id", "'x' AS text")
    repeated = [r.doc_id for r in toxicity.sample(once.unionAll(once), labels).collect()]
    assert len(repeated) == len(set(repeated)) >= 20


def test_repeated_voter_loses_weight():
    """Where only a voter and its two copies vote, the posterior is lower than where three voters of the same rates do that err apart."""
    rng = np.random.default_rng(2)
    y = rng.random(8000) < 0.3
    voters = (rng.random((8000, 9)) < np.where(y, 0.6, 0.05)[:, None]).astype(float)
    copied = voters.copy()
    copied[:, 1:3] = voters[:, :1]
    of_three = lambda votes: toxicity.label_model(votes)[0][(votes[:, :3].all(1)) & ~votes[:, 3:].any(1)].mean()
    assert of_three(copied) < of_three(voters) - 0.2


def test_label_model_finds_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    rates = np.array([[0.05, 0.8], [0.1, 0.6], [0.02, 0.5], [0.3, 0.3], [0.05, 0.7]])
    votes = (rng.random((4000, 5)) < rates[:, y.astype(int)].T).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a voter that repeats another
    posterior, found, correlation = toxicity.label_model(votes)
    assert ((posterior > 0.5) == y).mean() > 0.88 and np.abs(found[:5] - rates).max() < 0.12 and correlation[0, 5] > 0.9


def test_language_held_out(spark):
    table = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    lang = {r.doc_id: (r.lang, r.text) for r in table.select("doc_id", "lang", "text").collect()}
    rows = [r for r in langid.op3_language_id(table).collect() if r.held_out]
    plain = [r for r in rows if lang[r.doc_id][0] and len(lang[r.doc_id][1] or "") > 200 and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in plain]) > 0.95
    short = [r for r in rows if lang[r.doc_id][0] and len(lang[r.doc_id][1] or "") <= 200 and r.lang_pred != "und"]
    assert len(short) > 5 and np.mean([r.lang_pred == lang[r.doc_id][0] for r in short]) > 0.9
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, lang[r.doc_id][1] or ""))) and 0 <= r.score <= 1 for r in rows)


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    pieces: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in packing.op8_best_fit_packing(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b c ", "\n\n x\t y", "don't  stop", "<|endoftext|> x", "é 漢字 🙂 x", "a b  c", "ſ't K's", "x" * 5000, "1234 567,8"])
def test_encoder_equals_library(text):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(e(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_fullest_bin():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = np.zeros(61, np.int64)
        for n in rng.integers(1, 40, 9):
            counts[n] += 1
        first = int(np.flatnonzero(counts).max())
        rest = [n for n in np.repeat(np.arange(61), counts).tolist()]
        rest.remove(first)
        sums = {first}
        for n in rest:
            sums |= {s + n for s in sums if s + n <= 60}
        got = packing.fullest(counts, first, 60)
        assert sum(got) == max(sums) and (np.bincount(got, minlength=61) <= counts).all()


@pytest.mark.parametrize("counts, sequences", [({100: 1000}, 50), ({1: 10_000}, 5), ({1000: 3, 1: 3144}, 3), ({100: 10_000, 300: 10, 1748: 10}, 510)])
def test_copies_of_a_length_fill_bins(counts, sequences):
    histogram = np.zeros(2049, np.int64)
    for n, k in counts.items():
        histogram[n] = k
    placed, bins = np.zeros(2049, np.int64), packing.plan(histogram)
    for lengths, times in bins:
        assert sum(lengths) <= 2048
        placed += times * np.bincount(lengths, minlength=2049)
    assert (placed == histogram).all() and sum(times for _, times in bins) == sequences


def test_empty_texts_share_sequences(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(5000)], "doc_id long, text string")
    rows = packing.op8_best_fit_packing(docs).collect()
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows}) == 5000 and {r.sequence_id for r in rows} == {0, 1, 2} and max(r.offset for r in rows) < 2048


def test_golay_keys_meet():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, 4, replace=False).tolist():
            b ^= 1 << bit
        who, key = simhash.keys(np.array([a, b], np.uint64))
        assert set(key[who == 0]) & set(key[who == 1])


def test_large_keys_are_divided(spark):
    """Chains of fingerprints that mostly share keys have the components of brute force, divided or not."""
    rng = np.random.default_rng(12)
    prints = {0}
    for base in rng.integers(0, 1 << 60, 12).tolist():
        for _ in range(60):
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist():
                base ^= 1 << bit
            prints.add(base)
    want = components({p: p for p in prints})
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    for limit in (4096, 2):
        edges = simhash.links(table, limit).collect()
        own = {p: p for p in prints}

        def find(p):
            while own[p] != p:
                p = own[p]
            return p

        for e in edges:
            a, b = find(e.a % 2**64), find(e.b % 2**64)
            own[max(a, b)] = min(a, b)
        assert {p: find(p) for p in prints} == want


def test_fm_index():
    rng = np.random.default_rng(4)
    s = np.append(rng.integers(0, 5, 300), 0)
    s[0] = 1
    index = decontam.FMIndex(s, 4)
    phrases = np.array([s[i : i + 3] for i in range(250) if s[i : i + 3].all()] + [[4, 4, 4]])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]


def test_bloom_counts():
    rng = np.random.default_rng(6)
    grams, counts = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(1, 5000, 3000)
    found = lm.BloomCounts.of(grams, counts).levels(grams)
    assert (found >= lm.level(counts)).all() and np.mean(found == lm.level(counts)) > 0.95
    other = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    assert np.mean(lm.BloomCounts.of(grams, counts).levels(other) > 0) < 0.05


def test_network_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, langid.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = langid.train(x, y, ["a", "b", "c"])
    assert (langid.predict(x, net.params).argmax(1) == y).all()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Fish &amp; chips</h1><p>One  long paragraph <b>with</b> bold&nbsp;text that says something of interest to its reader.</p>
<script>var x = "<p>no</p>";</script><div class="ad">Buy now</div><p>And another paragraph, which follows the first one at some length.</p></article>
<section id="comments"><p>First! A comment of a reader that is long enough to look like the text of an article.</p></section><footer>&copy; Site</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>Home</nav>"), (5, "u", "plain text &lt;b&gt; only"), (6, "u", "<p>unclosed <b>tags<p>here"), (6, "u", "<p>unclosed <b>tags<p>here"), (None, "u", "<div>" * 3000 + "deep")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.op9_html_extraction(table).collect()}
    assert got[1].text == "Fish & chips One long paragraph with bold text that says something of interest to its reader. And another paragraph, which follows the first one at some length."
    assert [got[i].text for i in (2, 3, 4, 5, 6, None)] == ["", "", "", "plain text <b> only", "unclosed tags here", "deep"]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.op9_html_extraction(table.limit(0)).count() == 0


def test_extraction_of_pages(spark):
    rows = html.op9_html_extraction(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert np.mean([r.n_chars > 100 for r in rows]) > 0.9 and not any("</" in r.text for r in rows)


def test_windows_cover_texts():
    data = np.arange(1, 201, dtype=np.uint8)
    x, doc = langid.windows(Chunk(pa.array([1, 2, 3]), data, np.array([0, 0, 130, 200])))
    assert doc.tolist() == [1, 1, 2] and x[x > 0].tolist() == data.tolist()


def test_suffix_arrays_are_ordered_and_merge():
    """Rows are in order of their bytes; merging arrays gives the array of all; a scan settles and marks as the texts say."""
    rng = np.random.default_rng(5)
    say = lambda n: bytes(rng.integers(97, 103, n).tolist())
    shared = say(300)
    texts = [say(200) + shared[: 80 + i] + say(90) for i in range(40)] + [shared, shared]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = suffix_index.suffix_rows(data, at, np.arange(len(texts)), np.zeros(len(texts), np.int64))
    whole = suffix_index.merged(rows)
    heads = [texts[r["ord"]][r["s"] + r["at"] :][: suffix_index.ANCHOR] for r in whole]
    assert heads == sorted(heads) and len(heads) > 300
    parts = [suffix_index.merged(p) for p in np.array_split(rows, 3)]
    assert (suffix_index.merged(*parts) == whole).all()
    covered = np.zeros(len(data), int)
    for r in rows:  # each window of a text has one anchor
        covered[at[r["ord"]] + r["s"] : at[r["ord"]] + r["s"] + r["n"]] += 1
    assert all((covered[a : max(a, b - 49)] == 1).all() and not covered[max(a, b - 49) : b].any() for a, b in zip(at[:-1], at[1:], strict=True))
    first, second = (suffix_index.merged(rows[rows["ord"] < 20]), suffix_index.merged(rows[rows["ord"] >= 20]))
    _, _, level = suffix_index.scan(first, first[:0], first[:0])
    settled, marked, both = suffix_index.scan(second, level.copy(), first[:0])
    assert len(settled) and len(marked)
    keys = both[["k", "l", "h"]]
    assert len(np.unique(keys)) == len(both) and set(keys.tolist()) == set(whole[["k", "l", "h"]].tolist())
    settled_too, marked_too, none = suffix_index.scan(second, first[:0], level.copy())
    assert (settled == settled_too).all() and len(marked_too) == len(marked) and len(none) < len(both)


def test_windows_by_common_prefixes():
    rng = np.random.default_rng(7)
    left, right = rng.integers(0, 2, (60, 17)).astype(np.uint8), np.zeros((60, 50), np.uint8)
    right[:, 40:] = rng.integers(0, 2, (60, 10))
    left[:, 3:] = 0
    ids, low = rng.integers(0, 30, 60), rng.integers(0, 9, 60)
    high = low + rng.integers(0, 9, 60)
    got = suffix_index.repeated_windows(left, right, ids, low, high)
    for i in range(60):
        for j in range(35):
            same = [k for k in range(60) if low[k] <= j <= high[k] and (left[k, :j] == left[i, :j]).all() and (right[k, : 50 - j] == right[i, : 50 - j]).all()]
            assert got[i, j] == (low[i] <= j <= high[i] and any(ids[k] < ids[i] for k in same))
