"""Fill-in-middle, tokenizer alignment and source mixing against plain versions and the given SQL."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bomloom.llm import alignment, fim, mixing, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def filled(key, text):
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = text or ""
    drawn = sha(f"42:{'' if key is None else key}")
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


MARKED = ["a <P> b", "<S>", "x<M>", "a < P> b <", "<<P", "S><", "<P", "> <S", "\n", " a", "a ", "漢 🙂\t\n", "ends in <", "é" * 40]


def in_sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    found = con.execute(sql)
    return [c[0] for c in found.description], sorted(found.fetchall(), key=str)


def test_fill_in_middle(spark, docs, texts):
    rows = texts + [(20_000 + i, t) for i, t in enumerate(MARKED * 12)] + [(None, "a b c"), (None, "a b c"), (-7, "a b c d e f")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("source", F.lit("x")).withColumn("n", F.lit(1)).withColumn("_h1", F.lit("y"))
    got = fim.fill_in_middle(table).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((k, *filled(k, t), t or "") for k, t in rows)
    assert Counter(tuple(r) for r in got) == want and {r.form for r in got} == {"plain", "psm", "spm"}
    digests = fim.op11_fill_in_middle(table)
    names, said = in_sql(fim.OP11_SQL, table)
    assert digests.columns == names and sorted((tuple(r) for r in digests.collect()), key=str) == said
    assert said == sorted(((k, *filled(k, t)[:4], sha(filled(k, t)[4]), sha(t or "")) for k, t in rows), key=str)


def test_fill_in_middle_always_and_never(docs):
    forms = {(rate, spm): {r.form for r in fim.fill_in_middle(docs.where("length(text) > 0"), rate=rate, spm=spm).collect()} for rate, spm in ((100, 100), (100, 0), (0, 50))}
    assert forms == {(100, 100): {"spm"}, (100, 0): {"psm"}, (0, 50): {"plain"}}


def test_cuts_are_drawn_evenly():
    """Each of n + 1 places is drawn as often as any other."""
    data, at = np.frombuffer(b"aa bb cc " * 4000, np.uint8), np.arange(4001) * 9
    found = fim.cuts(data, at, np.arange(4000), np.full(4000, 4))
    assert set(found.n) == {4} and Counter((found.first - at[:-1]).tolist()) == {0: 800, 2: 800, 5: 800, 8: 800, 9: 800}


TOKENIZERS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def aligned(rows):
    """op12's rows, plainly: ends of both sides, and a counter of pairs."""
    a, b = Tokenizer.from_file(TOKENIZERS[0]), sentencepiece.SentencePieceProcessor(model_file=TOKENIZERS[1])
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    say_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    say_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    groups = []
    for _, text in rows:
        groups.append([])
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        said = [*map(say_a, ids[0])], [*map(say_b, ids[1])]
        if not b"".join(said[0]) == b"".join(said[1]) == (" " + text).encode():
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in said]
        before = 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            groups[-1].append(tuple([i for i, e in zip(ids[k], ends[k], strict=True) if before < e <= end] for k in (0, 1)))
            before = end
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for g in groups]
    count = Counter(pair for x in links for pair in set(x))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (key, _), g, pairs in zip(rows, groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(pairs), sum(count[p] == highest[p[0]] for p in pairs), sum(count[p] for p in pairs), sha(said) if g else ""))
    return out, count, highest


ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "▁", "a ▁ b", "</s> <s>", "<|endoftext|>", "= " * 300, "=" * 999, "漢字 かな" * 20, "\x85x 　 y", "it's 123 's", "a\t\tb", "é é", "Ж ـ ‍🙂"]


def test_tokenizer_alignment(spark, texts):
    texts = [(k, t[:5000] if t else t) for k, t in texts]
    rows = texts + [(20_000 + i, t) for i, t in enumerate(ODD * 2)] + [(None, "a b c"), (None, None), (7, "two words"), (7, "two words")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("batch", F.lit("x")).withColumn("pair", F.lit(1))
    want, count, highest = aligned(rows)
    assert sorted((tuple(r) for r in alignment.op12_tokenizer_alignment(table).collect()), key=str) == sorted(want, key=str)
    assert any(x[1] for x in want) and any(not x[1] for x in want) and any(x[3] < min(x[1:3]) for x in want)
    found = {(r.id_a, r.id_b): (r["count"], r.best) for r in alignment.pair_counts(table, *TOKENIZERS).collect()}
    assert found == {p: (n, n == highest[p[0]]) for p, n in count.items()}
    groups = {r.doc_id: r.groups for r in alignment.align(table, *TOKENIZERS).collect()}
    assert all(sha(groups[x[0]]) == x[7] for x in want if x[3] and x[0] is not None)


def test_tokenizer_alignment_of_real_texts(real):
    table, rows = real
    assert sorted((tuple(r) for r in alignment.op12_tokenizer_alignment(table).collect()), key=str) == sorted(aligned(rows)[0], key=str)


def test_small_batches_and_evicted_parts(monkeypatch):
    """What a worker keeps, and how much it does at once, changes nothing."""
    v = alignment.Vocabularies(*TOKENIZERS)
    texts = ["one two three", None, "three two", "", "漢字 two", "▁ no", "one one one"] * 3
    whole = alignment._of_texts(texts, v)
    for name in ("KEPT_PARTS", "_TOGETHER", "_PARTS_AT_ONCE"):
        monkeypatch.setattr(alignment, name, 1)
    for _ in range(2):
        parts = alignment._of_texts(texts, v)
        assert all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True))


def test_union_find():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (5, 3), (400, 300), (3000, 2900)):
        a, b = rng.integers(0, n, (2, m))
        root = alignment.union_find(n, a, b)
        near = {i: {i} for i in range(n)}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if near[x] is not near[y]:
                one = near[x] | near[y]
                near.update(dict.fromkeys(one, one))
        assert root.tolist() == [min(near[i]) for i in range(n)]
    chain = np.arange(9999)
    assert not alignment.union_find(10_000, chain, chain + 1).any()


def targets(sizes, weights, repeats=3):
    """Shares by weight, again and again among those that are not at their bound."""
    out, open_, rest = {}, dict(weights), sum(sizes.values())
    while open_:
        share = rest / sum(open_.values())
        full = [s for s, w in open_.items() if w * share >= repeats * sizes[s]]
        if not full:
            return out | {s: w * share for s, w in open_.items()}
        for s in full:
            out[s] = repeats * sizes[s]
            rest -= out[s]
            del open_[s]
    return out


def highest_quotients(votes, seats):
    quotients = sorted((-v / (2 * k + 1), s) for s, v in votes.items() for k in range(seats) if v)
    return Counter(s for _, s in quotients[:seats])


def sources_of(seed=4):
    """Documents of many sources: a hot one, tiny ones, an empty one, a null one, and one with a single long document."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in [("hot", 300), ("é", 40), ("b", 30), ("a", 1), (None, 12), ("none", 2), ("", 5), ("z", 60)]:
        for _ in range(n):
            words = 0 if name == "none" else int(rng.integers(1, 60)) if name != "a" else 3
            rows.append((len(rows), " ".join(["w"] * words) + rng.choice(["", " ", "\n"]), name))
    return [*rows, (900, "one " * 4000, "b"), (901, None, "b"), (None, "x y", "b"), (None, "x y", "b"), (900, "again and again", "z")]


@pytest.mark.parametrize("sizes", [(64, 400), (1024, 1 << 20), (7, 50)])
def test_source_mixing(spark, sizes):
    rows = sources_of()
    block, shard_words = sizes
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("name", F.lit(1)).withColumn("size", F.lit("x"))
    mixed = mixing.mix(docs, block=block, shard_words=shard_words)
    taken = mixing.taken_words(F.col("size"), F.col("passes"), F.col("spans"))
    got = mixed.withColumn("taken", taken).collect()
    own = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, own(t)) for k, t, _ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    held = {s: sum(own(t) for _, t, x in rows if x == s) for s in names}
    wanted = targets(held, {s: i % 3 + 1 for i, s in enumerate(names)})
    by_size = {held[s]: s for s in names}
    assert len(by_size) == len(names)
    gives = defaultdict(int)
    for r in got:
        source = by_size[r.source_size]
        gives[source] += r.taken
        assert abs(r.target - wanted[source]) < 1e-6 and r.taken <= 3 * r["size"] and all(0 <= x.begin < x.end <= r["size"] for x in r.spans)
    assert all(gives[s] == int(wanted[s] + 0.5) for s in names)
    again = mixing.mix(docs.repartition(5), block=block, shard_words=shard_words).withColumn("taken", taken)
    assert Counter((r.doc_id, r.taken) for r in again.collect()) == Counter((r.doc_id, r.taken) for r in got)
    other = mixing.mix(docs, seed=43, block=block, shard_words=shard_words).withColumn("taken", taken)
    assert Counter((r.doc_id, r.taken) for r in other.collect()) != Counter((r.doc_id, r.taken) for r in got)


def test_apportionment(spark):
    """Quotas are those of the highest quotients; on the smallest and on odd votes."""
    rng = np.random.default_rng(6)
    cases = {g: ({i: float(v) for i, v in enumerate(rng.integers(0, 60, n).tolist())}, seats) for g, (n, seats) in enumerate([(1, 5), (7, 3), (7, 100), (30, 29), (12, 0), (5, 2), (40, 1000)])}
    rows = [(g, i, v, seats) for g, (votes, seats) in cases.items() for i, v in votes.items()]
    df = spark.createDataFrame(rows, "g int, i int, v double, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportioned(df, "g", "seats", "v", "i").collect()}
    for g, (votes, seats) in cases.items():
        want = highest_quotients(votes, seats)
        assert {i: got[g, i] for i in votes} == {i: want[i] for i in votes}


def test_source_mixing_in_sql(spark, real):
    odd = spark.createDataFrame([(k, t, s) for k, t, s in sources_of() if k is not None], "doc_id long, text string, source string")
    for table in (real[0], odd):
        names, said = in_sql(mixing.OP13_SQL, table)
        out = mixing.op13_source_mixing(table)
        assert out.columns == names and sorted((tuple(r) for r in out.collect()), key=str) == said


def test_source_mixing_is_native(real):
    plan = mixing.op13_source_mixing(real[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixed_texts(spark):
    df = spark.createDataFrame([(" a b\n c d ", 2, [(1, 3)]), ("x", 0, [])], "text string, passes long, spans array<struct<begin:long,end:long>>")
    got = df.select(mixing.mixed_texts(F.col("text"), F.col("passes"), F.col("spans"))).collect()
    assert [r[0] for r in got] == [[" a b\n c d ", " a b\n c d ", "b\n c"], []]


def test_queries_with_sql(spark):
    """The registered queries against their SQL on given tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, sql in queries.oracle_sql().items():
        names, said = in_sql(sql, docs)
        out = queries.queries()[name](spark, SF).select(*names)
        assert sorted((tuple(r) for r in out.collect()), key=str) == said
