"""Language-model scores from a log-frequency Bloom filter.

The word and word-pair counts of the training texts are gathered by hash. Each hash range
gets a block of the filter, which holds an n-gram once for every level of its quantised
(log) count; blocks are bounded in size, whatever the corpus, and are stored with the
exact counts that the base score takes. A probe repeats with one level after the other
until one is missing: the last level found gives the count. The filter as a whole grows
with the corpus, so no worker gets all of it: n-grams of the texts to score go to the
worker that has their block, and probabilities are made of the answers. Where the texts to
score hold those of training, their n-grams go there once, with the counts.

With c the quantised counts that the filter gives, a word w after u has the probability
(c(u, w) + t(u) p(w)) / (c(u) + t(u)), where t(u) is how many different words follow u in
training (Witten and Bell's estimate of how often a new one does), c(u) is the sum of
their c(u, w), and p(w) = (c(w) + 1) / (sum of c + types + 1). Both sum to 1 over the
words of training and one unknown word, but for what the filter wrongly finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACED, Chunk, Hasher, bounded_batches, chunks, give_back, lower, mix, unmix, words
from ._tables import shuffle_files_end_with_each_job, written
from .toxicity import held_out

#: Bits of the filter for each level of an n-gram, probes of each, and levels a decade of counts.
BITS, PROBES, DECADE = 14, 5, 6
#: Text whose n-grams one range holds, about.
RANGE_BYTES = 8 << 20
_CHUNK = 4 << 20
#: Bits of a pair's hash that are its history's.
_HISTORY = 28
_END = np.uint64(0x51ED270B3A1F4C6D)
_START = np.uint64(0x2545F4914F6CDD1D)
#: Kinds of records: n-grams and their levels, exact counts of words, sums by history, and what a model holds.
_WORD, _PAIR, _COUNT, _MASS, _FOLLOWERS, _EXACT, _WORD_FILTER, _PAIR_FILTER = range(8)


class Model(NamedTuple):
    """table: counts and filter blocks by range; masses: the summed counts of each history, and its followers; tokens, types: of training; mass: of all words' quantised counts."""

    table: DataFrame
    masses: DataFrame
    ranges: int
    tokens: int
    types: int
    mass: float


def level(count: np.ndarray) -> np.ndarray:
    """The quantised logarithm of counts: 1 for 1, and then DECADE levels a decade."""
    return np.where(count > 0, 1 + np.round(DECADE * np.log10(np.maximum(count, 1))), 0).astype(np.int64)


def dequantised(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, 10 ** ((levels.astype(np.float64) - 1) / DECADE), 0.0)


class BloomCounts:
    """A block of a log-frequency Bloom filter over 64-bit n-gram hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, bits: int = BITS) -> BloomCounts:
        levels = level(counts)
        size = -(-max(64, int(levels.sum()) * bits) // 8) * 8
        on = np.zeros(size, bool)
        step, live = 1, np.flatnonzero(levels > 0)
        while len(live):
            a, b = _hashes(grams[live], step)
            for i in range(PROBES):
                on[_place(a, b, i, size)] = True
            step += 1
            live = live[levels[live] >= step]
        return cls(np.packbits(on, bitorder="little"))

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The largest level of each n-gram up to which no level is missing; 0 if it isn't in the filter."""
        out = np.zeros(len(grams), np.uint8)
        step, live = 1, np.arange(len(grams))
        while len(live) and step < 256:
            a, b = _hashes(grams[live], step)
            for i in range(PROBES):
                at = _place(a, b, i, len(self.bits) * 8)
                there = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                a, b, live = a[there], b[there], live[there]
            out[live] = step
            step += 1
        return out


def _hashes(grams: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(grams + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return a, mix(a) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Where a probe looks in a block of less than 2^32 bits."""
    return (((a + np.uint64(probe) * b) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def history(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - _HISTORY)


def pair_history(pair: np.ndarray) -> np.ndarray:
    return history(unmix(pair))


def _tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens, of those before them, of the pairs, text number); each text's last token is its end."""
    c = c._replace(data=lower(c.data))
    start, end, doc = words(c, SPACED)
    n = len(c.ids)
    count = np.bincount(doc, minlength=n)
    place = np.arange(len(start)) + doc
    h = np.full(len(start) + n, _END, np.uint64)
    h[place] = Hasher(c.data)(start, end)
    own = np.repeat(np.arange(n), count + 1)
    before = np.concatenate([[_START], h[:-1]])
    before[np.concatenate([[0], np.cumsum(count + 1)[:-1]])[: n if n else 0]] = _START
    return h, before, mix(history(before) << np.uint64(64 - _HISTORY) | mix(h) >> np.uint64(_HISTORY)), own


def _range(grams: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; a word's is its history's."""
    return (history(grams) * np.uint64(ranges) >> np.uint64(_HISTORY)).astype(np.int64)


def _distinct(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, their summed weights, where each h is among them)."""
    value, inverse = np.unique(h, return_inverse=True)
    return value, np.bincount(inverse, weight, minlength=len(value)).astype(np.int64), inverse


def _dealt(value: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, part) of sorted hashes."""
    bucket = _range(value, ranges)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), slice(a, b)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of texts as one row with a name."""
    import zstandard
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = 0
        for c in chunks(iter([batch]), limit=_CHUNK):
            part = pa.RecordBatch.from_arrays([c.ids, pa.array(c.at[1:]), batch.column("train")[at : at + len(c.ids)]], names=["_key", "end", "train"])
            at += len(c.ids)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([small.compress(c.data.tobytes())], pa.binary())], names=["chunk", "rows", "texts"])
            number += 1


def _unpacked(rows: bytes, texts: bytes) -> tuple[Chunk, np.ndarray]:
    """(the chunk, which of its texts train)."""
    import zstandard

    part = pa.ipc.open_stream(rows).read_all().combine_chunks()
    ids = pa.concat_arrays(part.column("_key").chunks)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    return Chunk(ids, data, np.concatenate([[0], part.column("end").to_numpy()])), part.column("train").to_numpy()


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _whole(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def _gathered(ranges: int, training: bool):
    """For each chunk and range: its sorted words (and the start of texts), and word pairs, with their counts in training; only those of training, or all."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw, texts in zip(*(batch.column(k).to_pylist() for k in ("chunk", "rows", "texts")), strict=True):
                c, train = _unpacked(raw, texts)
                h, _, pair, own = _tokens(c)
                used = train[own]
                rows = []
                for kind, grams in ((_WORD, h), (_PAIR, pair)):
                    if training:
                        value, n = np.unique(grams[used], return_counts=True)
                    else:
                        value, n, _ = _distinct(np.append(grams, _START), np.append(used, False).astype(np.float64)) if kind == _WORD else _distinct(grams, used.astype(np.float64))
                    rows += [(kind, b, _planes(value[part]), _planes(n[part].astype("<u4"))) for b, part in _dealt(value, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3))], names=["chunk", "kind", "bucket", "grams", "counts"])
                give_back()

    return gather


_GATHERED = "chunk string, kind long, bucket long, grams binary, counts binary"
#: What a range holds and says: exact counts and blocks (chunk is null), sums by history (bucket is the history), and answers to chunks.
_MODEL = "chunk string, kind long, bucket long, grams binary, counts binary, tokens long, types long, mass double"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
_NAMES = ("chunk", "kind", "bucket", "grams", "counts", "tokens", "types", "mass")


def _answers(chunk: str, kind: int, bucket: int, found: np.ndarray, exact: np.ndarray) -> Iterator[tuple]:
    """The answers to one chunk's words or word pairs: levels, and of words the exact counts."""
    yield chunk, kind, bucket, found.tobytes(), None, 0, 0, 0.0
    if kind == _WORD:
        yield chunk, _COUNT, bucket, _planes(exact.astype("<u8")), None, 0, 0, 0.0


def _fitted(bits: int, answering: bool):
    def fitted(key: tuple, table: pa.Table) -> pa.Table:
        """One range: its exact word counts, the filter's blocks, the sums of quantised counts by history, and answers to those who sent the n-grams."""
        bucket, kinds = key[0].as_py(), table.column("kind").to_numpy()
        out: list[tuple] = []
        sums = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        for kind, stored in ((_WORD, _WORD_FILTER), (_PAIR, _PAIR_FILTER)):
            part = table.filter(pa.array(kinds == kind))
            if not part.num_rows:
                continue
            names, sent, counts = part.column("chunk").to_pylist(), part.column("grams").to_pylist(), part.column("counts").to_pylist()
            value, n, at = _distinct(np.concatenate([_whole(x, "<u8") for x in sent]), np.concatenate([_whole(x, "<u4") for x in counts]).astype(np.float64))
            block = BloomCounts.of(value, n, bits)
            levels = block.levels(value)
            if answering:
                i = 0
                for name, x in zip(names, sent, strict=True):
                    own = at[i : (i := i + len(x) // 8)]
                    out += _answers(name, kind, bucket, levels[own], n[own])
            seen = n > 0
            value, n, found = value[seen], n[seen], dequantised(levels[seen])
            if kind == _WORD:
                out.append((None, _EXACT, bucket, _planes(value), _planes(n.astype("<u8")), int(n.sum()), len(value), float(found.sum())))
            else:
                before, inverse = np.unique(pair_history(value), return_inverse=True)
                sums = [before.astype(np.int64), np.bincount(inverse, found, minlength=len(before)), np.bincount(inverse, minlength=len(before))]
            out.append((None, stored, bucket, block.bits.tobytes(), None, 0, 0, 0.0))
        m = len(sums[0])
        head = pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(_NAMES, _TYPES, strict=True))})
        none = pa.nulls(m, pa.binary())
        history_rows = [pa.nulls(m, pa.string()), pa.array(np.full(m, _MASS)), pa.array(sums[0].astype(np.int64)), none, none, pa.array(np.zeros(m, np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[1].astype(np.float64))]
        give_back()
        return pa.concat_tables([head, pa.table(history_rows, names=_NAMES)])

    return fitted


def _answered(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
    """The answers of one range of a stored model to what chunks ask."""
    own = {k: model.filter(pa.array(model.column("kind").to_numpy() == k)) for k in (_EXACT, _WORD_FILTER, _PAIR_FILTER)}
    known, counts = (np.concatenate([np.empty(0, "<u8"), *(_whole(x, "<u8") for x in own[_EXACT].column(c).to_pylist())]) for c in ("grams", "counts"))
    blocks = {kind: [BloomCounts(np.frombuffer(x, np.uint8)) for x in own[stored].column("grams").to_pylist()] for kind, stored in ((_WORD, _WORD_FILTER), (_PAIR, _PAIR_FILTER))}
    out: list[tuple] = []
    for chunk, kind, raw in zip(*(asked.column(c).to_pylist() for c in ("chunk", "kind", "grams")), strict=True):
        value = _whole(raw, "<u8")
        found = blocks[kind][0].levels(value) if blocks[kind] else np.zeros(len(value), np.uint8)
        out += _answers(chunk, kind, key[0].as_py(), found, _looked_up(known, counts, value))
    give_back()
    return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(_NAMES, _TYPES, strict=True)) if k in ("chunk", "kind", "bucket", "grams")})


def _histories(ranges: int):
    """For each chunk and range: its sorted words (and the start of texts)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw, texts in zip(*(batch.column(k).to_pylist() for k in ("chunk", "rows", "texts")), strict=True):
                value = np.unique(np.append(_tokens(_unpacked(raw, texts)[0])[0], _START))
                rows = [(b, _planes(history(value[part]).astype("<u4"))) for b, part in _dealt(value, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bucket", "grams"])
                give_back()

    return ask


def _massed(key: tuple, asked: pa.Table, masses: pa.Table) -> pa.Table:
    """The summed counts and the followers of the histories that chunks ask for."""
    before, mass, followers = (masses.column(c).to_numpy() for c in ("history", "mass", "types"))
    by = np.argsort(before)
    before, mass, followers = before[by], mass[by], followers[by]
    out = []
    for chunk, raw in zip(*(asked.column(c).to_pylist() for c in ("chunk", "grams")), strict=True):
        wanted = _whole(raw, "<u4").astype(np.int64)
        out.append((chunk, _MASS, key[0].as_py(), _planes(_looked_up(before, mass, wanted).astype("<f8"))))
        out.append((chunk, _FOLLOWERS, key[0].as_py(), _planes(_looked_up(before, followers, wanted).astype("<u4"))))
    give_back()
    return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(_NAMES[:4], _TYPES[:4], strict=True))})


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys among sorted ones, or 0."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _scored(tokens: int, types: int, mass: float):
    """Scores of the texts of one chunk from the answers to its n-grams."""

    def score(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.lexsort((replies.column("bucket").to_numpy(), replies.column("kind").to_numpy()))
        parts: dict[int, list[bytes]] = {k: [] for k in (_WORD, _PAIR, _COUNT, _MASS, _FOLLOWERS)}
        for r in replies.select(["kind", "grams"]).take(pa.array(order)).to_pylist():
            parts[r["kind"]].append(r["grams"])
        word, pairs = (dequantised(np.frombuffer(b"".join(parts[k]), np.uint8)) for k in (_WORD, _PAIR))
        exact, masses, followers = (np.concatenate([np.empty(0, t), *(_whole(x, t) for x in parts[k])]) for k, t in ((_COUNT, "<u8"), (_MASS, "<f8"), (_FOLLOWERS, "<u4")))
        out = []
        for raw, packed in zip(texts.column("rows").to_pylist(), texts.column("texts").to_pylist(), strict=True):
            c, _ = _unpacked(raw, packed)
            ids, n = c.ids, len(c.ids)
            h, before, pair, own = _tokens(c)
            value = np.unique(np.append(h, _START))
            at = np.searchsorted(value, h)
            count, single = exact[at].astype(np.float64), word[at]
            u = np.searchsorted(value, before)
            all_pairs, new = masses[u], np.maximum(followers[u].astype(np.float64), 1)
            both = np.where((all_pairs > 0) & (single > 0), pairs[np.unique(pair, return_inverse=True)[1]], 0)
            p = (both + new * (single + 1) / (mass + types + 1)) / (all_pairs + new)
            sums = lambda x: np.bincount(own, x, minlength=n)
            out.append(pa.table({"_key": ids, "n_tokens": sums(np.ones(len(h))).astype(np.int64), "n_known": sums(count > 0).astype(np.int64), "base_score": sums(np.log10((count + 1) / (tokens + types + 1))), "score": sums(np.log10(p))}))
        give_back()
        return pa.concat_tables(out)

    return score


def _ranges(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, size // RANGE_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _chunked(docs: DataFrame, train, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    return written(rows.mapInArrow(_packed_texts, "chunk string, rows binary, texts binary"))


def _model(table: DataFrame, ranges: int) -> Model:
    tokens, types, mass = table.where(F.col("kind") == _EXACT).agg(F.sum("tokens"), F.sum("types"), F.sum("mass")).first()
    by_history = table.where(F.col("kind") == _MASS).groupBy(F.col("bucket").alias("history")).agg(F.sum("mass").alias("mass"), F.sum("types").alias("types"))
    masses = written(by_history.select(F.shiftright(F.col("history") * ranges, _HISTORY).alias("bucket"), "history", "mass", "types"))
    return Model(table, masses, ranges, tokens or 0, types or 0, mass or 0.0)


def fit(docs: DataFrame, train, key: str = "doc_id", bits: int = BITS) -> Model:
    """The model of the rows of docs for which train is true: every n-gram of each of them is counted."""
    bounded_batches(docs.sparkSession)
    ranges = _ranges(docs)
    with shuffle_files_end_with_each_job(docs.sparkSession):
        gathered = _chunked(docs, train, key).mapInArrow(_gathered(ranges, True), _GATHERED)
        return _model(written(gathered.groupBy("bucket").applyInArrow(_fitted(bits, False), _MODEL), "kind"), ranges)


def score(docs: DataFrame, train=None, key: str = "doc_id", model: Model | None = None, bits: int = BITS) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score for each row, by a model, or by that of the rows for which train is true.

    Tokens are a text's words, lower-cased, and its end; a null or empty text has the end
    alone. Keys stay as they are, null or repeated. A row whose train is null is no
    training row. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    packed = _chunked(docs, F.lit(False) if train is None else train, key)
    ranges = model.ranges if model else _ranges(docs)
    gathered = packed.mapInArrow(_gathered(ranges, False), _GATHERED)
    with shuffle_files_end_with_each_job(spark):
        if model:
            blocks = model.table.where(F.col("kind") >= _EXACT).select("kind", "bucket", "grams", "counts")
            answers = written(gathered.drop("counts").groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(_answered, "chunk string, kind long, bucket long, grams binary"))
        else:
            found = written(gathered.groupBy("bucket").applyInArrow(_fitted(bits, True), _MODEL), "kind")
            model = _model(found, ranges)
            answers = found.where(F.col("kind") <= _COUNT).select("chunk", "kind", "bucket", "grams")
        asked = packed.mapInArrow(_histories(ranges), "chunk string, bucket long, grams binary")
        massed = written(asked.groupBy("bucket").cogroup(model.masses.groupBy("bucket")).applyInArrow(_massed, "chunk string, kind long, bucket long, grams binary"))
    answers = answers.unionAll(massed)
    scored = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(model.tokens, model.types, model.mass), f"_key {dict(docs.dtypes)[key]}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_key").alias(key), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(documents: DataFrame) -> DataFrame:
    """Scores of all documents by score(), which says how odd input counts; learnt from those whose crc32(doc_id) mod 7 is not 2."""
    held = F.coalesce(held_out("doc_id", 7, 2), F.lit(False))
    return score(documents, ~held_out("doc_id", 7, 2)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
