"""Benchmark decontamination: an FM-index per shard of the training text.

Each shard (a bounded run of documents) is cut to the words that benchmark items use,
kept in runs that are long enough to hold a phrase, and indexed: suffix array,
Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. All phrases of
the benchmark are searched backward through it at once; their occurrences are located,
and overlapping ones merge into removal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Chunk, Hasher, bounded_batches, byte_class, chunks, lower, text_buffers, words
from ._tables import written

WINDOW = 10
#: Bytes of benchmark text whose phrases are sent to the executors at once; a larger benchmark is searched in blocks.
BLOCK = 8 << 20
_WORD = byte_class(r"(?s)[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
_STEP = 4


class Phrases(NamedTuple):
    """words: sorted hashes; by_length: length -> phrases as rows of word numbers from 1; items: for each phrase, over all lengths in order, the names of its items."""

    words: np.ndarray
    by_length: dict[int, np.ndarray]
    items: list[list[str]]


def _hashed(chunk: Chunk) -> tuple[np.ndarray, ...]:
    chunk = chunk._replace(data=lower(chunk.data))
    start, end, doc = words(chunk, _WORD)
    return Hasher(chunk.data)(start, end), start, end, doc


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """The distinct windows of (name, text) items; an item with fewer words is one window."""
    data, at = text_buffers(pa.array([t or "" for _, t in items], pa.string()))
    h, _, _, doc = _hashed(Chunk(pa.array(range(len(items))), data, at))
    known, number = np.unique(h, return_inverse=True)
    found: dict[int, dict[tuple, set]] = {}
    cut = np.searchsorted(doc, np.arange(len(items) + 1))
    for i, (name, _) in enumerate(items):
        own = tuple((number[cut[i] : cut[i + 1]] + 1).tolist())
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(own[k : k + n], set()).add(name)
    found = {n: found[n] for n in sorted(found)}
    return Phrases(known, {n: np.array(list(x), np.int64).reshape(-1, n) for n, x in found.items()}, [sorted(s) for x in found.values() for s in x.values()])


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order; each 0 is an end of its own, less than any word."""
    n = len(s)
    ends = s == 0
    rank = np.where(ends, np.cumsum(ends), s + ends.sum())
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        following[ends] = 0
        key = rank * (n + int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search over a sequence of word numbers in which 0 separates runs."""

    def __init__(self, s: np.ndarray, top: int):
        n = len(s)
        order = suffix_order(s)
        bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.levels, self.zeros = [], []
        self.bits = max(1, int(top).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            on = (bwt >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(on, dtype=np.int64)]))
            self.zeros.append(n - int(self.levels[-1][-1]))
            bwt = np.concatenate([bwt[on == 0], bwt[on == 1]])
        begins = np.ones(n, bool)
        begins[1:] = s[:-1] == 0
        kept = (order % _STEP == 0) | begins[order]
        self.sampled = kept
        self.sample_rank = np.cumsum(kept) - 1
        self.samples = order[kept]

    def rank(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each word stands in the first i places of the transform."""
        low = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            on = (word >> (self.bits - 1 - level)) & 1 == 1
            i = np.where(on, zeros + ones[i], i - ones[i])
            low = np.where(on, zeros + ones[low], low - ones[low])
        return i - low

    def at(self, i: np.ndarray) -> np.ndarray:
        """The words at places of the transform."""
        word = np.zeros_like(i)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            on = ones[i + 1] - ones[i]
            word = word * 2 + on
            i = np.where(on == 1, zeros + ones[i], i - ones[i])
        return word

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (empty where low = high)."""
        low = np.zeros(len(rows), np.int64)
        high = np.full(len(rows), int(self.first[-1]), np.int64)
        live = np.arange(len(rows))
        for j in range(rows.shape[1] - 1, -1, -1):
            word = rows[live, j]
            low[live] = self.first[word] + self.rank(word, low[live])
            high[live] = self.first[word] + self.rank(word, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Positions of suffixes, walking back to sampled ones."""
        out, step, todo = np.zeros(len(i), np.int64), 0, np.arange(len(i))
        while len(todo):
            there = self.sampled[i]
            out[todo[there]] = self.samples[self.sample_rank[i[there]]] + step
            todo, i = todo[~there], i[~there]
            word = self.at(i)
            i, step = self.first[word] + self.rank(word, i), step + 1
        return out


def _occurrences(h: np.ndarray, doc: np.ndarray, model: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, length) of each occurrence among the hashed words of a shard."""
    none = np.empty(0, np.int64)
    if not len(h) or not model.items:
        return none, none, none
    at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
    number = np.where(model.words[at] == h, at + 1, 0)
    new_run = np.ones(len(h), bool)
    new_run[1:] = (doc[1:] != doc[:-1]) | ((number[1:] > 0) != (number[:-1] > 0))
    run = np.cumsum(new_run) - 1
    kept = np.flatnonzero((number > 0) & (np.bincount(run)[run] >= min(model.by_length)))
    if not len(kept):
        return none, none, none
    gaps = np.concatenate([[0], np.cumsum(np.diff(run[kept]) != 0)])
    place = np.arange(len(kept)) + gaps
    s, word = np.zeros(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
    s[place], word[place] = number[kept], kept
    index, base, out = FMIndex(s, len(model.words)), 0, []
    for n, rows in model.by_length.items():
        low, high = index.search(rows)
        count = high - low
        phrase = np.repeat(np.arange(len(rows)), count)
        places = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append((phrase + base, word[index.locate(places)], np.full(len(phrase), n)))
        base += len(rows)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Found(NamedTuple):
    """Of each text of a chunk: its number of words, the names of items with occurring windows, and removal spans."""

    n_words: np.ndarray
    items: list[list[str]]
    spans: list[list[dict[str, int]]]


def scan(c: Chunk, model: Phrases) -> Found:
    n = len(c.ids)
    h, start, end, doc = _hashed(c)
    phrase, first, length = _occurrences(h, doc, model)
    depth = np.zeros(len(h) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + length, -1)
    hit = np.cumsum(depth)[:-1] > 0
    edge = np.diff(np.concatenate([[0], (hit * (doc + 1)), [0]])) != 0
    left = np.flatnonzero(edge[:-1] & hit)
    right = np.flatnonzero(edge[1:] & hit)
    names: dict[int, set] = {}
    for p, d in set(zip(phrase.tolist(), doc[first].tolist(), strict=True)):
        names.setdefault(d, set()).update(model.items[p])
    spans: list[list] = [[] for _ in range(n)]
    begins = np.searchsorted(doc, np.arange(n))
    for d, a, b, i, j in zip(doc[left].tolist(), start[left].tolist(), end[right].tolist(), left.tolist(), right.tolist(), strict=True):
        spans[d].append({"first": i - int(begins[d]), "last": j + 1 - int(begins[d]), "start": a - int(c.at[d]), "end": b - int(c.at[d])})
    return Found(np.bincount(doc, minlength=n), [sorted(names.get(d, ())) for d in range(n)], spans)


def _scanned(shared):
    """The key of each document, and what is found in it."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            found = scan(c, shared.value)
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(found.n_words, pa.int64()), pa.array(found.items, pa.list_(pa.string())), pa.array(found.spans, _SPANS)], names=["_key", "n_words", "items", "spans"])

    return scanned


def _cleaned(shared, text: str):
    """The columns of documents as they are, their texts without removal spans."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [s for c in chunks(iter([batch]), key=text, text=text) for s in scan(c, shared.value).spans]
            yield _without(batch, text, spans)

    return cleaned


def _without(batch: pa.RecordBatch, text: str, spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
    """A batch whose texts lack spans; those that have none are not touched."""
    if not any(spans):
        return batch
    texts = []
    for value, own in zip(batch.column(text), spans, strict=True):
        if own:
            raw, parts, last = value.as_py().encode(), [], 0
            for s in own:
                parts.append(raw[last : s["start"]])
                last = s["end"]
            texts.append(b"".join([*parts, raw[last:]]).decode())
        else:
            texts.append(value.as_py())
    return batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, pa.string()))


_SPAN = "struct<first:long,last:long,start:long,end:long>"
_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))


def _blocks(benchmark: DataFrame, item: str, window: int) -> Iterator[Phrases]:
    """Phrases of at most BLOCK bytes of items at a time; the driver holds one block, or the next too."""
    rows, size = [], 0
    for name, text in benchmark.select(F.col(item).cast("string"), "text").where("text IS NOT NULL").toLocalIterator():
        if rows and size + len(text) > BLOCK:
            yield phrases(rows, window)
            rows, size = [], 0
        rows.append((name or "", text))
        size += 4 * len(text)
    yield phrases(rows, window)


def _in_blocks(docs: DataFrame, blocks: Iterator[Phrases]) -> DataFrame:
    """row, n_words, items and spans of each row of docs (doc_id: a number of its own, text), over all blocks.

    One block after the other is broadcast, and what it finds is a table; the blocks meet by row.
    """
    context = docs.sparkSession.sparkContext
    found = []
    for block in blocks:
        shared = context.broadcast(block)
        more = docs.mapInArrow(_scanned(shared), f"_key long, n_words long, items array<string>, spans array<{_SPAN}>")
        found.append(written(more if not found else more.where(F.size("spans") > 0)))
        shared.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.groupBy(F.col("_key").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.expr(_MERGED).alias("spans"))


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """A row per document: key, n_words, items (names of items with occurring windows, sorted as strings), spans (first and, exclusively, last word, start and end byte of each removal span).

    A null or empty text has no words; an item without words is no window, and a null
    name counts as the empty string. Rows are as many as the documents', with their keys
    as they are. Where the benchmark is more than one block, rows are numbered in a table
    first, and what the blocks find meets by that number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(key).alias("doc_id"), "text")
    blocks = _blocks(benchmark, item, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        schema = f"_key {source.schema['doc_id'].dataType.simpleString()}, n_words long, items array<string>, spans array<{_SPAN}>"
        return source.mapInArrow(_scanned(spark.sparkContext.broadcast(first)), schema).withColumnRenamed("_key", key)
    numbered = written(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = _in_blocks(numbered.select(F.col("row").alias("doc_id"), "text"), chain([first, second], blocks))
    return numbered.select("row", F.col("doc_id").alias(key)).join(found, "row").drop("row")


#: Spans of several blocks that overlap or touch, as one.
_MERGED = f"""aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<{_SPAN}>), (acc, x) -> IF(size(acc) > 0 AND x.first <= element_at(acc, -1).last,
  concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last), 'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"""


def _cut(text: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _without(batch, text, [s or [] for s in batch.column("_spans").to_pylist()]).drop_columns(["_spans"])

    return cut


def without_passages(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows of docs with their texts cut: what lies in a removal span is gone. Null texts stay null, other columns as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, text = docs.toDF(*names), names[docs.columns.index("text")]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    blocks = _blocks(benchmark, item, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return rows.mapInArrow(_cleaned(spark.sparkContext.broadcast(first), text), schema).toDF(*docs.columns)
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = _in_blocks(numbered.select(F.col("_row").alias("doc_id"), F.col(text).alias("text")), chain([first, second], blocks))
    spans = found.where(F.size("spans") > 0).select(F.col("row").alias("_row"), F.col("spans").alias("_spans"))
    return numbered.join(spans, "_row", "left").select(*names, "_spans").mapInArrow(_cut(text), schema).toDF(*docs.columns)


def op10_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What find_passages finds in each document, which also says how odd input counts, in digest form."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"]), F.lit(0))
    return find_passages(documents, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans"
    )
