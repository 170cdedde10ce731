"""Alignment of the tokens of two tokenizers, and counts of aligned token pairs.

Tokens of A and B over one text are intervals of its bytes. Those that overlap are edges
of a bipartite graph, whose connected components, found by union-find, are the least
groups that both sides cut at. All pairs within a group are links. A link's count is the
number of texts that hold its pair of ids, over all texts.

Texts are cut into parts where neither vocabulary can join across, and a worker aligns
each distinct part once while it keeps it, all new parts of a batch in one run of the
union-find. A batch of texts asks for the counts of its distinct pairs only: these
requests, a row for each pair and batch, are counted and answered by joins on the pair,
and the answers go back to the batch's texts. No request or answer depends on how often
a pair occurs within a batch, and no table of pairs is held whole anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, give_back
from ._tables import shuffle_files_end_with_each_job, written
from .packing import Encoder

#: Parts that a worker keeps between batches.
KEPT_PARTS = 200_000
#: Parts that are aligned at once.
_TOGETHER = 20_000
#: Parts whose pairs are summed at once; a longer text is alone.
_PARTS_AT_ONCE = 200_000
_SPACE_MARK = "▁"
#: Spaces between two characters that are no white space; and where others are.
_LONE_SPACE, _SPACES = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s")
_vocabularies: dict[tuple[str, str, str | None], Vocabularies] = {}


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def union_find(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges (a, b): roots are hooked under lesser ones, and paths halved, until no edge joins two roots."""
    root = np.arange(nodes)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        root[high[apart]] = low[apart]
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (token of A, token of B) that share a byte, of tokens side by side that end at rising places."""
    places = np.union1d(ends_a, ends_b)  # between two of these lie bytes of one token on either side
    return np.searchsorted(ends_a, places), np.searchsorted(ends_b, places)


class Vocabularies:
    """Both tokenizers of this Python worker, and the bytes of their tokens."""

    def __init__(self, a: str, b: str, ranks: str | None):
        import sentencepiece

        self.a = Encoder(a, ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = byte_letters()
        whole = self.a.whole
        names = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_SPACE_MARK, " ").encode() for i, x in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Whether no piece of B has a space after another letter: then a single space begins a part.
        self.splits = not any(_SPACE_MARK in x.lstrip(_SPACE_MARK) for x in pieces)
        self.parts = Parts(self)

    def cut(self, text: str) -> list[str]:
        """The parts of a text, each of which is encoded with a space before it."""
        if not self.splits or _SPACE_MARK in text:
            return [text]
        return _LONE_SPACE.split(text) if _SPACES.search(text) or text[0] == " " or text[-1] == " " else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [np.frombuffer(self.a.direct(" " + x), "<u4").tolist() for x in texts], self.b.encode(texts, num_threads=1)


class Parts:
    """Aligned parts by number: whether both sides give their bytes, numbers of tokens, groups and links, the groups' text, and pairs with how often each is linked."""

    def __init__(self, vocabularies: Vocabularies):
        self.v, self.number = vocabularies, {}
        self.said: list[bytes] = []
        self.figures = np.empty((0, 5), np.int64)  # ok, tokens of A, of B, groups, links
        self.at, self.pair, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, texts: list[str]) -> None:
        """Align texts that have no number yet, each once."""
        first = len(self.number)
        self.number.update(zip(texts, range(first, first + len(texts)), strict=True))
        found = _aligned(texts, *self.v.encode(texts), self.v)
        self.said += found.said
        self.figures = np.concatenate([self.figures, found.figures])
        self.at = np.concatenate([self.at, self.at[-1] + found.at[1:]])
        self.pair, self.times = np.concatenate([self.pair, found.pair]), np.concatenate([self.times, found.times])


class _Aligned(NamedTuple):
    said: list[bytes]
    figures: np.ndarray
    at: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)


def _expanded(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places at[i] to at[i + 1] of each i of rows, one after the other."""
    count = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())


def _tallied(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of each id of each group, by group."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def _aligned(texts: list[str], ids_a: list[list[int]], ids_b: list[list[int]], v: Vocabularies) -> _Aligned:
    n = len(texts)
    raw = [b" " + x.encode() for x in texts]
    ok = np.array([b"".join(map(v.bytes_a.__getitem__, a)) == x == b"".join(map(v.bytes_b.__getitem__, b)) for x, a, b in zip(raw, ids_a, ids_b, strict=True)], bool)
    a, b = (np.array([i for x, good in zip(ids, ok, strict=True) if good for i in x], np.int64) for ids in (ids_a, ids_b))
    n_a, n_b = (np.array([*map(len, ids)], np.int64) * ok for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(v.sizes_a[a]), np.cumsum(v.sizes_b[b])
    left, right = overlaps(ends_a, ends_b)
    root = union_find(len(a) + len(b), left, len(a) + right)
    # A component's least node is its first token of A, so numbers of roots rise with the text.
    first, group = np.unique(root, return_inverse=True)
    group_a, group_b = group[: len(a)], group[len(a) :]
    part_a = np.repeat(np.arange(n), n_a)
    part = part_a[first] if len(first) else first
    n_groups = np.bincount(part, minlength=n)
    # Pairs of a group: each of its ids of A with each of B, as often as the product of their numbers.
    ga, ia, ta = _tallied(group_a, a)
    gb, ib, tb = _tallied(group_b, b)
    at_b = np.searchsorted(gb, np.arange(len(first) + 1))
    pick = _expanded(at_b, ga)
    repeat = at_b[ga + 1] - at_b[ga]
    of, pair, times = np.repeat(part[ga], repeat), np.repeat(ia, repeat) << 32 | ib[pick], np.repeat(ta, repeat) * tb[pick]
    # A pair may be linked in several groups of a part.
    order = np.lexsort((pair, of))
    of, pair, times = of[order], pair[order], times[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])]) if len(of) else np.empty(0, np.int64)
    times = np.add.reduceat(times, new) if len(new) else times
    of, pair = of[new], pair[new]
    at = np.searchsorted(of, np.arange(n + 1))
    n_links = np.add.reduceat(np.r_[times, 0], at[:-1]) * (at[1:] > at[:-1]) if n else np.empty(0, np.int64)
    text_a, text_b = [*map(str, a.tolist())], [*map(str, b.tolist())]
    cut_a, cut_b = (np.searchsorted(g, np.arange(len(first) + 1)).tolist() for g in (group_a, group_b))
    groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
    cut = np.r_[0, np.cumsum(n_groups)].tolist()
    said = [";".join(groups[i:j]).encode() for i, j in zip(cut, cut[1:], strict=False)]
    return _Aligned(said, np.column_stack([ok, n_a, n_b, n_groups, n_links]).astype(np.int64), at, pair, times)


class Texts(NamedTuple):
    """For each text: tokens of A and B, groups and links; the groups' text; where its pairs lie; pairs (by number in distinct) and how often each is linked."""

    figures: np.ndarray
    said: list[bytes]
    at: np.ndarray
    distinct: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def _of_texts(texts: list[str | None], v: Vocabularies) -> Texts:
    if len(v.parts.number) > KEPT_PARTS:
        v.parts = Parts(v)
    cuts = [v.cut(x) if x else [] for x in texts]
    while True:
        number = v.parts.number
        if new := [*dict.fromkeys(p for c in cuts for p in c if p not in number)]:
            for i in range(0, len(new), _TOGETHER):
                v.parts.add(new[i : i + _TOGETHER])
        sizes = np.array([*map(len, cuts)], np.int64)
        ids = np.fromiter((number[p] for c in cuts for p in c), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.unique(doc[v.parts.figures[ids, 0] == 0])
        if again := [i for i in bad.tolist() if len(cuts[i]) > 1]:
            for i in again:  # its bytes as a whole decide
                cuts[i] = [texts[i]]
            continue
        break
    good = ~np.isin(doc, bad)
    ids, doc = ids[good], doc[good]
    figures = np.column_stack([np.bincount(doc, v.parts.figures[ids, k], len(texts)) for k in range(1, 5)]).astype(np.int64)
    said, at_doc = v.parts.said, np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    numbers = ids.tolist()
    texts_said = [b";".join([said[p] for p in numbers[i:j]]) for i, j in zip(at_doc, at_doc[1:], strict=False)]
    # Some texts at a time, the pairs of all their parts, summed by text and pair.
    ends = np.searchsorted(np.asarray(at_doc[1:]), np.arange(_PARTS_AT_ONCE, len(ids) + _PARTS_AT_ONCE, _PARTS_AT_ONCE), "right")
    found = [_summed(v.parts, ids[at_doc[i] : at_doc[j]], doc[at_doc[i] : at_doc[j]]) for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(texts)], strict=True) if i < j]
    per, pair, times = map(np.concatenate, zip(*found, strict=True))
    distinct, pair = np.unique(pair, return_inverse=True)
    return Texts(figures, texts_said, np.searchsorted(per, np.arange(len(texts) + 1)), distinct, pair, times)


def _summed(parts: Parts, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, how often it is linked there) of texts that consist of parts, by text."""
    kinds, kind = np.unique(ids, return_inverse=True)
    distinct, local = np.unique(parts.pair[_expanded(parts.at, kinds)], return_inverse=True)
    kind_at = np.r_[0, np.cumsum(parts.at[kinds + 1] - parts.at[kinds])]
    key = np.repeat(doc, parts.at[ids + 1] - parts.at[ids]) * max(len(distinct), 1) + local[_expanded(kind_at, kind)]
    order = np.argsort(key, kind="stable")
    times = parts.times[_expanded(parts.at, ids)][order]
    key = key[order]
    new = _runs(key)[:-1]
    key, times = key[new], np.add.reduceat(times, new) if len(new) else times
    return key // max(len(distinct), 1), distinct[key % max(len(distinct), 1)], times


_TEXT_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string"


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _worker(*files: str | None) -> Vocabularies:
    if files not in _vocabularies:
        _vocabularies[files] = Vocabularies(*files)
    return _vocabularies[files]


def _align(a: str, b: str, ranks: str | None, digest: bool):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, task = _worker(a, b, ranks), TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            found = _of_texts(batch.column("text").to_pylist(), v)
            said = [hashlib.sha256(x).hexdigest() if x else "" for x in found.said] if digest else [x.decode() for x in found.said]
            held = np.bincount(found.pair, minlength=len(found.distinct))  # a pair is once in a text here
            none = np.r_[0, np.full(n, len(found.distinct))]  # the batch's own pairs go with its first row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"), *(pa.array(x) for x in found.figures.T), pa.array(said), pa.array(np.full(n, task << 32 | k)),
                    _lists(found.at, found.pair, pa.int32()), _lists(found.at, found.times, pa.int64()), _lists(none, found.distinct, pa.int64()), _lists(none, held, pa.int64()),
                ],
                names=["_key", "n_a", "n_b", "n_groups", "n_links", "groups", "batch", "pairs", "times", "distinct", "held"],
            )
            give_back()

    return align


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    upto = np.r_[0, np.cumsum(values)]
    return upto[at[1:]] - upto[at[:-1]]


def _answered(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Texts of a batch with n_best and count_sum; an answer is (place among the batch's pairs, count, whether it is the highest of its id of A)."""
    place = answers.column("place").to_numpy()
    count, best = (np.zeros(len(place), np.int64) for _ in range(2))
    count[place], best[place] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    pairs, times = (texts.column(c).combine_chunks() for c in ("pairs", "times"))
    at = pairs.offsets.to_numpy()
    pair, times = pairs.values.to_numpy(), times.values.to_numpy()
    out = texts.drop_columns(["batch", "pairs", "times"])
    return out.append_column("n_best", pa.array(_sums(times * best[pair], at))).append_column("count_sum", pa.array(_sums(times * count[pair], at)))


def _aligned_table(docs: DataFrame, a: str, b: str, ranks: str | None, key: str, digest: bool) -> tuple[DataFrame, str]:
    bounded_batches(docs.sparkSession)
    columns = f"_key {docs.schema[key].dataType.simpleString()}, {_TEXT_COLUMNS}"
    rows = docs.select(F.col(key).alias("_key"), "text").mapInArrow(_align(a, b, ranks, digest), f"{columns}, batch long, pairs array<int>, times array<long>, distinct array<long>, held array<long>")
    return written(rows), columns


def _requests(aligned: DataFrame) -> DataFrame:
    """batch, place, pair, held: each distinct pair of each batch."""
    asked = aligned.where(F.size("distinct") > 0).select("batch", F.posexplode(F.arrays_zip("distinct", "held")).alias("place", "x"))
    return asked.select("batch", "place", F.col("x.distinct").alias("pair"), F.col("x.held").alias("held"))


def _counts(requests: DataFrame) -> DataFrame:
    """pair, id_a, count, best of each pair: how many texts hold it, and whether that is the highest of its id of A."""
    counted = requests.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("id_a", F.shiftright("pair", 32))
    highest = counted.groupBy("id_a").agg(F.max("count").alias("highest"))
    return counted.join(highest, "id_a").select("pair", "id_a", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def pair_counts(docs: DataFrame, a: str, b: str, ranks: str | None = None, key: str = "doc_id") -> DataFrame:
    """id_a, id_b, count, best: each pair of ids that any text links, how many texts do, and whether no other pair of id_a is in more."""
    aligned, _ = _aligned_table(docs, a, b, ranks, key, True)
    return _counts(_requests(aligned)).select("id_a", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("id_b"), "count", (F.col("best") == 1).alias("best"))


def align(docs: DataFrame, a: str, b: str, ranks: str | None = None, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of each row.

    a is a byte-level BPE file of the tokenizers library, and ranks, if given, the same
    vocabulary for a faster one; b is a sentencepiece model, which puts a space before a
    text. A encodes the text with a space before it. groups is
    "a1,a2|b1;a3|b2,b3": ids of A and B of each group, or its sha256 with digest. A null
    or empty text, and one whose tokens' bytes differ from its own on a side, has no
    tokens: zeros, and groups "". Each row counts as a text, also if its key is null or
    repeated; further columns are ignored, whatever their names. A text of any length is
    taken whole; without spaces to cut at it is one part.
    """
    with shuffle_files_end_with_each_job(docs.sparkSession):
        aligned, columns = _aligned_table(docs, a, b, ranks, key, digest)
        requests = _requests(aligned)
        counts = written(_counts(requests))
    answers = requests.select(F.col("batch").alias("asker"), "place", "pair").join(counts.select("pair", "count", "best"), "pair").select("asker", "place", "count", "best")
    texts = aligned.select("_key", *(c.split()[0] for c in _TEXT_COLUMNS.split(", ")), "batch", "pairs", "times")
    out = texts.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(_answered, f"{columns}, n_best long, count_sum long")
    return out.withColumnRenamed("_key", key)


def op12_tokenizer_alignment(documents: DataFrame) -> DataFrame:
    """Groups, links and their counts of all documents, under a byte-level vocabulary (A) and one of pieces (B); align() says how odd input counts."""
    import public_tokenizers

    a, b, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    out = align(documents, a, b, ranks, digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
