"""Best-fit packing into sequences by minimum bin slack.

Documents are tokenised and cut into pieces. Which lengths go together is decided on the
histogram of piece lengths alone: it has as many bins as a sequence has tokens, whatever
the corpus. For one bin after the other a bitset subset-sum over the available lengths
finds the fullest feasible combination around the longest length left; it is taken as
often as the counts allow, and removed. Pieces then look their places up by their rank
among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches
from ._tables import shuffle_files_end_with_each_job, written

CAPACITY = 2048
END = 0
#: Parts of texts whose ids a worker keeps.
_CACHE = 400_000
#: Letters and marks up to here split alike in both tokenizer libraries; texts with others go to the first.
_BEYOND = re.compile("[^\x00-ɏ]")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary file, as little-endian 32-bit bytes.

    Such a vocabulary never joins across a space that follows a non-space and precedes
    one, so a text is split there and each part encoded once while the cache holds it.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.parts = _Parts(self)

    def direct(self, text: str) -> bytes:
        ids = self.fast(text) if self.fast and not _BEYOND.search(text) else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "  " in text or text[:1] == " " or text[-1:] == " " or _BEYOND.search(text):
            return self.direct(text)
        first, *rest = text.split(" ")
        if len(self.parts) > _CACHE:
            self.parts.clear()
        return b"".join([self.direct(first), *map(self.parts.__getitem__, rest)])


class _Parts(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.encoder.direct(" " + part)
        return ids


def _encoder(tokenizer: str, ranks: str | None) -> Encoder:
    """The encoder of this Python worker."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer, ranks)
    return _encoders[tokenizer]


class _Numbers:
    """The number of each piece among the task's pieces of its length."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def __call__(self, length: np.ndarray) -> np.ndarray:
        order = np.argsort(length, kind="stable")
        value, at, count = np.unique(length[order], return_index=True, return_counts=True)
        own = np.empty(len(length), np.int64)
        own[order] = np.arange(len(length)) - np.repeat(at, count) + np.repeat(self.seen[value], count)
        self.seen[value] += count
        return own


def _cut(tokenizer: str, ranks: str | None, capacity: int):
    """The pieces of each text, with their numbers within the task and the task's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, numbers, task = _encoder(tokenizer, ranks), _Numbers(capacity), TaskContext.get().partitionId()
        tail = np.array([END], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = (encode(text.as_py()) if text.is_valid else b"") + tail
                n = len(ids) // 4
                a, b, k = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, b, k = b, b + capacity, k + 1
            own = numbers(np.array(length, np.int64))
            out = [batch.column("_key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, np.full(len(own), task), own))]
            yield pa.RecordBatch.from_arrays(out, names=["_key", "piece", "start", "length", "ids_crc32", "task", "own"])

    return cut


def fullest(counts: np.ndarray, first: int, capacity: int) -> list[int]:
    """Lengths that fill a bin best together with one of length first, by subset sums on bitsets."""
    room = capacity - first
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for size in range(min(first, room), 0, -1):
        rest, copies = min(int(counts[size]) - (size == first), room // size), 1
        while rest > 0:
            copies = min(copies, rest)  # 1, 2, 4, ... and what remains make every number up to all
            new = (reach << copies * size) & mask & ~reach
            if not new:
                break
            steps.append((size, copies, new))
            reach |= new
            rest, copies = rest - copies, 2 * copies
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, [first]
    for size, copies, new in reversed(steps):
        if left and new >> left & 1:
            out += [size] * copies
            left -= copies * size
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) that hold counts[n] pieces of each length n."""
    counts, out = counts.copy(), []
    for size in range(capacity, 0, -1):
        while counts[size]:
            bin_ = fullest(counts, size, capacity)
            need = np.bincount(bin_, minlength=len(counts))
            times = int((counts[need > 0] // need[need > 0]).min())
            counts -= times * need
            out.append((bin_, times))
    return out


def _places(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, ordered by the ranks of its pieces: runs of ranks, and where they go."""
    rows, used, base = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    rows.sort()
    return dict(zip(("length", "rank", "base", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def _placed(shared, capacity: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        step = 1 << 40
        key = runs["length"] * step + runs["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * step + rank, "right") - 1
            sequence = runs["base"][at] + rank - runs["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(runs["offset"][at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is a file of the tokenizers library; ranks, if given, the same vocabulary
    for a faster library. A null or empty text is the end token alone. Rows with null or
    repeated keys are pieces like others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, piece int, start long, length long, ids_crc32 long"
    with shuffle_files_end_with_each_job(spark):
        pieces = written(docs.select(F.col(key).alias("_key"), "text").mapInArrow(_cut(tokenizer, ranks, capacity), f"{schema}, task long, own long"))
        counted = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
        from pyspark.sql import Window

        before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
        starts = written(counted.select("length", "task", "n", before.alias("before")))
        counts = np.zeros(capacity + 1, np.int64)
        for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
            counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    ranked = pieces.join(starts.select("length", "task", "before"), ["length", "task"]).select("_key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(_placed(shared, capacity), f"{schema}, sequence_id long, offset long").withColumnRenamed("_key", key)


def op8_best_fit_packing(documents: DataFrame) -> DataFrame:
    """The pieces of all documents and their places, by pack(), which says how odd input counts; ids are those of a public byte-level vocabulary."""
    import public_tokenizers

    return pack(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
