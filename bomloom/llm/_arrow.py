"""Chunked access to text columns inside Arrow tasks, and hashing over their bytes.

A chunk is a run of whole documents whose UTF-8 bytes lie side by side in one numpy
array. Chunks are bounded in bytes (a longer single document is a chunk of its own), so
that the arrays made from them stay in cache and a task's memory doesn't follow its
partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C55 | 1
_U = np.uint64


class Chunk(NamedTuple):
    """ids: Arrow array; data: bytes of all texts; at: where each text begins, and the end."""

    ids: pa.Array
    data: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The text number of each byte."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.at))

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def bounded_batches(spark: SparkSession) -> None:
    """Batches of so many rows and bytes that a task's memory is bounded for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@cache
def _libc():
    import ctypes

    return ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the machine, which allocators would keep for this worker."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text", limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of at most limit bytes, or of one longer text."""
    for batch in batches:
        data, at = text_buffers(batch.column(text))
        ids, i, n = batch.column(key), 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield Chunk(ids[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The value that mix() made into h."""
    back = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    for _ in range(2):
        h = (h ^ (h >> _U(32))) * back
    return h ^ (h >> _U(32))


class Hasher:
    """64-bit hashes of any stretches of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(16, int(len(data) + 1).bit_length())
        self.power, self.inverse = _powers(n)
        self.sums = np.zeros(len(data) + 1, _U)
        values = data.astype(_U)
        values += _U(1)
        values *= self.power[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(_U) << _U(40)))

    def every(self, k: int) -> np.ndarray:
        """The raw hash of each k bytes."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:-k]) * self.inverse[:n] if n > 0 else np.empty(0, _U)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def byte_class(pattern: str) -> np.ndarray:
    """Which of the 256 bytes match a bytes pattern of one character."""
    import re

    return np.array([bool(re.fullmatch(pattern.encode("latin-1"), bytes([b]))) for b in range(256)])


#: Bytes of words: all but ASCII white space.
SPACED = byte_class(r"(?s)[^\x20\x09-\x0D]")


def words(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each maximal run of bytes of a class; runs end with their text."""
    on = inside[chunk.data]
    edge = np.zeros(len(on) + 1, bool)
    edge[1:-1] = on[1:] != on[:-1]
    if len(on):
        edge[0], edge[-1] = on[0], on[-1]
    cut = np.zeros(len(on) + 1, bool)
    cut[chunk.at[1:-1]] = True
    before = np.zeros(len(on) + 1, bool)
    before[1:] = on
    after = np.zeros(len(on) + 1, bool)
    after[:-1] = on
    start = np.flatnonzero(after & (edge | cut))
    end = np.flatnonzero(before & (edge | cut))
    return start, end, np.searchsorted(chunk.at, start, "right") - 1
