"""SimHash near-duplicates by fuzzy keys from the binary Golay code.

A 64-bit fingerprint is three segments of at most 23 bits. If two fingerprints differ in
at most 4 bits, some two of the segments differ in at most 2 bits together (pigeonhole).
Each segment decodes to the codewords of the perfect [23, 12, 7] code within 4 bits of it:
one or six. Words at most 2 bits apart have such a codeword in common: the one that is
nearest to a word between them. So the codeword indices of two segments are keys that
near fingerprints share. Fingerprints of equal keys are compared, and linked where they
are near; within a key only a spanning forest of the links is kept, which has the same
components. A key of very many fingerprints is divided: near ones agree in at least one of
five parts of the third segment, so each part with the key is a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACED, Chunk, bounded_batches, chunks, lower, mix, words
from ._components import components
from ._tables import shuffle_files_end_with_each_job, written

SHINGLE, SEED, BITS = 4, 42, 4
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR, _CHECKS, _LENGTH = 0xC75, 11, 23
_SMALL_GROUP = 16
#: Fingerprints of one key beyond which it is divided, and fingerprints to a bucket of keys, about.
MAX_GROUP, _PRINTS_A_BUCKET = 4_096, 16_000


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainders of m x^11 for each m, for each syndrome the error patterns of weight 4 or less: one or six, else -1)."""

    def remainder(word: int) -> int:
        for bit in range(_LENGTH - 1, _CHECKS - 1, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << bit - _CHECKS
        return word

    high = np.array([remainder(m << _CHECKS) for m in range(1 << _LENGTH - _CHECKS)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << _CHECKS)]
    for weight in range(5):
        for bits in combinations(range(_LENGTH), weight):
            e = sum(1 << b for b in bits)
            found[high[e >> _CHECKS] ^ (e & (1 << _CHECKS) - 1)].append(e)
    return high, np.array([(x + [-1] * 6)[:6] for x in found], np.int64)


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the codewords within 4 bits of each word, which of them there are): n x 6."""
    high, patterns = golay()
    e = patterns[high[segment >> _CHECKS] ^ (segment & (1 << _CHECKS) - 1)]
    return (segment[:, None] ^ np.maximum(e, 0)) >> _CHECKS, e >= 0


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key) for all keys of uint64 fingerprints."""
    parts = [codewords(((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in _SEGMENTS]
    who, key = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        (a, there_a), (b, there_b) = parts[i], parts[j]
        there = there_a[:, :, None] & there_b[:, None, :]
        value = (a[:, :, None] << 12 | b[:, None, :]) + (k << 24)
        who.append(np.nonzero(there)[0])
        key.append(value[there])
    return np.concatenate(who), np.concatenate(key)


def fingerprints(chunk: Chunk, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a chunk: the majority of its shingles' hashes, by bit."""
    chunk = chunk._replace(data=lower(chunk.data))
    start, end, doc = words(chunk, SPACED)
    out = np.zeros(len(chunk.ids), np.uint64)
    if not len(start):
        return out
    lengths = end - start + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    joined = np.full(at[-1], 32, np.uint8)
    take = np.ones(at[-1], bool)
    take[at[1:] - 1] = False
    joined[take] = chunk.data[SPACED[chunk.data]]
    n_words = np.bincount(doc, minlength=len(out))
    first = np.searchsorted(doc, np.arange(len(out)))
    n = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    begin = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    stop = np.minimum(begin + size, np.repeat(first + n_words, n))
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)], np.uint64)
    full = np.flatnonzero(n)
    cuts = (np.cumsum(n) - n)[full]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        yield pa.RecordBatch.from_arrays([c.ids, pa.array(fingerprints(c).view(np.int64))], names=["_key", "print"])


def _dealt(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            for k in range(0, len(prints), 20_000):
                part = prints[k : k + 20_000]
                who, key = keys(part)
                bucket = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                found, at = np.unique(bucket[order], return_index=True)
                ends = [*at[1:].tolist(), len(order)]
                rows = [order[a:b] for a, b in zip(at.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array([key[r].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([part[who[r]].tobytes() for r in rows], pa.binary())], names=["bucket", "keys", "prints"]
                )

    return deal


def forest(prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Edges (n x 2) that span the components of distinct fingerprints, linked at so many differing bits or fewer."""
    out, left = [], prints
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= bits
            if near.any():
                new = left[near]
                out.append(np.stack([np.full(len(new), front[0]), new], 1))
                front, left = np.concatenate([front[1:], new]), left[~near]
            else:
                front = front[1:]
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def linked(key: np.ndarray, prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Verified edges between fingerprints of equal keys, as a spanning forest for each large group."""
    order = np.lexsort((prints, key))
    key, prints = key[order], prints[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([at, [len(key)]]))
    out = [forest(prints[a : a + n], bits) for a, n in zip(at[size > _SMALL_GROUP].tolist(), size[size > _SMALL_GROUP].tolist(), strict=True)]
    small = np.repeat(size <= _SMALL_GROUP, size)
    key, prints = key[small], prints[small]
    for d in range(1, int(size[size <= _SMALL_GROUP].max(initial=1))):
        i = np.flatnonzero((key[d:] == key[:-d]) & (np.bitwise_count(prints[d:] ^ prints[:-d]) <= bits))
        out.append(np.stack([prints[i], prints[i + d]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)


def parts_of_key(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key with a part of the third segment, number of the fingerprint): fingerprints of a key that differ in BITS bits at most share one."""
    out, who = [], []
    for pair in range(3):
        rows = np.flatnonzero(key >> 24 == pair)
        at, n = _SEGMENTS[(2, 1, 0)[pair]]
        third = prints[rows] >> np.uint64(at) & np.uint64((1 << n) - 1)
        cuts = [n * i // (BITS + 1) for i in range(BITS + 2)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            value = (third >> np.uint64(a) & np.uint64((1 << b - a) - 1)).astype(np.int64)
            out.append((key[rows].astype(np.int64) << 9) | i << 6 | value)
            who.append(rows)
    return np.concatenate(out), np.concatenate(who)


def _divided(buckets: int):
    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("a").to_numpy().view(np.uint64)
            key, who = parts_of_key(batch.column("key").to_numpy(), prints)
            bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key), pa.array(prints[who].view(np.int64))], names=["bucket", "key", "a"])

    return divide


_LINKS = "key long, a long, b long"


def _linked(key: np.ndarray, prints: np.ndarray, limit: int | None) -> pa.Table:
    """Edges (a, b) of a bucket; of a key with more than limit fingerprints they come back as they are (key, a) instead."""
    large = np.zeros(len(key), bool)
    if limit is not None and len(key):
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        large = count[inverse] > limit
    edges = linked(key[~large], prints[~large]).view(np.int64)
    left = int(large.sum())
    return pa.table(
        {
            "key": pa.array(np.concatenate([np.zeros(len(edges), np.int64), key[large].astype(np.int64)]), mask=np.arange(len(edges) + left) < len(edges)),
            "a": pa.array(np.concatenate([edges[:, 0], prints[large].view(np.int64)])),
            "b": pa.array(np.concatenate([edges[:, 1], np.zeros(left, np.int64)])),
        }
    )


def _joined(limit: int):
    def joined(table: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int32)
        return _linked(key, np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint64), limit)

    return joined


def _joined_parts(table: pa.Table) -> pa.Table:
    return _linked(table.column("key").to_numpy(), table.column("a").to_numpy().view(np.uint64), None)


def links(prints: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges (a, b) with the components of all links between distinct fingerprints (column print, long)."""
    least = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, prints.count() // _PRINTS_A_BUCKET)
    dealt = prints.select("print").mapInArrow(_dealt(buckets), "bucket long, keys binary, prints binary")
    found = written(dealt.groupBy("bucket").applyInArrow(_joined(max_group), _LINKS))
    edges, large = found.where("key IS NULL").select("a", "b"), found.where("key IS NOT NULL")
    if n := large.count():
        parts = large.mapInArrow(_divided(max(least, 4 * n // max_group)), "bucket long, key long, a long")
        edges = edges.unionAll(parts.groupBy("bucket").applyInArrow(_joined_parts, _LINKS).select("a", "b"))
    return edges.distinct()


def _grouped(docs: DataFrame, key: str) -> DataFrame:
    """key, print, root (a fingerprint that names the component) and component_id."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    with shuffle_files_end_with_each_job(docs.sparkSession):
        printed = written(docs.select(F.col(key).alias("doc_id"), "text").mapInArrow(_printed, f"_key {kind}, print long"))
        distinct = written(printed.groupBy("print").agg(F.min("_key").alias("first")))
        roots = components(links(distinct))
        named = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        by_print = written(named.join(least, "root").select("print", "root", "component_id"))
    return printed.join(by_print, "print").select(F.col("_key").alias(key), "print", "root", "component_id")


def group(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, print (the fingerprint as a long) and component_id: the least key that links reach from the document.

    A null or empty text has the fingerprint 0, which links like any other. Repeated rows
    stay as they are. A null key is no component's name unless it has no other. An empty
    table gives an empty one.
    """
    return _grouped(docs, key).drop("root")


def _with_print(text: str):
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(c) for c in chunks(iter([batch]), key=text, text=text)]
            prints = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield batch.append_column("_print", pa.array(prints))

    return printed


def first_of_groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of docs for each group of near-duplicates: of its rows of the least key, one of the least fingerprint.

    Of rows that repeat key and fingerprint one stays. Null keys come after all others.
    """
    grouped = written(_grouped(docs, key))
    stay = grouped.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("component_id").alias("_key"), F.min("print").alias("_print"))
    stay = written(stay.select("_key", "_print"))
    repeated = grouped.groupBy(key).count().where("count > 1")
    if repeated.isEmpty() and stay.where("_key IS NULL").isEmpty():
        named = stay.select(F.col("_key").alias(key)).hint("shuffle_hash")
        return docs.join(named, key, "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, own = docs.toDF(*names), names[docs.columns.index(key)]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    rows = rows.mapInArrow(_with_print(names[docs.columns.index("text")]), f"{schema}, _print long")
    first = rows.join(stay.withColumnRenamed("_print", "_p"), rows[own].eqNullSafe(F.col("_key")) & (rows["_print"] == F.col("_p")), "left_semi")
    return first.dropDuplicates([own, "_print"]).select(*names).toDF(*docs.columns)


def op4_simhash_dedup(documents: DataFrame) -> DataFrame:
    """The fingerprint and component of each document, by group(), which says how odd input counts."""
    return group(documents).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
