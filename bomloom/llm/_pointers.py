"""Pointers into documents, dealt to groups of documents and to hash ranges as packed bytes.

A document row is (ord, base, text): ord is its id, and base where its text begins among
the distinct texts of that id (0 unless ids repeat). A pointer is (ord, s, n): s counts
bytes from the base. Pointers and texts of one group of documents meet in one task, which
holds about GROUP_BYTES of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import give_back, text_buffers

#: Text bytes that a task holds at once when documents meet their pointers, about.
GROUP_BYTES = 4 << 20
POINTER = np.dtype([("ord", "<i8"), ("s", "<i4"), ("n", "<u1")])
_LAST = (1 << 63) - 1
_PRIME, _FACTOR = 2147483647, 1103515245


def packed(a: np.ndarray) -> bytes:
    """Records as planes of bytes, in which what varies little compresses."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unpacked(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    planes = [np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T for x in parts if x]
    return np.ascontiguousarray(np.concatenate(planes)).view(kind)[:, 0] if planes else np.empty(0, kind)


def dealt(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit values by range."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def groups_of(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    value, at = np.unique(bucket[order], return_index=True)
    for v, rows in zip(value.tolist(), np.split(order, at[1:]), strict=True):
        yield v, rows


def by_doc(pointers: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pointers by the group of their document, as doc_group deals documents."""
    yield from groups_of(np.mod(pointers["ord"], _PRIME) * _FACTOR % _PRIME % groups) if len(pointers) else ()


def doc_group(groups: int):
    return F.pmod(F.col("ord"), F.lit(_PRIME)) * F.lit(_FACTOR).cast("long") % F.lit(_PRIME).cast("long") % F.lit(groups).cast("long")


def first_of(k: np.ndarray) -> np.ndarray:
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return new


def batch_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "data"])


def texts(docs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, ord, base) of all texts of a group; memory of earlier groups goes back first."""
    give_back()
    table = docs.combine_chunks()
    if table.num_rows:
        column = table.column("text")
        data, at = text_buffers(pa.concat_arrays([x.cast(pa.large_binary()) for x in column.chunks]))
        yield data, at, table.column("ord").to_numpy(), table.column("base").to_numpy()


def of_rows(p: np.ndarray, at: np.ndarray, order: np.ndarray, base: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(pointers, the rows that they point into); a row of several with one id gets those of its own text."""
    by = np.lexsort((base, order))
    ids, first, count = np.unique(order[by], return_index=True, return_counts=True)
    slot = np.minimum(np.searchsorted(ids, p["ord"]), len(ids) - 1)
    there = ids[slot] == p["ord"]
    p, slot = p[there], slot[there]
    again = count[slot]
    row = by[np.repeat(first[slot], again) + np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)]
    p = np.repeat(p, again)
    size = np.diff(at)[row]
    s = p["s"].astype(np.int64) - base[row]
    inside = (s >= 0) & (s + p["n"] + reach <= size)
    return p[inside], row[inside]


def located(docs: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """_row, ord (the id; nulls last), base (where this text begins among those of the id) and text.

    The key must be an integer. _row is the key; with keep, a struct of all columns but the text, in their order, and
    whether the text is null.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a column of integers")
    row = F.col(key)
    if keep:
        row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"), F.col("text").isNull().alias("_null"))
    rows = docs.select(row.alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = rows.groupBy("ord").agg(F.count("*").alias("n")).where("n > 1").select("ord")
    if repeated.isEmpty():
        return rows.withColumn("base", F.lit(0).cast("long"))
    mark = rows.withColumn("mark", F.xxhash64("text"))
    found = mark.join(repeated, "ord", "left_semi").select("ord", "mark", F.octet_length("text").cast("long").alias("size")).distinct()
    before = Window.partitionBy("ord").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("ord", "mark", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("base"))
    return mark.join(found, ["ord", "mark"], "left").select("_row", "ord", "text", F.coalesce("base", F.lit(0)).cast("long").alias("base"))
