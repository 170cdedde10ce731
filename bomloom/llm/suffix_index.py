"""Exact substring dedup with a logarithmic family of sampled suffix arrays.

Of the suffixes of a text only those are indexed whose first bytes hash lowest within
some window of LENGTH bytes: every window then has exactly one indexed suffix (its
anchor), in the same place wherever the window occurs. A run is what the windows of one
anchor cover. A level of the index is a suffix array over such anchors: in each bucket,
the suffixes in order of their first ANCHOR bytes, each with the hash of its run and the
first document that has it.

Batches of documents, in order of id and each as large as all before it, get a suffix
array, are merge-scanned against the levels, and merge with levels of equal size into
one of twice the size. A run that equals an earlier document's (its anchor byte for byte,
the rest by a 64-bit hash) is settled there. Where anchors agree but runs differ (ends of
matches), the scan marks the suffixes. Then the bytes on both sides of the marked ones
are put in suffix order, and the longest common prefixes of neighbours, to the right and
to the left, tell exactly which windows an earlier document has.

All that moves between tasks is one plain record for each anchor, marked anchor or found
span, so rows grow in proportion to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import Hasher, bounded_batches, chunks, give_back, mix
from ._pointers import GROUP_BYTES, dealt, doc_group, first_of, located, of_rows, packed, texts, unpacked
from ._tables import dropped, shuffle_files_end_with_each_job, written

LENGTH, ANCHOR = 50, 12
_SPAN = LENGTH - ANCHOR + 1
#: Bytes of texts whose anchors are found at once; a longer text is taken in parts.
_CHUNK = 256 << 10
#: A window goes so far beyond its anchor on the left, or on the right.
_HALF = (LENGTH - ANCHOR) // 2
#: Anchors of several chunks that a task sorts into one array.
_ROWS_AT_ONCE = 250_000
#: Different runs of one anchor that a task's array sends to the anchor's bucket. Further ones are marked at once, and a
#: record of no windows for the anchor goes to the bucket and stays in the levels: all other runs of it are marked too.
_RUNS_A_KEY = 64
#: Marked anchors that a task compares at once, about, and those that it looks up in texts at once.
_MARKED_A_BUCKET, _LOOKED_UP = 60_000, 20_000
#: A suffix: its first ANCHOR bytes as two big-endian numbers (of 8 bytes and of the rest), the hash of its run, document, first window, number of
#: windows, place of the anchor in the run, tags of what stands on its sides, and whether it is marked (1) or of a level that stays (2).
_ROW = np.dtype([("k", "<u8"), ("l", "<u8"), ("h", "<u8"), ("ord", "<i8"), ("s", "<i8"), ("n", "<u1"), ("at", "<u1"), ("left", "<u2"), ("right", "<u2"), ("sent", "<u1")])
_SPANS = np.dtype([("ord", "<i8"), ("s", "<i8"), ("n", "<i8")])
_SENT = "bucket long, k long, l long, h long, ord long, s long, n long"
#: Kinds of records: a suffix for its bucket, a marked one, a settled span, a bucket of a level. Before the scan the kind stands above so many bits of n.
_SUFFIX, _MARK, _FULL, _LEVEL = range(4)
_KIND = 48
#: Fields of a suffix that travel as one number, and the bits of each.
_META = (("n", 6), ("at", 6), ("left", 16), ("right", 16))
_FOUND = "kind long, bucket long, ord long, s long, n long, data binary"
_CONTEXT = "bucket long, ord long, s long, n long, data binary"
#: Bytes to the left and to the right (from the anchor on) that the windows of either half need.
_LEFT, _RIGHT = (_HALF, LENGTH), (LENGTH - ANCHOR, LENGTH - _HALF - 1)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, hash of the run, first window, number of windows, left and right tag) of each anchor of texts that begin at at.

    A tag is sixteen bits of a hash of the anchor and _HALF bytes on one side, 0 at a text's
    end: windows of two anchors can only be equal if the tags of one side are.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
    hasher = Hasher(data)
    key = mix(hasher.every(ANCHOR))
    low = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    step = 1
    while 2 * step <= _SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = _SPAN - step
    low = np.minimum(low[: len(low) - rest], low[rest:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    within = np.zeros(len(data) + 1, np.int32)
    begins = at[:-1]
    ends = np.maximum(begins, at[1:] - LENGTH + 1)
    np.add.at(within, begins, 1)
    np.add.at(within, ends, -1)
    valid = np.cumsum(within[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    new[begins[begins < n]] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.concatenate([(new | ~valid)[1:], [True]]) & valid)
    where = place[first]
    doc = np.searchsorted(at, first, "right") - 1
    tags = []
    for a, b in ((where - _HALF, where + ANCHOR), (where, where + ANCHOR + _HALF)):
        there = (a >= at[doc]) & (b <= at[doc + 1])
        a, b = np.where(there, a, first), np.where(there, b, first)
        tags.append(np.where(there, 1 + hasher(a, b) % np.uint64(65535), 0).astype(np.uint16))
    return where, mix(hasher(first, stop + LENGTH) + (where - first).astype(np.uint64)), first, stop - first + 1, *tags


def suffix_rows(data: np.ndarray, at: np.ndarray, order: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The sampled suffixes of texts as rows, in order of place.

    Of a text that is longer than a chunk, parts that overlap by all but one byte of a
    window are taken one after the other; a run ends with its part.
    """
    if len(at) == 2 and len(data) > _CHUNK + LENGTH:
        parts = (data[i : i + _CHUNK + LENGTH - 1] for i in range(0, len(data) - LENGTH + 1, _CHUNK))
        return np.concatenate([suffix_rows(part, np.array([0, len(part)]), order, base + i * _CHUNK) for i, part in enumerate(parts)])
    where, h, first, n, left, right = anchors(data, at)
    doc = np.searchsorted(at, first, "right") - 1
    rows = np.zeros(len(where), _ROW)
    head = np.zeros((len(where), 16), np.uint8)
    head[:, :ANCHOR] = data[where[:, None] + np.arange(ANCHOR)]
    head = head.view(">u8")
    rows["k"], rows["l"], rows["h"] = head[:, 0], head[:, 1] >> np.uint64(8 * (16 - ANCHOR)), h
    rows["ord"], rows["s"], rows["n"], rows["at"] = order[doc], first - at[doc] + base[doc], n, where - first
    rows["left"], rows["right"] = left, right
    return rows


def merged(*arrays: np.ndarray) -> np.ndarray:
    """Suffix arrays as one: rows in order of (k, l, h, ord). Runs that are in order already are merged, not sorted again."""
    rows = np.concatenate(arrays)
    order = np.argsort(rows["k"], kind="stable")
    k = rows["k"][order]
    tied = np.zeros(len(k) + 1, bool)
    tied[1:-1] = k[1:] == k[:-1]
    tied = np.flatnonzero(tied[1:] | tied[:-1])
    if len(tied):
        part = order[tied]
        order[tied] = part[np.lexsort([rows[f][part] for f in ("ord", "h", "l", "k")])]
    return rows[order]


def _new_key(rows: np.ndarray) -> np.ndarray:
    return first_of(rows["k"]) | first_of(rows["l"])


def _late(rows: np.ndarray) -> np.ndarray:
    """Which rows of a merged array have an equal run in an earlier document."""
    new = _new_key(rows) | first_of(rows["h"])
    return rows["ord"] > rows["ord"][new][np.cumsum(new) - 1]


def _alike(rows: np.ndarray, new_run: np.ndarray) -> np.ndarray:
    """Which rows of a merged array share their anchor and a side's tag with a run of another document."""
    out = np.zeros(len(rows), bool)
    group = np.cumsum(_new_key(rows)) - 1
    few = np.flatnonzero(np.bincount(group, new_run)[group] > 1) if len(rows) else np.empty(0, np.int64)
    for side in ("left", "right"):
        part = few[rows[side][few] > 0]
        order = part[np.lexsort((rows["h"][part], rows[side][part], group[part]))]
        new = first_of(group[order]) | first_of(rows[side][order])
        if len(order):
            own, starts, ids = np.cumsum(new) - 1, np.flatnonzero(new), rows["ord"][order]
            apart = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)
            runs = np.add.reduceat(new | first_of(rows["h"][order]), starts, dtype=np.int64)
            out[order[(apart & (runs > 1))[own]]] = True
    return out


def _spans(rows: np.ndarray) -> np.ndarray:
    """(ord, s, n) of rows; windows that follow each other in a document are one span."""
    rows = rows[np.lexsort((rows["s"], rows["ord"]))]
    n = rows["n"].astype(np.int64)
    new = first_of(rows["ord"])
    new[1:] |= rows["s"][1:] != rows["s"][:-1] + n[:-1]
    out = np.empty(int(new.sum()), _SPANS)
    if len(out):
        out["ord"], out["s"], out["n"] = rows["ord"][new], rows["s"][new], np.add.reduceat(n, np.flatnonzero(new))
    return out


def _meta(rows: np.ndarray) -> np.ndarray:
    out, shift = np.zeros(len(rows), np.int64), 0
    for f, bits in _META:
        out |= rows[f].astype(np.int64) << shift
        shift += bits
    return out


def _unmeta(meta: np.ndarray) -> dict[str, np.ndarray]:
    out, shift = {}, 0
    for f, bits in _META:
        out[f] = meta >> shift & (1 << bits) - 1
        shift += bits
    return out


def _records(parts: list[tuple[np.ndarray, dict[str, np.ndarray]]], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of several kinds as one batch; fields that a kind lacks are 0."""
    columns = []
    for name in names:
        values = [more[name] if name in more else rows[name] if name in rows.dtype.names else np.zeros(len(rows), np.int64) for rows, more in parts]
        columns.append(pa.array(np.concatenate([np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64) for v in values])))
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def _array(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One suffix array's records for the buckets, the spans that it settles by itself, and the runs that it marks at once."""
    rows = merged(rows)
    late = _late(rows)
    settled, rows = _spans(rows[late]), rows[~late]
    new_key = _new_key(rows)
    run = np.cumsum(new_key | first_of(rows["h"]))
    many = run - run[new_key][np.cumsum(new_key) - 1] >= _RUNS_A_KEY
    overfull = rows[many]
    marks = overfull[_new_key(overfull)]
    for f in set(_ROW.names) - {"k", "l"}:
        marks[f] = 0
    rows = np.concatenate([rows[~many], marks])
    bucket = dealt(mix(rows["k"] + mix(rows["l"])), buckets)
    passing = [dealt(mix(x["ord"].astype(np.uint64)), buckets) for x in (overfull, settled)]
    parts = [(rows, {"bucket": bucket, "n": _meta(rows)}), (overfull, {"bucket": passing[0], "n": _meta(overfull) | _MARK << _KIND}), (settled, {"bucket": passing[1], "n": settled["n"] | _FULL << _KIND})]
    return _records(parts, ("bucket", "k", "l", "h", "ord", "s", "n"))


def _arrays(buckets: int):
    """Suffix arrays of chunks of a task's documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            order, base, i = batch.column("ord").to_numpy(), batch.column("base").to_numpy(), 0
            for c in chunks(iter([batch]), key="ord", limit=_CHUNK):
                j = i + len(c.ids)
                held.append(suffix_rows(c.data, c.at, order[i:j], base[i:j]))
                i = j
                if sum(map(len, held)) >= _ROWS_AT_ONCE:
                    yield _array(np.concatenate(held), buckets)
                    held = []
                    give_back()
        if held:
            yield _array(np.concatenate(held), buckets)

    return build


def _rows_of(table: pa.Table) -> np.ndarray:
    rows = np.zeros(table.num_rows, _ROW)
    for f in ("k", "l", "h", "ord", "s"):
        rows[f] = table.column(f).to_numpy().view(_ROW[f])
    for f, values in _unmeta(table.column("n").to_numpy()).items():
        rows[f] = values
    return rows


def scan(rows: np.ndarray, merging: np.ndarray, staying: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spans that are settled, rows to mark, merged array of the new rows and of the levels that merge) of one bucket.

    A row of no windows stands for runs of its anchor that are marked already.
    """
    staying["sent"] |= 2
    rows = merged(staying, merging, rows)
    marks, rows = rows[rows["n"] == 0], rows[rows["n"] > 0]
    late = _late(rows)
    settled, rows = _spans(rows[late]), rows[~late]
    new_run = _new_key(rows) | first_of(rows["h"])
    marked = _alike(rows, new_run)
    if len(marks):
        keys = np.unique(np.stack([marks["k"], marks["l"]], 1), axis=0)
        both = np.concatenate([keys, np.stack([rows["k"], rows["l"]], 1)])
        number = np.unique(both, axis=0, return_inverse=True)[1].ravel()
        marked |= np.isin(number[len(keys) :], number[: len(keys)])
    found = rows[marked & (rows["sent"] & 1 == 0)]
    rows["sent"][marked] |= 1
    marks = marks[marks["sent"] < 2]
    marks = marks[_new_key(marks)]
    return settled, found, merged(marks, rows[new_run & (rows["sent"] < 2)])


def _scanned(keep: bool):
    """scan() of one bucket's records; marked suffixes and settled spans among them pass."""

    def scanned(key: tuple, new: pa.Table, levels: pa.Table) -> pa.Table:
        give_back()
        kinds, data = levels.column("kind").to_pylist(), levels.column("data").to_pylist()
        merging, staying = (unpacked([x for k, x in zip(kinds, data, strict=True) if k == kind], _ROW) for kind in ("merge", "stay"))
        kind = new.column("n").to_numpy() >> _KIND
        passing = new.filter(pa.array(kind != _SUFFIX)).select(["ord", "s", "n"])
        settled, found, level = scan(merged(_rows_of(new.filter(pa.array(kind == _SUFFIX)))), merging, staying)
        blobs = int(keep and len(level) > 0)
        out = _records([(settled, {"kind": np.full(len(settled), _FULL)}), (found, {"kind": np.full(len(found), _MARK), "n": _meta(found)}), (level[:blobs], {"kind": np.full(blobs, _LEVEL), "bucket": np.full(blobs, key[0].as_py())})], ("kind", "bucket", "ord", "s", "n"))
        out = pa.Table.from_batches([out]).append_column("data", pa.array([None] * (len(settled) + len(found)) + [packed(level)] * blobs, pa.binary()))
        n = passing.column("n").to_numpy()
        rest = [pa.array(n >> _KIND), pa.array(np.zeros(len(n), np.int64)), passing.column("ord"), passing.column("s"), pa.array(n & (1 << _KIND) - 1), pa.nulls(len(n), pa.binary())]
        return pa.concat_tables([out, pa.table(rest, names=out.column_names)])

    return scanned


def _contexts(buckets: int):
    """For each marked anchor the bytes around it, once for the windows that go further to the right and once for the others.

    Windows of the first kind hold _HALF bytes after the anchor, others as many before it:
    records are dealt by those bytes and the anchor, so that a frequent anchor is divided.
    """

    def contexts(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for data, at, order, base in texts(docs):
            marked = np.empty(found.num_rows, np.dtype([*_SPANS.descr, ("at", "<i8")]))
            meta = _unmeta(found.column("n").to_numpy())
            marked["ord"], marked["s"], marked["n"], marked["at"] = found.column("ord").to_numpy(), found.column("s").to_numpy(), meta["n"], meta["at"]
            for i in range(0, len(marked), _LOOKED_UP):
                p, row = of_rows(marked[i : i + _LOOKED_UP], at, order, base, LENGTH - 1)
                first = at[row] + p["s"] - base[row]
                anchor, end = first + p["at"], first + p["n"] + LENGTH - 1
                low, high = p["at"] - p["n"] + 1, p["at"]  # of bytes that windows have before the anchor
                for side, (left, right) in enumerate((_LEFT, _RIGHT)):
                    own = np.flatnonzero(high > _HALF if side else low <= _HALF)
                    a = anchor[own]
                    place = a[:, None] + np.arange(-left, right)
                    there = (place >= first[own, None]) & (place < end[own, None])
                    raw = np.where(there, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)
                    shared = np.zeros((len(own), 40), np.uint8)
                    shared[:, : ANCHOR + _HALF + side] = raw[:, left - side * (_HALF + 1) :][:, : ANCHOR + _HALF + side]
                    h = np.full(len(own), side, np.uint64)
                    for word in shared.view(np.uint64).T:
                        h = mix(h + word)
                    columns = (dealt(h, buckets), p["ord"][own], p["s"][own] + p["at"][own], side | np.maximum(low[own], _HALF + 1 if side else 0) << 1 | np.minimum(high[own], LENGTH if side else _HALF) << 9)
                    at_bytes = pa.py_buffer(np.arange(0, raw.size + 1, left + right, dtype=np.int32))
                    out.append(pa.table([*(pa.array(c.astype(np.int64)) for c in columns), pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, at_bytes, pa.py_buffer(raw.tobytes())])], names=["bucket", "ord", "s", "n", "data"]))
        empty = pa.table({**{k: pa.array([], pa.int64()) for k in ("bucket", "ord", "s", "n")}, "data": pa.array([], pa.binary())})
        return pa.concat_tables([empty, *out])

    return contexts


def prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows of bytes, length of the common prefix of each with the one before it in that order)."""
    if not rows.size:
        return np.arange(len(rows)), np.zeros(len(rows), np.int64)
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}")[:, 0], kind="stable")
    apart = np.ones((len(rows), rows.shape[1] + 1), bool)
    apart[1:, :-1] = rows[order[1:]] != rows[order[:-1]]
    common = apart.argmax(1)
    common[0] = 0
    return order, common


def repeated_windows(left: np.ndarray, right: np.ndarray, ord_: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of anchors with the bytes before them (nearest first) and from them on: which windows an earlier document has.

    Row i is about anchor i; column j about its window with j bytes before the anchor,
    where low[i] <= j <= high[i]. Windows are equal if their right parts share a class of
    the suffix order and their left parts one of the order of the reversed bytes.
    """
    out = np.zeros((len(ord_), LENGTH - ANCHOR + 1), bool)
    (order_r, common_r), (order_l, common_l) = prefixes(right), prefixes(left)
    for j in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        rows = np.flatnonzero((low <= j) & (j <= high))
        if len(rows) < 2:
            continue
        number = np.zeros(len(ord_), np.int64)
        number[order_r] = np.cumsum(common_r < LENGTH - j) * len(ord_)
        side = np.empty(len(ord_), np.int64)
        side[order_l] = np.cumsum(common_l < j) if j else 0
        number = (number + side)[rows]
        by = np.lexsort((ord_[rows], number))
        new = first_of(number[by])
        ids = ord_[rows][by]
        out[rows[by[ids > ids[new][np.cumsum(new) - 1]]], j] = True
    return out


def _compared(key: tuple, table: pa.Table) -> pa.Table:
    """The spans of windows of one bucket that an earlier document has."""
    give_back()
    found = []
    meta, ord_, s = (table.column(c).to_numpy() for c in ("n", "ord", "s"))
    raw = table.column("data").combine_chunks()
    raw = raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks)
    for side, (left, right) in enumerate((_LEFT, _RIGHT)):
        own = np.flatnonzero(meta & 1 == side)
        if not len(own):
            continue
        values = raw.take(pa.array(own))
        data = np.frombuffer(values.buffers()[2], np.uint8)[: len(own) * (left + right)].reshape(-1, left + right)
        again = repeated_windows(data[:, :left][:, ::-1], data[:, left:], ord_[own], meta[own] >> 1 & 255, meta[own] >> 9)
        i, j = np.nonzero(again)
        windows = np.empty(len(i), _SPANS)
        windows["ord"], windows["s"], windows["n"] = ord_[own][i], s[own][i] - j, 1
        found.append(_spans(windows))
    found = np.concatenate(found) if found else np.empty(0, _SPANS)
    return pa.table({k: pa.array(found[k]) for k in _SPANS.names})


def _cut(data: np.ndarray, at: np.ndarray, order: np.ndarray, base: np.ndarray, found: pa.Table) -> np.ndarray:
    """Which bytes are removed."""
    spans = np.empty(found.num_rows, _SPANS)
    for f in _SPANS.names:
        spans[f] = found.column(f).to_numpy()
    p, row = of_rows(spans, at, order, base, LENGTH - 1)
    depth = np.zeros(len(data) + 1, np.int32)
    start = at[row] + p["s"] - base[row]
    np.add.at(depth, start, 1)
    np.add.at(depth, start + p["n"] + (LENGTH - 1), -1)
    return np.cumsum(depth, out=depth)[:-1] > 0


def _reported(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    names = ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for data, at, order, base in texts(docs):
        gone = _cut(data, at, order, base, found)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        cut = at[1:-1][at[1:-1] < len(gone)]
        begins[cut] = gone[cut]
        ends = gone.copy()
        ends[:-1] &= begins[1:] | ~gone[1:]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(at, start, "right") - 1
        lost = np.bincount(doc, stop - start, minlength=len(at) - 1).astype(np.int64)
        sha, spans, bounds = [], [], np.searchsorted(doc, np.arange(len(at)))
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            own = slice(bounds[i], bounds[i + 1])
            sha.append(hashlib.sha256((data[a:b][~gone[a:b]] if lost[i] else data[a:b]).tobytes()).hexdigest())
            spans.append([{"start": int(x) - a, "end": int(y) - a} for x, y in zip(start[own], stop[own], strict=True)])
        numbers = (np.diff(at), lost, np.diff(bounds))
        return pa.table([docs.column("_row"), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(sha), pa.array(spans, kind)], names=names)
    return pa.table([docs.column("_row").slice(0, 0), *(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.string()), pa.array([], kind)], names=names)


class SuffixLevels:
    """The index family: levels of (rank, table); those of one rank merge into one of the next."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.buckets, self.levels, self.found = buckets, [], []
        self.none = spark.createDataFrame([], "kind string, bucket long, data binary")

    def add(self, batch: DataFrame, rank: int, last: bool = False) -> None:
        """Scan a batch of rows (ord, base, text) of later ids against the levels, and take it in unless it is the last."""
        new = batch.select("ord", "base", "text").mapInArrow(_arrays(self.buckets), _SENT)
        merging = []
        while not last and self.levels and self.levels[-1][0] == rank + len(merging):
            merging.append(self.levels.pop()[1])
        kept = [("merge", t) for t in merging] + [("stay", t) for _, t in self.levels]
        levels = self.none
        for kind, table in kept:
            levels = levels.unionAll(table.where(F.col("kind") == _LEVEL).select(F.lit(kind).alias("kind"), "bucket", "data"))
        scanned = written(new.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(_scanned(not last), _FOUND), "kind")
        self.found.append(scanned.where(F.col("kind") != _LEVEL).select("kind", "ord", "s", "n"))
        dropped(*merging, part=f"kind={_LEVEL}")
        if last:
            dropped(*(t for _, t in self.levels), part=f"kind={_LEVEL}")
        else:
            self.levels.append((rank + len(merging), scanned))


def removed_spans(docs: DataFrame, key: str = "doc_id", batches: int = 4) -> DataFrame:
    """_key, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end bytes) of what to remove, for each row.

    key is a column of integers. A byte goes if a string of LENGTH bytes over it also
    starts in a document of smaller id. Null texts are empty; rows without an id count as
    last and as one document; rows that repeat an id are judged against smaller ids only,
    each by its own text. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = located(docs, key)
    size, *cuts = rows.agg(F.sum(F.octet_length("text").cast("long")), *(F.percentile_approx("ord", 0.5**i, 10_000) for i in range(batches - 1, 0, -1))).first()
    size = size or 0
    groups = max(1, size // GROUP_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(docs.dtypes)[key]
    with shuffle_files_end_with_each_job(spark):
        index = SuffixLevels(spark, groups)
        bounds = [None, *(c for c in cuts if c is not None), None]  # an empty table is one batch
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            batch = rows if a is None else rows.where(F.col("ord") > a)
            index.add(batch if b is None else batch.where(F.col("ord") <= b), max(0, i - 1), last=b is None)
        found = index.found[0]
        for x in index.found[1:]:
            found = found.unionAll(x)
        placed = rows.select("_row", "ord", "base", "text", doc_group(groups).alias("bucket"))
        marked = found.where(F.col("kind") == _MARK).select("ord", "s", "n", doc_group(groups).alias("bucket"))
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * marked.count() // _MARKED_A_BUCKET)
        contexts = placed.drop("_row").groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_contexts(buckets), _CONTEXT)
        compared = written(contexts.groupBy("bucket").applyInArrow(_compared, "ord long, s long, n long"))
    full = found.where(F.col("kind") == _FULL).select("ord", "s", "n").unionAll(compared).select("ord", "s", "n", doc_group(groups).alias("bucket"))
    return placed.groupBy("bucket").cogroup(full.groupBy("bucket")).applyInArrow(_reported, f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>").withColumnRenamed("_key", key)


def op1_suffix_array_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, by removed_spans, which says how odd input counts."""
    return removed_spans(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
