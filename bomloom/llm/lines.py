"""Line dedup by a deletion-neighbourhood join.

Two lines are near if an edit of one character makes them equal. Each line emits the
hashes of all its variants with one character deleted, with the place of the deletion,
and its own hash. Lines are near exactly if one is a variant of the other, or both share
a variant deleted at the same place. Such variants are joined, each candidate pair's edit
distance is verified on its text, and the earliest line stays.

Only lines that share a half with another line can have a near one; the others, found by
the hashes of their halves, emit no variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACED, Chunk, Hasher, bounded_batches, chunks, give_back, mix, words
from ._pointers import GROUP_BYTES, POINTER, batch_of, by_doc, dealt, doc_group, first_of, groups_of, located, of_rows, packed, texts, unpacked
from ._tables import shuffle_files_end_with_each_job, written

#: Shorter lines (in characters) are removed only if they equal an earlier one, unless a caller asks for less: a character makes "1." another line than "2.".
MIN_NEAR = 16
_CHUNK = 1 << 20
_HASHES = "kind string, bucket long, data binary"
_LINE = np.dtype([("k", "<u8"), ("h", "<u8"), ("ord", "<i8"), ("s", "<i4"), ("n", "<u1")])
_HALF_KEYS = np.uint64(0xA24BAED4963EE407)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the lines with a word; ends are before the line break."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    doc = np.searchsorted(at, begin, "right") - 1
    stop = np.append(breaks, len(data))[np.searchsorted(breaks, begin)]
    stop = np.minimum(stop, at[doc + 1])
    word, _, _ = words(Chunk(pa.nulls(len(at) - 1), data, at), SPACED)
    full = np.searchsorted(word, stop) > np.searchsorted(word, begin)
    return begin[full], stop[full], doc[full]


def _halves(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hasher: Hasher, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the beginnings and endings whose sharing nearness implies."""
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(points, begin)
    n = np.searchsorted(points, end) - first
    who, key = [], []
    for size in (n // 2, (n - 1) // 2):
        rows = np.flatnonzero(n >= max(3, least - 1))
        cut, rest = points[first[rows] + size[rows]], points[first[rows] + n[rows] - size[rows]]
        who += [rows, rows]
        key += [mix(hasher(begin[rows], cut) ^ size[rows].astype(np.uint64)), mix(hasher(rest, end[rows]) ^ size[rows].astype(np.uint64) ^ _HALF_KEYS)]
    return np.concatenate(who), np.concatenate(key)


def _hashed(buckets: int, groups: int, least: int):
    """For each chunk: its distinct lines dealt by hash, their halves dealt by key, and its own repeats for their documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, base, i = batch.column("ord").to_numpy(), batch.column("base").to_numpy(), 0
            for c in chunks(iter([batch]), key="ord", limit=_CHUNK):
                begin, end, doc = lines(c.data, c.at)
                hasher = Hasher(c.data)
                rows = np.zeros(len(begin), _LINE)
                rows["h"] = hasher(begin, end)
                rows["ord"], rows["s"] = order[i + doc], begin - c.at[doc] + base[i + doc]
                i += len(c.ids)
                by = np.lexsort((rows["s"], rows["ord"], rows["h"]))
                new = first_of(rows["h"][by])
                first = by[new]
                again = _pointers(rows[by[~new]])
                who, key = _halves(c.data, begin[first], end[first], hasher, least)
                own = rows[first]
                half = own[who]
                half["k"] = key
                out = [("line", b, packed(own[r])) for b, r in groups_of(dealt(own["h"], buckets))] if len(own) else []
                out += [("half", b, packed(half[r])) for b, r in groups_of(dealt(key, buckets))] if len(half) else []
                out += [("again", g, packed(again[r])) for g, r in by_doc(again, groups)]
                yield batch_of(out)
            give_back()

    return build


def _pointers(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), POINTER)
    out["ord"], out["s"] = rows["ord"], rows["s"]
    return out


def _met(groups: int):
    """One range: repeats of lines, and lines that share a half with another."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        out = [("again", key[0].as_py(), d) for k, d in zip(kinds, data, strict=True) if k == "again"]
        rows = unpacked([d for k, d in zip(kinds, data, strict=True) if k == "line"], _LINE)
        rows = rows[np.lexsort((rows["s"], rows["ord"], rows["h"]))]
        again = _pointers(rows[~first_of(rows["h"])])
        out += [("again", g, packed(again[r])) for g, r in by_doc(again, groups)]
        half = unpacked([d for k, d in zip(kinds, data, strict=True) if k == "half"], _LINE)
        half = half[np.lexsort((half["s"], half["ord"], half["h"], half["k"]))]
        new_key = first_of(half["k"])
        new_line = new_key | first_of(half["h"])
        half, new_key = half[new_line], new_key[new_line]
        group = np.cumsum(new_key) - 1
        shared = half[np.bincount(group)[group] > 1] if len(half) else half
        shared = _pointers(shared[np.unique(shared["h"], return_index=True)[1]])
        out += [("near", g, packed(shared[r])) for g, r in by_doc(shared, groups)]
        out = pa.Table.from_batches([batch_of(out)])
        give_back()
        return out

    return meet


def _taken(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    """The lines that pointers name: ord, s, line."""
    for data, at, order, base in texts(docs):
        p = np.unique(unpacked(found.column("data").to_pylist(), POINTER))
        p, row = of_rows(p, at, order, base, 1)
        begin, end, _ = lines(data, at)
        start = at[row] + p["s"] - base[row]
        stop = end[np.searchsorted(begin, start)] if len(start) else start
        raw = data.tobytes()
        return pa.table({"ord": pa.array(p["ord"]), "s": pa.array(p["s"].astype(np.int64)), "line": pa.array([raw[a:b].decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.string())})
    return pa.table({"ord": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "line": pa.array([], pa.string())})


def variants(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line number, hash, place of the deleted character or -1, characters of the line) of each line and its variants."""
    data, at = chunk.data, chunk.at
    h = Hasher(data)
    points = np.flatnonzero((data & 0xC0) != 0x80)
    stop = np.append(points[1:], len(data))
    who = np.searchsorted(at, points, "right") - 1
    n = np.bincount(who, minlength=len(at) - 1)
    begin, end = at[who], at[who + 1]
    raw = (h.sums[points] - h.sums[begin]) * h.inverse[begin] + (h.sums[end] - h.sums[stop]) * h.inverse[begin] * h.inverse[stop - points]
    place = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    whole = h.raw(at[:-1], at[1:])
    size = np.diff(at)
    value = np.concatenate([whole, raw])
    length = np.concatenate([size, (end - begin) - (stop - points)]).astype(np.uint64)
    return np.concatenate([np.arange(len(n)), who]), mix(value ^ (length << np.uint64(40))), np.concatenate([np.full(len(n), -1), place]), np.concatenate([n, n[who]])


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for c in chunks(iter([batch]), key="ord", text="line", limit=_CHUNK):
            who, value, place, n = variants(c)
            rows = pa.array(at + who)
            at += len(c.ids)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(place), pa.array(n), *(batch.column(k).take(rows) for k in ("ord", "s"))], names=["v", "place", "n", "ord", "s"])


def near_pairs(found: DataFrame, least: int = MIN_NEAR) -> DataFrame:
    """Of lines (ord, s, line): a verified pair (ord, s, other ord, other s) for each line that has an earlier near one.

    Lines that share a variant at the same place are near each other, so each needs only
    the earliest of them as its partner, and a line and its variants meet at the line.
    """
    varied = written(found.where(F.char_length("line") >= least - 1).mapInArrow(_varied, "v long, place long, n long, ord long, s long"))
    me = F.struct("ord", "s")
    deleted, whole = varied.where("place >= 0"), varied.where("place < 0")
    first = deleted.groupBy("v", "place", "n").agg(F.min(me).alias("a"), F.count("*").alias("m")).where("m > 1").select("v", "place", "n", "a")
    same = deleted.join(first, ["v", "place", "n"]).select("a", me.alias("b")).where("a <> b")
    inner = whole.select("v", me.alias("w"))
    other = deleted.join(inner, "v").select("w", me.alias("m"))
    crossed = other.select(F.least("w", "m").alias("a"), F.greatest("w", "m").alias("b")).where("a <> b")
    pairs = same.unionAll(crossed).distinct()
    a = found.select(F.struct("ord", "s").alias("a"), F.col("line").alias("line_a"))
    b = found.select(F.struct("ord", "s").alias("b"), F.col("line").alias("line_b"))
    near = pairs.join(a, "a").join(b, "b").where("greatest(char_length(line_a), char_length(line_b)) >= %d AND levenshtein(line_a, line_b, 1) >= 0" % least)
    return near.select(F.col("b.ord").alias("ord"), F.col("b.s").alias("s"), F.col("a.ord").alias("other_ord"), F.col("a.s").alias("other_s"))


def _dealt_out(groups: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows, POINTER)
            p["ord"], p["s"], p["n"] = batch.column("ord").to_numpy(), batch.column("s").to_numpy(), 1
            yield batch_of([("again", g, packed(p[r])) for g, r in by_doc(p, groups)])

    return deal


def _kept(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents without the lines that pointers name; n of a pointer: 1 if the line is near an earlier one, not equal."""
    kept, counts = [], []
    for data, at, order, base in texts(docs):
        p, row = of_rows(np.unique(unpacked(found.column("data").to_pylist(), POINTER)), at, order, base, 1)
        begin, end, doc = lines(data, at)
        gone, near = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
        which = np.searchsorted(begin, at[row] + p["s"] - base[row])
        gone[which] = True
        near[which[p["n"] == 1]] = True
        same = np.zeros(len(begin), bool)
        same[which[p["n"] == 0]] = True
        n = len(at) - 1
        cut: dict[int, set[int]] = {}
        for d, a in zip(doc[gone].tolist(), begin[gone].tolist(), strict=True):
            cut.setdefault(d, set()).add(a - int(at[d]))
        for i, text in enumerate(docs.column("text").to_pylist()):
            if i in cut:
                left, start = [], 0
                for line in text.encode().split(b"\n"):
                    if start not in cut[i]:
                        left.append(line)
                    start += len(line) + 1
                text = b"\n".join(left).decode()
            kept.append(text)
        counts = [np.bincount(doc, w, minlength=n).astype(np.int64) for w in (np.ones(len(doc)), gone, near & ~same)]
    counts = counts or [np.empty(0, np.int64)] * 3
    row = docs.column("_row").combine_chunks()
    row = row if isinstance(row, pa.StructArray) else pa.concat_arrays(row.chunks)
    row = pa.StructArray.from_arrays([row.field(i) for i in range(row.type.num_fields)], fields=[pa.field(f.name, f.type) for f in row.type])
    return pa.table([row, pa.array(kept, pa.string()), *map(pa.array, counts)], names=["_row", "text", "n_lines", "n_removed", "n_near"])


def dedup_lines(docs: DataFrame, key: str = "doc_id", min_near: int = MIN_NEAR) -> DataFrame:
    """The rows of docs, with text without the lines that equal or are near an earlier line, and n_lines, n_removed, n_near (long).

    Near: by one character that is put in, left out or changed, where the longer of the two
    has min_near characters (4 at least). Earlier: in a document of smaller key (null keys last), or further up in the same.
    Lines are judged on the input, not on what is left of it. Lines without a word stay
    and count for nothing; a null text stays null, or is empty if its key repeats. Texts
    of one key count as one document. Other columns come back as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = located(docs, key, keep=True)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(1, size // GROUP_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with shuffle_files_end_with_each_job(spark):
        hashed = rows.select("ord", "base", "text").mapInArrow(_hashed(groups, groups, min_near), _HASHES)
        met = written(hashed.groupBy("bucket").applyInArrow(_met(groups), _HASHES), "kind")
        placed = rows.select("_row", "ord", "base", "text", doc_group(groups).alias("bucket"))
        wanted = met.where("kind = 'near'").select("bucket", "data")
        found = written(placed.drop("_row").groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_taken, "ord long, s long, line string"))
        near = written(near_pairs(found, min_near).select("ord", "s").distinct().mapInArrow(_dealt_out(groups), _HASHES))
    gone = met.where("kind = 'again'").select("bucket", "data").unionAll(near.select("bucket", "data"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = placed.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(_kept, f"_row {kind}, text string, n_lines long, n_removed long, n_near long")
    return out.select(*(F.when(F.col("_row._null"), F.lit(None)).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)), "n_lines", "n_removed", "n_near")


def op7_line_dedup(documents: DataFrame) -> DataFrame:
    """What dedup_lines removes from each document, which also says how odd input counts; kept_sha256 is of the text that is left."""
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
