"""Fill-in-middle transformation of texts.

A text is cut into units, each a word with the white space before it (white space at the
end of a text is a unit too). Two seeded numbers cut a text into prefix, middle and
suffix, two more decide whether and in which order these are laid out between sentinels.
One kernel does all rows of a batch together on the batch's UTF-8 buffer: a byte-class
lookup and a mask of adjacent bytes mark where units end, sums that begin anew with each
row number them, and one binary search per cut finds the bytes to cut at. The parts are
then slices of the same buffer, which Arrow joins with the sentinels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACED, bounded_batches, give_back, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_DRAWS = ("_h1", "_h2", "_h3", "_h4")
#: Of each 64-bit sum over bytes, so many bytes of text at once; longer texts are alone.
_AT_ONCE = 1 << 22


class Cuts(NamedTuple):
    """For each row: units, bytes where the prefix and the middle end, and code points of both."""

    n: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray


def cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Cuts:
    """Cuts of all rows, whose bytes lie one after the other from at; h1 and h2 draw the numbers of units before each cut."""
    start, end = at[:-1], at[1:]
    word = SPACED[data]
    ends = np.zeros(len(data), bool)  # the last byte of each unit
    ends[:-1] = word[:-1] & ~word[1:]
    ends[end[end > start] - 1] = True
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ends, out=upto[1:])
    before = upto[start]
    n = upto[end] - before
    a, b = h1 % (n + 1), h2 % (n + 1)
    # upto counts from the batch's begin: a row's own numbers are those less what stood before it.
    first, second = (np.searchsorted(upto, before + x, "left") for x in (np.minimum(a, b), np.maximum(a, b)))
    first, second = np.maximum(first, start), np.maximum(second, start)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return Cuts(n, first, second, points[first] - points[start], points[second] - points[first])


def _slices(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Strings between successive edges of a buffer, which they share."""
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])


def _laid_out(data: np.ndarray, at: np.ndarray, draws: list[np.ndarray], rate: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all rows."""
    rows = len(at) - 1
    found = cuts(data, at, draws[0], draws[1])
    texts = _slices(data, at)
    marked = np.zeros(rows, bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, sentinel).to_numpy(zero_copy_only=False)
    plain = marked | (np.diff(at) == 0) | (draws[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[3] % 100 < spm, 2, 1))
    edges = np.empty(3 * rows + 1, np.int64)
    edges[0:-1:3], edges[1::3], edges[2::3], edges[-1] = at[:-1], found.first, found.second, at[-1]
    edges[1::3][plain] = edges[2::3][plain] = at[1:][plain]  # a plain text is all prefix
    parts, row = _slices(data, edges), 3 * np.arange(rows)
    labels = pa.array(["", PREFIX, SUFFIX, MIDDLE], pa.large_string())
    label = lambda of: labels.take(pa.array(np.array(of)[form]))
    part = lambda of: parts.take(pa.array(row + np.array(of)[form]))
    # By form: plain, psm, spm. Parts: 0 prefix, 1 middle, 2 suffix; the empty parts of a plain text join to nothing.
    output = pc.binary_join_element_wise(label([0, 1, 2]), part([0, 0, 2]), label([0, 2, 1]), part([2, 2, 0]), label([0, 3, 3]), part([1, 1, 1]), pa.scalar("", pa.large_string()))
    names = pa.array([PLAIN, PSM, SPM]).take(pa.array(form))
    count = lambda x: pa.array(x, pa.int64(), mask=plain)
    return [pa.array(found.n), names, count(found.prefix_chars), count(found.middle_chars), output]


def _transform(rate: int, spm: int):
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            draws, i = [batch.column(x).to_numpy() for x in _DRAWS], 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + _AT_ONCE, "right")) - 1)
                out = _laid_out(np.ascontiguousarray(data[at[i] : at[j]]), at[i : j + 1] - at[i], [x[i:j] for x in draws], rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column("_key")[i:j], *out[:4], out[4].cast(pa.string())], names=["_key", "n", "form", "prefix_chars", "middle_chars", "output"])
                i = j
            give_back()

    return transform


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output for each row: its units, and its text laid out for training.

    rate of 100 texts are transformed, and spm of 100 of these have the suffix first:
    psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle. Texts that
    are empty or null, or that contain a sentinel, stay plain; their output is the text
    ("" for null) and their part lengths are null. What is drawn depends on seed and key
    alone, so reruns agree, and rows of equal key and text come out alike; a null key
    draws as an empty one. Other columns of docs are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(key).alias("_key"), "text", drawn.alias("_drawn"))
    numbers = [F.conv(F.substring("_drawn", 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(_DRAWS)]
    schema = f"_key {docs.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.select("_key", "text", *numbers).mapInArrow(_transform(rate, spm), schema).withColumnRenamed("_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    Such a text holds no sentinel, and none can arise where parts meet, as a sentinel
    doesn't begin as it ends; so the three sentinels found are those that were set.
    """
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    of = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == PSM, of(0, 2, 1)).when(form == SPM, of(1, 2, 0)).otherwise(output)


def op11_fill_in_middle(documents: DataFrame) -> DataFrame:
    """Digests of the outputs of all documents, and of the texts restored from them; fill_in_middle() says how odd input counts."""
    out = fill_in_middle(documents)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same rows in DuckDB; a text's units are those of the pattern, as a list.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
