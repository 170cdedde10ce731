"""Quality rules: a ledger of failure bits and measurements, and policies over its bits.

measure() evaluates every rule once for each document and stores one failure bit a rule
beside the measurements. A policy is a versioned set of rules (a bitmask); judging by it,
or asking what a policy without one of its rules would keep, only reads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import SPACED, Chunk, Hasher, bounded_batches, byte_class, chunks, mix, words
from ._tables import written

_WINDOW = 8
_SYMBOL = byte_class(r"[#*$%&|<>]")
_UPPER = byte_class(r"[A-Z]")
_LOWER = byte_class(r"[a-z]")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts", "n_stutters")

#: Rules in the order of their bits: name, and when a document fails it (over the measurements).
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouted_words": "10 * n_shouts > 3 * n_words",
    "capitals": "n_upper > 2 * n_lower AND n_upper > 40",
    "repeated_lines": "n_lines > 3 AND 2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)",
    "stuttered_words": "2 * n_stutters > n_words",
    "no_words": "n_words = 0",
}
#: The contract's base rules.
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules by which each rejects.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measured(c: Chunk) -> list[np.ndarray]:
    """The measurements of each text of a chunk."""
    n, data, at = len(c.ids), c.data, c.at
    total = lambda on: (s := np.concatenate([[0], np.cumsum(on, dtype=np.int64)]))[at[1:]] - s[at[:-1]]
    start, end, doc = words(c, SPACED)
    count = np.bincount(doc, minlength=n)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.bincount(doc, points[end] - points[start], minlength=n)
    hashes = Hasher(data)
    h = hashes(start, end)

    repeat = np.zeros(len(h) + 1, np.int64)
    if len(h) >= _WINDOW:
        key = h[: len(h) - _WINDOW + 1].copy()
        for i in range(1, _WINDOW):
            key = key * np.uint64(0x100000001B3) + h[i : len(h) - _WINDOW + 1 + i]
        first = np.flatnonzero(doc[: len(key)] == doc[_WINDOW - 1 :])
        key = mix(key[first] + doc[first].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(repeat, first[twice], 1)
        np.add.at(repeat, first[twice] + _WINDOW, -1)
    repeats = np.bincount(doc, np.cumsum(repeat)[:-1] > 0, minlength=n)

    breaks = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([at[:-1], breaks + 1]))
    line = line[line < len(data)]
    stop = np.minimum(np.concatenate([line[1:], [len(data)]])[: len(line)], at[np.searchsorted(at, line, "right")]) if len(line) else line
    ends_here = (stop > line) & np.isin(stop - 1, breaks)
    stop = stop - ends_here
    full = np.searchsorted(start, stop) > np.searchsorted(start, line)
    line, stop = line[full], stop[full]
    at_doc = np.searchsorted(at, line, "right") - 1
    key = mix(hashes(line, stop) + at_doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    dup = np.bincount(at_doc, minlength=n) - np.bincount(at_doc[np.unique(key, return_index=True)[1]], minlength=n)

    marks = np.concatenate([[0], np.cumsum(data == 33, dtype=np.int64)])
    shout = np.bincount(doc, marks[end] - marks[start] > 1, minlength=n)
    stutter = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    out = (count, chars, total(_SYMBOL[data]), dup, repeats, np.bincount(at_doc, minlength=n), total(_UPPER[data]), total(_LOWER[data]), shout, stutter)
    return [x.astype(np.int64) for x in out]


def _measured(kept: list[str], text: str):
    """The columns of a batch that are kept, as they are, and the measurements of the text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measured(c) for c in chunks(iter([batch]), key=text, text=text)]
            found = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(len(_MEASURES))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, found)], names=[*kept, *(f"_{m}" for m in _MEASURES)])

    return measure


_FAILURES = "CAST(" + " + ".join(f"IF({rule}, {1 << i}, 0)" for i, rule in enumerate(RULES.values())) + " AS LONG)"


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ledger: key, the measurements, and failures: a bit for each rule of RULES that the document fails.

    A null or empty text has no words and no lines. A row gives a row, with its key as it
    is (null, or repeated). A map over the documents: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("c0"), F.col("text").alias("c1")).mapInArrow(_measured(["c0"], "c1"), ", ".join([f"c0 {kind}", *(f"_{m} long" for m in _MEASURES)]))
    return rows.select(F.col("c0").alias(key), *(F.col(f"_{m}").alias(m) for m in _MEASURES)).withColumn("failures", F.expr(_FAILURES))


def kept_rows(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs that no rule of the policy rejects, their columns as they are; texts travel once."""
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True)]
    found = rows.mapInArrow(_measured(names, text), ", ".join([*kinds, *(f"_{m} long" for m in _MEASURES)]))
    judged = found.select(*names, *(F.col(f"_{m}").alias(m) for m in _MEASURES)).withColumn("_failures", F.expr(_FAILURES))
    return judged.where(F.col("_failures").bitwiseAND(mask(POLICIES[policy])) == 0).select(*names).toDF(*docs.columns)


def judge(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("failures").bitwiseAND(mask(POLICIES[policy])) == 0)


def ablations(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (rejected by no other rule of it), n_kept_without.

    One aggregation by the failure bits (as many groups as there are combinations of
    rules); the ablations are sums over those groups.
    """
    all_of = mask(POLICIES[policy])
    groups = ledger.groupBy(F.col("failures").bitwiseAND(all_of).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy])))
    each = groups.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def quality_rule_ablations(documents: DataFrame) -> DataFrame:
    """policy, rule, n_failed, n_only, n_kept_without: the ablations of every policy over one stored ledger, which measures each text once."""
    ledger = written(measure(documents))
    return reduce(DataFrame.unionByName, [ablations(ledger, p).select(F.lit(p).alias("policy"), "*") for p in POLICIES])


def op5_quality_rules(documents: DataFrame) -> DataFrame:
    """The stored ledger of all documents, judged by the latest policy; measure() says how odd input counts."""
    base = F.col("failures").bitwiseAND(mask(BASE)) != 0
    return judge(written(measure(documents))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")
