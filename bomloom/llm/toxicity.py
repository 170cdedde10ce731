"""Toxicity by weak supervision.

From a bounded sample of labelled training rows a lexicon of words and word beginnings is
drawn, and dealt into many lexicon voters, to which pattern voters are added. They vote on
these rows and on a bounded sample of rows whatever their labels. From the votes alone a
generative label model (expectation maximisation) estimates the share of toxic rows, each
voter's accuracy, and the correlations that the class doesn't explain, which lower the
weight of voters that repeat each other. A linear classifier over the lexicon's entries
and the patterns is trained on the model's posterior labels, and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Chunk, Hasher, bounded_batches, byte_class, chunks, lower, words
from ._tables import written

#: Labelled rows from which the lexicon is drawn, and rows of any kind from which with them label model and classifier are fitted, at most.
MAX_LABELLED, MAX_ROWS = 10_000, 10_000
#: Log-likelihood by which an entry's count in toxic rows must exceed chance: among many rare words, some do by less.
SURPRISE = 10.0
MAX_CANDIDATES, MAX_ENTRIES, VOTERS = 20_000, 1_000, 24
#: Correlations up to here, which two classes always leave, don't lower a voter's weight.
_CORRELATED = 0.4
_PREFIXES = (4, 5, 6)
_LETTER = byte_class(r"[A-Za-z\x80-\xff]")
_PATTERNS = ("capitals", "shouting", "exclaiming", "short")


class Model(NamedTuple):
    entries: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # of the entries' presence, their rates, the patterns, and a constant


def held_out(key: str, parts: int, rest: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest


def _features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, and of each beginning of a longer word."""
    c = c._replace(data=lower(c.data))
    start, end, doc = words(c, _LETTER)
    h = Hasher(c.data)
    found = [(h(start, end), doc)]
    for n in _PREFIXES:
        longer = end - start >= n
        s = start[longer]
        found.append((h(s, s + n) ^ np.uint64(n), doc[longer]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _patterns(c: Chunk) -> np.ndarray:
    n = len(c.ids)
    doc = c.doc
    size = np.maximum(1, np.diff(c.at))
    upper = np.bincount(doc, (c.data - np.uint8(65)) < 26, minlength=n)
    small = np.bincount(doc, (c.data - np.uint8(97)) < 26, minlength=n)
    marks = np.bincount(doc, c.data == 33, minlength=n)
    return np.stack([upper > small, marks * 20 > size, marks > 0, size < 200], 1).astype(np.float32)


def _places(entries: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes are entries, their places)."""
    at = np.minimum(np.searchsorted(entries, h), len(entries) - 1)
    found = np.flatnonzero(entries[at] == h)
    return found, at[found]


def _hits(c: Chunk, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, entry), and the entry's rate: 1 from one in ten words up."""
    h, doc = _features(c)
    if not len(entries):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    found, at = _places(entries, h)
    pair, count = np.unique(doc[found].astype(np.int64) * len(entries) + at, return_counts=True)
    doc, entry = pair // len(entries), pair % len(entries)
    start, _, own = words(c, _LETTER)
    return doc, entry, np.minimum(1, 10 * count / np.maximum(1, np.bincount(own, minlength=len(c.ids)))[doc])


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        h, doc = _features(c)
        first = np.unique(h ^ doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)[1]
        value, n = np.unique(h[first], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def _counts(candidates: np.ndarray):
    """In how many texts of either label each candidate is: place, clean, toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(candidates)), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            at = 0
            for c in chunks(iter([batch])):
                doc, entry, _ = _hits(c, candidates)
                for y in (0, 1):
                    sums[y] += np.bincount(entry[toxic[at + doc] == y], minlength=len(candidates))
                at += len(c.ids)
        seen = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, sums[0][seen], sums[1][seen])], names=["place", "clean", "toxic"])

    return count


def _rows(entries: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, at = batch.column("toxic"), 0
            for c in chunks(iter([batch])):
                doc, entry, rate = _hits(c, entries)
                cut = np.searchsorted(doc, np.arange(len(c.ids) + 1))
                hits = pa.array([entry[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                rates = pa.array([rate[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                marks = pa.array([m.tobytes() for m in _patterns(c)], pa.binary())
                yield pa.RecordBatch.from_arrays([toxic[at : at + len(c.ids)], hits, rates, marks], names=["toxic", "hits", "rates", "marks"])
                at += len(c.ids)

    return rows


def label_model(votes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each row, rates P(vote | class) as voters x 2, correlations that the class leaves), from votes alone.

    votes: rows x voters of 0 and 1. It begins with class 1 as where voters that seldom vote
    do. Voters of one mind share the weight of their evidence: each counts less by its
    correlations with the others that voted as it did.
    """
    seldom = np.clip(votes.mean(0), 1e-4, 0.5)
    prior, rates = 0.1, np.stack([np.clip(seldom / 2, 1e-4, 1), np.full(len(seldom), 0.5)], 1)
    rates[votes.mean(0) > 0.25] = votes.mean(0)[votes.mean(0) > 0.25, None]  # what many rows have tells nothing at first
    shared, against = np.zeros((votes.shape[1], votes.shape[1])), 1 - votes
    for _ in range(rounds):
        odds = np.log(rates[:, 1] / rates[:, 0]) * votes / (1 + votes @ shared) + np.log((1 - rates[:, 1]) / (1 - rates[:, 0])) * against / (1 + against @ shared)
        posterior = 1 / (1 + np.exp(-np.clip(odds.sum(1) + np.log(prior / (1 - prior)), -30, 30)))
        share = np.stack([1 - posterior, posterior], 1)
        prior = float(np.clip(posterior.mean(), 1e-3, 0.5))
        rates = np.clip((votes.T @ share + 0.5) / (share.sum(0) + 1), 1e-4, 1 - 1e-4)
        residual = votes - share @ rates.T
        spread = np.sqrt((residual**2).mean(0)) + 1e-9
        correlation = (residual.T @ residual) / len(votes) / spread[:, None] / spread
        np.fill_diagonal(correlation, 0)
        shared = np.maximum(correlation - _CORRELATED, 0)
    return posterior, rates, correlation


def _classifier(x: np.ndarray, target: np.ndarray, steps: int = 400, decay: float = 3e-4) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Adam over all rows; the last is the constant's."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(target > 0.5, 2.0, 1.0) / len(x)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = ((p - target) * balance).astype(np.float32) @ x + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _vote(strength: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A voter's votes: its entries' summed rate is over the least bound at which few that aren't toxic are."""
    bounds = np.unique(np.concatenate([[0], np.quantile(strength[toxic == 1], np.linspace(0, 1, 41))]))
    gain = [((strength > b) & (toxic == 1)).sum() - 4 * ((strength > b) & (toxic == 0)).sum() for b in bounds]
    return strength > bounds[int(np.argmax(gain))]


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", parts: int = 5) -> DataFrame:
    """doc_id, text, toxic of rows to fit on, whose crc32(key as text) mod parts isn't 0, as a table.

    They are those of at most MAX_LABELLED labelled ids, and of at most MAX_ROWS ids of any
    kind. Of an id with several rows, one text (of the smallest hash) is taken, once, so
    that repeats don't raise what the driver gets.
    """
    labelled = labels.where(~held_out(key, parts, 0)).where("toxic IN (0, 1)").groupBy(F.col(key).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    drawn = docs.select(F.col(key).alias("doc_id")).where(~held_out("doc_id", parts, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS).distinct()
    chosen = F.broadcast(written(drawn.join(labelled, "doc_id", "full")))  # at most MAX_LABELLED + MAX_ROWS ids
    rows = docs.select(F.col(key).alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    picked = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.first("toxic").alias("toxic"))
    return written(rows.join(F.broadcast(written(picked)), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", parts: int = 5) -> Model:
    """A model from the rows of sample; the driver gets counts and hits, no texts."""
    voting = sample(docs, labels, key, parts)
    labelled = voting.where("toxic IS NOT NULL")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    least = max(3, round(0.004 * pos))
    found = labelled.where("toxic = 1").mapInArrow(_toxic_features, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    candidates = np.sort(np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(MAX_CANDIDATES).collect()], np.int64).view(np.uint64))
    if not len(candidates) or not neg:
        constant = 5.0 if pos > neg else -5.0
        return Model(candidates[:0], np.array([0.0] * len(_PATTERNS) + [constant]))
    sums = np.zeros((2, len(candidates)), np.int64)
    for r in labelled.mapInArrow(_counts(candidates), "place long, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():
        sums[:, r["place"]] = r["clean"], r["toxic"]
    score = np.log((sums[1] + 0.5) / (pos + 1)) - np.log((sums[0] + 0.5) / (neg + 1))
    chance = sums.sum(0) * pos / (pos + neg)  # of the rows with a feature, as many would be toxic
    surprise = sums[1] * np.log(np.maximum(sums[1], 1) / np.maximum(chance, 1e-9)) - (sums[1] - chance)
    strong = np.flatnonzero((score > np.log(8)) & (surprise > SURPRISE))
    strong = strong[np.argsort(-surprise[strong], kind="stable")][:MAX_ENTRIES]
    rank = np.argsort(candidates[strong])  # places of the entries by strength, in order of their hashes
    entries, n = candidates[strong][rank], len(strong)
    found = voting.mapInArrow(_rows(entries), "toxic int, hits binary, rates binary, marks binary").collect()
    toxic = np.array([-1 if r["toxic"] is None else r["toxic"] for r in found], np.int64)
    x = np.zeros((len(found), 2 * n + len(_PATTERNS)), np.float32)
    for i, r in enumerate(found):
        hits = np.frombuffer(r["hits"], np.int32)
        x[i, hits], x[i, n + hits] = 1, np.frombuffer(r["rates"], np.float32)
        x[i, 2 * n :] = np.frombuffer(r["marks"], np.float32)
    lexicon = [x[:, n : 2 * n][:, rank % VOTERS == v].sum(1) for v in range(min(VOTERS, n))]
    votes = np.stack([*(_vote(s, toxic) for s in lexicon), *x[:, 2 * n :].T], 1).astype(np.float64)
    posterior, _, _ = label_model(votes)
    return Model(entries, _classifier(x, posterior))


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, weights = shared.value
        for c in chunks(batches):
            n = len(entries)
            doc, entry, rate = _hits(c, entries)
            z = np.bincount(doc, weights[entry] + rate * weights[n + entry], minlength=len(c.ids)) + _patterns(c) @ weights[2 * n : -1] + weights[-1]
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["_key", "score"])

    return score


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key and score for each row; a null text scores as an empty one, keys stay as they are. A map: nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries
    return docs.select(F.col(key).alias("doc_id"), "text").mapInArrow(_scored(shared), f"_key {kind}, score double").withColumnRenamed("_key", key)


def op2_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of each document by score() with the model of fit(), which say how odd input counts."""
    bounded_batches(documents.sparkSession)
    held = F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out")
    return score(documents, fit(documents, labels)).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
