"""Language identification by a byte convolutional network in numpy.

Texts are cut into windows of fixed length. A window's bytes are embedded, filters of
several widths pass over them, each filter's largest value is kept, and a softmax over
those gives the languages' probabilities. A text's are the means over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Chunk, bounded_batches, chunks
from .toxicity import held_out

#: Training rows, at most, and windows of each.
MAX_LABELLED, WINDOWS_EACH = 4_000, 4
LENGTH, EMBED, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
_STEPS, _BATCH, _RATE = 700, 64, 0.005
_AT_ONCE = 512
UNKNOWN = "und"


class Network(NamedTuple):
    languages: list[str]
    params: dict[str, np.ndarray]


def _convolved(x: np.ndarray, p: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, patches, filter values) of each width for windows of bytes (n x LENGTH)."""
    e = p["embed"][x]
    n = len(x)
    for w in WIDTHS:
        patches = np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), w * EMBED, axis=1)[:, ::EMBED]
        patches = np.ascontiguousarray(patches).reshape(-1, w * EMBED)
        yield w, patches, (patches @ p[f"filter{w}"]).reshape(n, -1, FILTERS)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def predict(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities (n x languages) for windows of bytes (n x LENGTH)."""
    pooled = np.concatenate([v.max(1) for _, _, v in _convolved(x, p)], 1)
    return _softmax(np.maximum(pooled + p["bias"], 0) @ p["out"] + p["out_bias"])


def _gradients(x: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n, rows = len(x), np.arange(len(x))[:, None]
    kept, pooled = [], []
    for w, patches, v in _convolved(x, p):
        best = v.argmax(1)
        kept.append((w, patches.reshape(n, -1, w * EMBED), best))
        pooled.append(np.take_along_axis(v, best[:, None], 1)[:, 0])
    h = np.maximum(np.concatenate(pooled, 1) + p["bias"], 0)
    d = _softmax(h @ p["out"] + p["out_bias"])
    d[np.arange(n), y] -= 1
    d /= n
    g = {"out": h.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
    dh = (d @ p["out"].T) * (h > 0)
    g["bias"] = dh.sum(0)
    for i, (w, patches, best) in enumerate(kept):
        part = dh[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"filter{w}"] = np.einsum("nfk,nf->kf", patches[rows, best], part)
        back = part[:, :, None] * p[f"filter{w}"].T
        for j in range(w):
            np.add.at(g["embed"], x[rows, best + j], back[:, :, j * EMBED : (j + 1) * EMBED])
    return g


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """A network from windows of bytes (n x LENGTH) and numbers of languages, by Adam."""
    rng = np.random.default_rng(seed)
    shapes = {"embed": (256, EMBED), **{f"filter{w}": (w * EMBED, FILTERS) for w in WIDTHS}, "bias": (FILTERS * len(WIDTHS),), "out": (FILTERS * len(WIDTHS), len(languages)), "out_bias": (len(languages),)}
    p = {k: (rng.normal(0, 0.3, s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    share = np.bincount(y, minlength=len(languages))
    chance = (1 / share[y]) / (1 / share[y]).sum()
    for t in range(1, _STEPS + 1):
        pick = rng.choice(len(x), _BATCH, p=chance)
        batch = x[pick].copy()
        cut = rng.integers(8, 4 * LENGTH, _BATCH)  # some windows are short, as the last of a text
        batch[np.arange(LENGTH) >= cut[:, None]] = 0
        for k, g in _gradients(batch, y[pick], p).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= (_RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(languages, p)


def windows(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in rows of LENGTH, text number) covering every text; the last of a text is filled with zeros."""
    size = np.diff(c.at)
    n = -(-size // LENGTH)
    doc = np.repeat(np.arange(len(size)), n)
    begin = np.repeat(c.at[:-1] - (np.cumsum(n) - n) * LENGTH, n) + np.arange(n.sum()) * LENGTH
    place = begin[:, None] + np.arange(LENGTH)
    inside = place < c.at[1:][doc][:, None]
    return np.where(inside, c.data[np.minimum(place, max(0, len(c.data) - 1))] if len(c.data) else 0, 0).astype(np.uint8), doc


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for c in chunks(iter([batch])):
            x, doc = windows(c)
            first = np.searchsorted(doc, np.arange(len(c.ids)))
            n = np.bincount(doc, minlength=len(c.ids))
            pick = np.unique(np.concatenate([first[n > 0] + n[n > 0] * k // WINDOWS_EACH for k in range(WINDOWS_EACH)])) if n.any() else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(at + doc[pick])), pa.array([r.tobytes() for r in x[pick]], pa.binary())], names=["lang", "bytes"])
            at += len(c.ids)


def fit(docs: DataFrame, key: str = "doc_id", parts: int = 4, rest: int = 2) -> Network:
    """A network from WINDOWS_EACH windows of each of at most MAX_LABELLED rows with a lang whose crc32(key as text) mod parts isn't rest."""
    ids = docs.where(~held_out(key, parts, rest)).where("lang IS NOT NULL AND text <> ''").select(key, "lang")
    ids = ids.orderBy(F.xxhash64(key), key).limit(MAX_LABELLED).select(key).distinct()
    sample = docs.where("lang IS NOT NULL").select(F.col(key), "text", "lang").join(F.broadcast(ids), key).select(F.col(key).alias("doc_id"), "text", "lang")
    sampled = sample.mapInArrow(_sampled, "lang string, bytes binary")  # repeated ids make more rows than the bound
    rows = sampled.orderBy(F.xxhash64("bytes"), "bytes", "lang").limit(MAX_LABELLED * WINDOWS_EACH).collect()
    languages = sorted({r["lang"] for r in rows}) or [UNKNOWN]
    if not rows:
        return train(np.zeros((1, LENGTH), np.uint8), np.zeros(1, np.int64), languages)
    rows.sort(key=lambda r: (r["lang"], bytes(r["bytes"])))
    x = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8).reshape(-1, LENGTH)
    return train(x, np.array([languages.index(r["lang"]) for r in rows]), languages)


def _identified(shared):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = shared.value
        for c in chunks(batches):
            x, doc = windows(c)
            n = len(c.ids)
            prob = np.concatenate([predict(x[i : i + _AT_ONCE], p) for i in range(0, len(x), _AT_ONCE)]) if len(x) else np.zeros((0, len(languages)))
            count = np.maximum(1, np.bincount(doc, minlength=n))
            mean = np.stack([np.bincount(doc, prob[:, k], minlength=n) / count for k in range(len(languages))], 1)
            best = mean.argmax(1)
            byte_doc = c.doc
            plain = np.bincount(byte_doc, ((c.data | 32) - np.uint8(97)) < 26, minlength=n) > 0
            other = np.bincount(byte_doc, c.data >= 128, minlength=n) > 0
            letters = [bool(a) or bool(o) and any(map(str.isalpha, c.text(i).decode())) for i, (a, o) in enumerate(zip(plain, other, strict=True))]
            yield pa.RecordBatch.from_arrays(
                [c.ids, pa.array([languages[b] if a else UNKNOWN for a, b in zip(letters, best.tolist(), strict=True)], pa.string()), pa.array(np.where(letters, np.clip(mean[np.arange(n), best], 0, 1), 1.0))],
                names=["_key", "lang_pred", "score"],
            )

    return identify


def identify(docs: DataFrame, network: Network, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (its mean probability) for each row; UNKNOWN with score 1 for texts that are null or have no letter.

    Keys stay as they are, null or repeated. A map over the documents: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    return docs.select(F.col(key).alias("doc_id"), "text").mapInArrow(_identified(shared), f"_key {kind}, lang_pred string, score double").withColumnRenamed("_key", key)


def op3_language_id(documents: DataFrame) -> DataFrame:
    """The language of each document by identify() with the network of fit(); identify() says how odd input counts."""
    bounded_batches(documents.sparkSession)
    held = F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out")
    return identify(documents, fit(documents)).select("doc_id", held, "lang_pred", "score")
