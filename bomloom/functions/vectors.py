"""Vectors as arrays of floats: fusion, distances, and text placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomloom.functions.sets import portable_hash

#: Lengths of the structural, textual and transactional vectors.
DIMENSIONS = {"structural": 256, "textual": 384, "transactional": 128}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a vector of zeros."""
    return 1 - F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def embed_text(text: Column, provider: Column | None = None) -> Column:
    """384 floats that depend on the text alone; zeros for an empty text. A stand-in for models, which this library has none of."""
    # A stretch of one constant array, which repeats after a thousand values: no lambda runs for each element.
    period = F.lit([i % 1000 / 1000.0 - 0.5 for i in range(1000 + 384)]).cast("array<float>")
    vector = F.slice(period, (F.pmod(portable_hash(text), F.lit(1000)) + 1).cast("int"), 384)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 384)
    given = text.isNotNull() if provider is None else text.isNotNull() & provider.isNotNull()
    return F.when(given, F.when(text == "", zeros).otherwise(vector))


def _scaled(v: Column, scale: Column) -> Column:
    return F.transform(v, lambda x: (F.coalesce(x.cast("float"), F.lit(0.0).cast("float")) * scale).cast("float"))


def fuse_embeddings(vectors: dict[str, Column], weights: dict[str, Column]) -> Column:
    """The vectors one after the other, each scaled by the root of its share of the weights.

    A vector of weight 0 counts as zeros, whatever it is. Null if a weight is null, not
    finite or negative, if their sum is 0, or if a vector of positive weight is null or of
    the wrong length; a null element counts as 0.
    """
    w = {m: weights[m].cast("double") for m in DIMENSIONS}
    total = reduce(lambda a, b: a + b, w.values())
    good = total > 0
    parts = []
    for m, n in DIMENSIONS.items():
        finite = w[m].isNotNull() & ~F.isnan(w[m]) & (w[m] < float("inf")) & (w[m] >= 0)
        good = good & finite & ((w[m] == 0) | (vectors[m].isNotNull() & (F.size(vectors[m]) == n)))
        scale = F.sqrt(w[m] / F.nullif(total, F.lit(0.0))).cast("float")
        parts.append(F.when(w[m] > 0, _scaled(vectors[m], scale)).otherwise(F.array_repeat(F.lit(0.0).cast("float"), n)))
    return F.when(F.coalesce(good, F.lit(False)), F.concat(*parts))
