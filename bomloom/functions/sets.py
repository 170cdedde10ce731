"""Similarity of sets as column expressions; they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(shared: Column, size_a: Column, size_b: Column) -> Column:
    """|A and B| / |A or B| from counts; 0 for two empty sets."""
    total = size_a + size_b - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def _distinct(a: Column) -> Column:
    return F.array_distinct(F.array_compact(a))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Null if either array is null; null elements and repeats don't count; 0 for two empty sets."""
    a, b = _distinct(a), _distinct(b)
    return F.when(a.isNotNull() & b.isNotNull(), overlap(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)))


def dice_similarity(a: Column, b: Column) -> Column:
    a, b = _distinct(a), _distinct(b)
    total = F.size(a) + F.size(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total))


def portable_hash(text: Column) -> Column:
    """60 bits of MD5 as a long: the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
