"""Inputs: a DataFrame, or the name of a table or view, checked for the columns an operator needs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"[^\W\d][\w]*\Z")


def check_identifier(name: str, param: str) -> str:
    """A name of dot-separated segments of letters, digits and underscores, none of which begins with a digit."""
    if not name:
        raise ValueError(f"{param} must not be empty")
    if not all(_SEGMENT.match(part) for part in name.split(".")):
        raise ValueError(f"Invalid identifier for {param}: {name}")
    return name


def check_columns(df: DataFrame, required: dict[str, str] | list[str], param: str, name: str = "") -> DataFrame:
    have = {c.lower() for c in df.columns}
    if missing := [c for c in required if c.lower() not in have]:
        raise ValueError(f"{param} '{name}' is missing required column(s): {', '.join(missing)} (expected columns: {', '.join(required)})")
    return df


def relation(spark: SparkSession, source: DataFrame | str, required: list[str], param: str) -> DataFrame:
    """source itself, or the table of that name; a missing table is Spark's own error."""
    if isinstance(source, DataFrame):
        return check_columns(source, required, param, "DataFrame")
    if len(check_identifier(source, param).split(".")) > 3:
        raise ValueError(f"Invalid identifier for {param}: {source}")
    return check_columns(spark.table(source), required, param, source)


def required(value, param: str):
    if value is None:
        raise ValueError(f"{param} must not be NULL")
    return value


def default(value, otherwise):
    """A missing named argument means its default."""
    return otherwise if value is None else value


def edges(bom: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """Distinct (parent_id, child_id) without nulls, as strings."""
    return bom.select(F.col(parent).cast("string").alias("parent_id"), F.col(child).cast("string").alias("child_id")).dropna().distinct()
