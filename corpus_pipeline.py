"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents that the stage before it kept, applies its operator, and
returns them with its decisions in effect: rejected documents and duplicates are gone,
removed lines and benchmark passages are cut from the texts. The last returns the packed
pieces. Texts may be null (they have no words, so the quality rules reject them); ids may
be null or repeated; further columns, of any name, are carried along; n_chars follows the
text. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.llm import decontam, lines, packing, rules, simhash
from bomloom.llm._tables import dropped, written

#: SQL can't express line nearness, fingerprint components or packing; tests compare the stages with brute force.
ORACLE_SQL = None


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name clashes with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("_")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("rest"))


def _counted(docs: DataFrame) -> DataFrame:
    """docs, with n_chars that is the text's, if there is such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _wide(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return _counted(found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the latest policy keeps; null and empty texts have too few words."""
    return rules.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those with nothing else go."""
    return _wide(lines.dedup_lines(_narrow(docs)).where("n_removed < n_lines OR n_lines = 0"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; of repeated ids or null ones, one row."""
    return simhash.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without benchmark passages; null texts stay null."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontam.without_passages(docs, benchmark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; a null or empty text is one piece, its end."""
    return packing.op8_best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages; each stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            dropped(before)
    return docs
