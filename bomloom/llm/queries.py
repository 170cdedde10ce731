"""The queries of this subpackage: one thin query for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontam, fim, html, langid, lines, lm, mixing, packing, rules, simhash, suffix_index, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _on(op: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: op(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": _pipeline,
        "op1_suffix_array_dedup": _on(suffix_index.op1_suffix_array_dedup, "documents"),
        "op2_toxicity": _on(toxicity.op2_toxicity, "documents", "labels"),
        "op3_language_id": _on(langid.op3_language_id, "documents"),
        "op4_simhash_dedup": _on(simhash.op4_simhash_dedup, "documents"),
        "op5_quality_rules": _on(rules.op5_quality_rules, "documents"),
        "op6_lm_scoring": _on(lm.op6_lm_scoring, "documents"),
        "op7_line_dedup": _on(lines.op7_line_dedup, "documents"),
        "op8_best_fit_packing": _on(packing.op8_best_fit_packing, "documents"),
        "op9_html_extraction": _on(html.op9_html_extraction, "pages"),
        "op10_decontamination": _on(decontam.op10_decontamination, "documents", "benchmark"),
        "op11_fill_in_middle": _on(fim.op11_fill_in_middle, "documents"),
        "op12_tokenizer_alignment": _on(alignment.op12_tokenizer_alignment, "documents"),
        "op13_source_mixing": _on(mixing.op13_source_mixing, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": fim.OP11_SQL, "op13_source_mixing": mixing.OP13_SQL}
