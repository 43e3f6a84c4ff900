"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import chat, common, fingerprint, html_tpr, langid, media, mixing, neardup, negatives, quality, rules, sp_maxplus, token_orc, trie

_QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_token_orc": token_orc.op2_token_orc,
    "op3_html_extraction": html_tpr.op3_html_extraction,
    "op4_sentencepiece": sp_maxplus.op4_sentencepiece,
    "op5_media_columns": media.op5_media_columns,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": langid.op7_language_id,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_quality_rules": rules.op11_quality_rules,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}


def _run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.let_workers_import(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(f) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op6_mixing": mixing.ORACLE, "op11_quality_rules": rules.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_hard_negatives": negatives.ORACLE}
