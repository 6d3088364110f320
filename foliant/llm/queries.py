"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, decontam, html_extract, language_id, line_dedup, merkle, ngram_join, quality, secrets, substring_dedup, token_files, url_filter, whitening
from foliant.llm.common import bounded

Query = Callable[[SparkSession, str], DataFrame]


def _bounded(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(bounded(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_html_extraction": html_extract.query,
        "op2_bpe": bpe.query,
        "op3_line_dedup": line_dedup.query,
        "op4_url_filters": url_filter.query,
        "op5_ngram_jaccard": ngram_join.query,
        "op6_decontamination": decontam.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_secret_scans": secrets.query,
        "op9_quality_rules": quality.query,
        "op10_token_files": token_files.query,
        "op11_language_id": language_id.query,
        "op12_embedding_whitening": whitening.query,
        "op13_merkle_manifest": merkle.query,
    }
    return {name: _bounded(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op4_url_filters": url_filter.SQL,
        "op13_merkle_manifest": merkle.SQL,
    }
