"""The registry of queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import decor_queries, design_queries, detail_queries, import_queries, lexicon_queries, page_queries, raw_queries, reading_queries, score_queries, session_queries, slide_queries, source_queries, structure_queries, style_queries

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "block_stream"
MODULES = (structure_queries, score_queries, design_queries, source_queries, detail_queries, slide_queries, style_queries, reading_queries, lexicon_queries, raw_queries, page_queries, decor_queries, import_queries, session_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
