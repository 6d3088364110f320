"""Queries on the smaller projections of blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import details as D
from foliant.operators import lines as L
from foliant.operators import topics as T
from foliant.plans import score_queries as S
from foliant.plans import structure_queries as Q
from foliant.plans.score_queries import scored_sql
from foliant.session import table


def timeline_parts(spark, sf_dir):
    return D.timeline_parts(Q.typed(spark, sf_dir))


def definition_parts(spark, sf_dir):
    return D.definition_parts(Q.typed(spark, sf_dir))


def quote_parts(spark, sf_dir):
    return D.quote_parts(Q.typed(spark, sf_dir))


def entity_icons(spark, sf_dir):
    return D.entity_icons(Q.typed(spark, sf_dir))


def chart_specs(spark, sf_dir):
    return D.chart_specs(T.numeric_series(Q.typed(spark, sf_dir)))


def visual_choices(spark, sf_dir):
    return D.visual_choices(Q.section_rollup(spark, sf_dir).where("sub = 0"))


def css_rules(spark, sf_dir):
    return D.css_rules(table(spark, sf_dir, "pages"))


def blocks_by_type(spark, sf_dir):
    """Blocks of one type in document order."""
    return Q.typed(spark, sf_dir).where("type = 'callout'").select("doc_id", "seq", "content")


def field_labels(spark, sf_dir):
    """Capital labels of paragraphs; the corpus has none, so each paragraph is given one."""
    own = Q.typed(spark, sf_dir).where("type = 'paragraph'").withColumn("content", F.concat(F.lit("FIELD NAME Then "), "content"))
    return T.field_labels(own)


QUERIES = {f.__name__: f for f in (timeline_parts, definition_parts, quote_parts, entity_icons, chart_specs, visual_choices, css_rules, blocks_by_type, field_labels)}

_ICON = """CASE WHEN regexp_matches(lower(content), 'king|queen|prince|lord|duke|earl') THEN '♔' WHEN regexp_matches(lower(content), 'city|town|village|empire|palace|castle') THEN '🏰'
 WHEN regexp_matches(lower(content), 'mountain|river|forest|sea|ocean|plain') THEN '🗺' WHEN regexp_matches(lower(content), 'guild|order|faction|clan|tribe|house') THEN '⚔' ELSE '◆' END"""


def _parts(kind: str, a: str, b: str) -> str:
    return scored_sql(f" SELECT doc_id, seq, CASE WHEN contains(content, ':') THEN trim(split_part(content, ':', 1)) ELSE content END AS {a}, CASE WHEN contains(content, ':') THEN trim(substr(content, strpos(content, ':') + 1)) END AS {b} FROM typed WHERE type = '{kind}'")


SQL = {
    "timeline_parts": _parts("timeline_event", "year", "event"),
    "definition_parts": _parts("definition", "term", "meaning"),
    "quote_parts": scored_sql(
        r" SELECT doc_id, seq, CASE WHEN contains(content, ' - ') THEN trim(regexp_extract(content, '^(.*) - ', 1)) ELSE content END AS quote, CASE WHEN contains(content, ' - ') THEN trim(regexp_extract(content, '^.* - (.*)$', 1)) END AS author FROM typed WHERE type = 'quote'"
    ),
    "entity_icons": scored_sql(f" SELECT doc_id, seq, {_ICON} AS icon FROM typed WHERE type = 'entity'"),
    "chart_specs": scored_sql(
        """ , n AS (SELECT doc_id, seq FROM series WHERE value IS NOT NULL GROUP BY doc_id, seq HAVING count(*) >= 3), ff AS (SELECT doc_id, min(seq) AS seq FROM n GROUP BY doc_id)
        SELECT s.doc_id, s.seq, count(*) AS points, sum(s.value) AS total, CASE WHEN count(*) <= 6 THEN 'pie' ELSE 'bar' END AS kind FROM series s JOIN ff ON ff.doc_id = s.doc_id AND ff.seq = s.seq WHERE s.value IS NOT NULL GROUP BY s.doc_id, s.seq"""
    ),
    "visual_choices": scored_sql(" SELECT doc_id, sec, sec % 6 AS painter, concat('0x', substr(md5(content), 1, 8))::UBIGINT::BIGINT AS seed FROM sectioned WHERE type = 'heading' AND level = 1"),
    "css_rules": r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) AS css FROM pages), r AS (SELECT page_id, unnest(regexp_extract_all(css, '[^{}]+\{[^{}]*\}')) AS rule, generate_subscripts(regexp_extract_all(css, '[^{}]+\{[^{}]*\}'), 1) AS a FROM s),
    d AS (SELECT page_id, a, trim(split_part(rule, '{', 1)) AS selector, unnest(string_split(regexp_extract(rule, '\{([^{}]*)\}', 1), ';')) AS decl, generate_subscripts(string_split(regexp_extract(rule, '\{([^{}]*)\}', 1), ';'), 1) AS k FROM r)
    SELECT page_id, selector, lower(trim(split_part(decl, ':', 1))) AS prop, arg_max(trim(substr(decl, strpos(decl, ':') + 1)), a * 1000 + k) AS value FROM d WHERE contains(decl, ':') GROUP BY page_id, selector, lower(trim(split_part(decl, ':', 1)))""",
    "blocks_by_type": scored_sql(" SELECT doc_id, seq, content FROM typed WHERE type = 'callout'"),
    "field_labels": scored_sql(" SELECT doc_id, 'FIELD NAME' AS label, count(*) AS n FROM typed WHERE type = 'paragraph' GROUP BY doc_id HAVING count(*) >= 2"),
}
