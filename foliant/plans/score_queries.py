"""Queries on scores and roll-ups of the synthesised corpus and of the documents table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from foliant.operators import scores as S
from foliant.operators import topics as T
from foliant.operators.blocks import sections
from foliant.plans import structure_queries as Q
from foliant.plans.oracle import BLOCKS, CLASSES, CORPUS_SQL, lines_of
from foliant.session import table


def scored(spark, sf_dir):
    return S.importance(Q.typed(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)


def scored_sections(spark, sf_dir):
    return sections(scored(spark, sf_dir))


def term_frequency(spark, sf_dir):
    return S.term_frequency(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))


def top_terms(spark, sf_dir):
    return S.top_terms(term_frequency(spark, sf_dir))


def stopword_share(spark, sf_dir):
    from foliant.functions.text import tokens

    own = table(spark, sf_dir, "documents").select("doc_id", tokens(F.coalesce("text", F.lit("")), 3).alias("w"))
    stops = F.array(*map(F.lit, S.STOP_WORDS))
    return own.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.filter("w", lambda x: F.array_contains(stops, x))).alias("n_stops"))


def block_terms(spark, sf_dir):
    return S.term_frequency(Q.typed(spark, sf_dir))


def keyword_flags(spark, sf_dir):
    return S.keyword_flags(Q.typed(spark, sf_dir))


def importance_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "seq", "type", "importance")


def critical_blocks(spark, sf_dir):
    return scored(spark, sf_dir).where("importance >= 70").select("doc_id", "seq", "type", "importance")


def top_entities(spark, sf_dir):
    return T.top_of_type(scored(spark, sf_dir), ("entity",), 5).select("doc_id", "place", "content", "importance")


def best_paragraph(spark, sf_dir):
    return T.top_of_type(scored_sections(spark, sf_dir), ("paragraph", "callout"), 1, ("doc_id", "sec")).select("doc_id", "sec", F.substring("content", 1, 220).alias("best"))


def lead_text(spark, sf_dir):
    return T.lead(scored(spark, sf_dir))


def project_scores(spark, sf_dir):
    return S.project_scores(Q.typed(spark, sf_dir)).select("doc_id", "project", "score")


def project_types(spark, sf_dir):
    return S.project_type(S.project_scores(Q.typed(spark, sf_dir)))


def theme_suggestions(spark, sf_dir):
    return S.suggestions(project_types(spark, sf_dir))


def manuscript_flag(spark, sf_dir):
    return S.is_manuscript(Q.typed(spark, sf_dir))


def entity_descriptions(spark, sf_dir):
    return S.entity_descriptions(Q.typed(spark, sf_dir))


def topic_rollup(spark, sf_dir):
    return T.topics(scored_sections(spark, sf_dir)).select("doc_id", "sec", "title", "n_blocks", "importance", "type")


def slide_plan(spark, sf_dir):
    return T.slide_plan(T.topics(scored_sections(spark, sf_dir)))


def table_cells(spark, sf_dir):
    return T.table_cells(Q.typed(spark, sf_dir))


def numeric_series(spark, sf_dir):
    return T.numeric_series(Q.typed(spark, sf_dir))


def stat_extraction(spark, sf_dir):
    return T.stats(Q.typed(spark, sf_dir))


def bullets(spark, sf_dir):
    return T.bullets(scored_sections(spark, sf_dir))


def result_record(spark, sf_dir):
    own = scored(spark, sf_dir)
    counts = own.groupBy("doc_id").agg(F.count("*").alias("block_count"), F.count_if(F.col("type") == "entity").alias("entities"), F.max("importance").alias("top_importance"))
    return counts.join(S.project_type(S.project_scores(own)), "doc_id").join(Q.doc_title(spark, sf_dir), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        term_frequency, top_terms, stopword_share, block_terms, keyword_flags, importance_scores, critical_blocks, top_entities, best_paragraph, lead_text, project_scores, project_types, theme_suggestions, manuscript_flag,
        entity_descriptions, topic_rollup, slide_plan, table_cells, numeric_series, stat_extraction, bullets, result_record,
    )
}


def _list(names) -> str:
    return "['" + "','".join(n.replace("'", "''") for n in names) + "']"


def _tokens(x: str, least: int) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{{least},}}$'))"


def _any(names) -> str:
    return f"len(list_filter({_list(names)}, lambda k: contains(lower(content), k))) > 0"


_BASE = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.BASE.items()) + " ELSE 25 END"
_SIGNALS = "VALUES " + ",".join(f"({k}, '{p}', '{s}', {str(phrase).lower()})" for k, p, s, phrase in S.signals())
SCORES = f"""
freq AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('content', 3)}) AS word FROM typed) WHERE NOT list_contains({_list(S.STOP_WORDS)}, word) GROUP BY doc_id, word),
fame AS (SELECT l.doc_id, l.seq, avg(coalesce(f.n, 0)) AS fame FROM (SELECT doc_id, seq, unnest({_tokens('content', 4)}) AS word FROM typed) l LEFT JOIN freq f ON f.doc_id = l.doc_id AND f.word = l.word GROUP BY l.doc_id, l.seq),
names AS (SELECT DISTINCT doc_id, lower(content) AS name FROM typed WHERE type = 'entity'),
ment AS (SELECT b.doc_id, b.seq, count(*) AS mentions FROM typed b JOIN names n ON n.doc_id = b.doc_id AND length(n.name) > 3 AND contains(lower(b.content), n.name) GROUP BY b.doc_id, b.seq),
pos AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) / count(*) OVER (PARTITION BY doc_id)::DOUBLE AS ratio FROM typed),
scored AS (SELECT p.*, least(round({_BASE} + least((CASE WHEN {_any(S.HIGH)} THEN 15 ELSE 0 END) + (CASE WHEN {_any(S.MEDIUM)} THEN 7 ELSE 0 END), 20)
  + CASE WHEN regexp_matches(content, '(?i)\\*\\*(?:Important|Critical|Warning|Key Rule)\\*\\*') THEN 18 ELSE 0 END + CASE WHEN ratio < 0.1 THEN 10 WHEN ratio < 0.2 THEN 5 ELSE 0 END
  + CASE WHEN type = 'heading' THEN greatest((4 - level) * 8, 0) ELSE 0 END + CASE WHEN type = 'entity' THEN least(coalesce(r.n, 0) * 5, 25) ELSE 0 END
  + least(coalesce(m.mentions, 0) * 3, 12) + least(coalesce(a.fame, 0) * 2, 10), 1), 100) AS importance
  FROM pos p LEFT JOIN fame a ON a.doc_id = p.doc_id AND a.seq = p.seq LEFT JOIN ment m ON m.doc_id = p.doc_id AND m.seq = p.seq LEFT JOIN freq r ON r.doc_id = p.doc_id AND r.word = lower(p.content)),
placed AS (SELECT s.*, x.sec, x.sub FROM scored s JOIN sectioned x ON x.doc_id = s.doc_id AND x.seq = s.seq),
signals AS (SELECT * FROM ({_SIGNALS}) AS t(ord, project, signal, phrase)),
toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM typed),
full_text AS (SELECT doc_id, string_agg(lower(content), ' ' ORDER BY seq) AS x, count(*) FILTER (type = 'entity') AS e, count(*) FILTER (type = 'timeline_event') AS t, count(*) FILTER (type = 'relationship') AS r FROM typed GROUP BY doc_id),
hits AS (SELECT doc_id, ord, count(*) AS n FROM toks JOIN signals ON w = signal AND NOT phrase GROUP BY doc_id, ord
  UNION ALL SELECT doc_id, ord, ((length(x) - length(replace(x, signal, ''))) // length(signal)) * 3 FROM full_text, signals WHERE phrase),
pscore AS (SELECT f.doc_id, k.ord, k.project, coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = f.doc_id AND h.ord = k.ord), 0)
  + CASE k.ord WHEN 0 THEN CASE WHEN e > 3 THEN e * 3 ELSE 0 END + CASE WHEN t > 2 THEN t * 2 ELSE 0 END + CASE WHEN r > 1 THEN r * 3 ELSE 0 END WHEN 3 THEN CASE WHEN e > 3 THEN e * 2 ELSE 0 END WHEN 2 THEN CASE WHEN t > 2 THEN t * 2 ELSE 0 END ELSE 0 END AS score
  FROM full_text f, (SELECT DISTINCT ord, project FROM signals) k),
ptype AS (SELECT doc_id, CASE WHEN sum(score) >= 6 THEN arg_max(project, score * 100 - ord) ELSE 'Document' END AS project, CASE WHEN sum(score) >= 6 THEN least(round(max(score) * 100 / sum(score), 1), 95) ELSE 0 END::DOUBLE AS confidence FROM pscore GROUP BY doc_id),
topic AS (SELECT doc_id, sec, max(CASE WHEN type = 'heading' AND level = 1 THEN content END) AS title, count(*) FILTER (type <> 'heading') AS n_blocks, round(avg(importance) FILTER (type <> 'heading'), 4) AS importance,
  count(*) FILTER (type = 'entity') AS entities, count(*) FILTER (type = 'timeline_event') AS timelines, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'warning') AS warnings, count(*) FILTER (type = 'quote') AS quotes, count(*) FILTER (type = 'paragraph') AS paragraphs,
  count(*) FILTER (type = 'warning' AND importance >= 50) AS strong, arg_min(length(content), seq) FILTER (type = 'quote' AND importance >= 40) AS quote_size FROM placed GROUP BY doc_id, sec HAVING count(*) FILTER (type <> 'heading') > 0),
topics AS (SELECT *, CASE WHEN entities >= 3 THEN 'entities' WHEN timelines >= 3 THEN 'timeline' WHEN tables >= 1 THEN 'data' WHEN warnings >= 1 THEN 'warning' WHEN quotes >= 1 THEN 'quote' ELSE 'general' END AS type FROM topic),
trows AS (SELECT doc_id, seq, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS row FROM typed WHERE type = 'table'),
cells AS (SELECT doc_id, seq, row, trim(unnest(string_split(trim(x, '|'), '|'))) AS cell, generate_subscripts(string_split(trim(x, '|'), '|'), 1) - 1 AS col FROM trows),
series AS (SELECT doc_id, seq, row, max(CASE WHEN col = 0 THEN substr(cell, 1, 20) END) AS label, max(CASE WHEN col = 1 THEN try_cast(nullif(regexp_replace(cell, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) END) AS value FROM cells WHERE row BETWEEN 1 AND 8 GROUP BY doc_id, seq, row)"""


def scored_sql(select: str) -> str:
    return "WITH " + ",".join([CORPUS_SQL, lines_of("corpus"), CLASSES, BLOCKS, SCORES]) + select


def _ranked(kinds: str, per: str = "doc_id", src: str = "placed") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY importance DESC, seq) AS place FROM {src} WHERE type IN ({kinds}))"


_DOC_TOKENS = f"(SELECT doc_id, unnest({_tokens('text', 3)}) AS word FROM documents)"
_DOC_FREQ = f"SELECT doc_id, word, count(*) AS n FROM {_DOC_TOKENS} WHERE NOT list_contains({_list(S.STOP_WORDS)}, word) GROUP BY doc_id, word"
_THEMES = "CASE project " + " ".join(f"WHEN '{p}' THEN {_list(t)}" for p, t in S.SUGGESTIONS.items()) + " END"
_ESC = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

SQL = {
    "term_frequency": _DOC_FREQ,
    "top_terms": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM ({_DOC_FREQ})) WHERE place <= 5",
    "stopword_share": f"SELECT doc_id, len(w) AS n_tokens, len(list_filter(w, lambda x: list_contains({_list(S.STOP_WORDS)}, x))) AS n_stops FROM (SELECT doc_id, {_tokens('text', 3)} AS w FROM documents)",
    "block_terms": scored_sql(" SELECT doc_id, word, n FROM freq"),
    "keyword_flags": scored_sql(f" SELECT doc_id, seq, {_any(S.HIGH)} AS high, {_any(S.MEDIUM)} AS medium FROM typed"),
    "importance_scores": scored_sql(" SELECT doc_id, seq, type, importance FROM scored"),
    "critical_blocks": scored_sql(" SELECT doc_id, seq, type, importance FROM scored WHERE importance >= 70"),
    "top_entities": scored_sql(f" SELECT doc_id, place, content, importance FROM {_ranked(chr(39) + 'entity' + chr(39))} WHERE place <= 5"),
    "best_paragraph": scored_sql(f" SELECT doc_id, sec, substr(content, 1, 220) AS best FROM {_ranked(chr(39) + 'paragraph' + chr(39) + ',' + chr(39) + 'callout' + chr(39), 'doc_id, sec')} WHERE place = 1"),
    "lead_text": scored_sql(
        f""" , r AS (SELECT * FROM {_ranked("'paragraph','callout'")} WHERE place <= 3), u AS (SELECT doc_id, substr(content, 1, 200) AS x, min(place) AS p FROM r GROUP BY doc_id, substr(content, 1, 200)),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM u) SELECT doc_id, substr(string_agg(x, ' ' ORDER BY p), 1, 380) AS lead FROM k WHERE k <= 2 GROUP BY doc_id"""
    ),
    "project_scores": scored_sql(" SELECT doc_id, project, score FROM pscore"),
    "project_types": scored_sql(" SELECT doc_id, project, confidence FROM ptype"),
    "theme_suggestions": scored_sql(f" SELECT doc_id, place, theme, greatest(confidence - place * 15, 20) AS confidence FROM (SELECT doc_id, confidence, unnest({_THEMES}) AS theme, generate_subscripts({_THEMES}, 1) - 1 AS place FROM ptype)"),
    "manuscript_flag": scored_sql(" SELECT doc_id, count(*) >= 20 AND avg((type IN ('paragraph', 'heading', 'quote', 'divider'))::INT) > 0.9 AS manuscript FROM typed GROUP BY doc_id"),
    "entity_descriptions": scored_sql(
        """ SELECT e.doc_id, e.seq, e.content AS name, (SELECT arg_min(b.content, b.seq) FROM typed b WHERE b.doc_id = e.doc_id AND b.seq BETWEEN e.seq + 1 AND e.seq + 3 AND b.type IN ('paragraph', 'quote')) AS description FROM typed e WHERE e.type = 'entity'"""
    ),
    "topic_rollup": scored_sql(" SELECT doc_id, sec, title, n_blocks, importance, type FROM topics"),
    "slide_plan": scored_sql(
        f""" , w AS (SELECT doc_id, sec, list_filter(['main', CASE WHEN type = 'entities' AND entities >= 3 THEN 'entities' END, CASE WHEN timelines >= 3 THEN 'timeline' END, CASE WHEN tables >= 1 THEN 'data' END, CASE WHEN strong >= 1 THEN 'warning' END,
        CASE WHEN quote_size > 30 THEN 'quote' END, CASE WHEN paragraphs >= 2 THEN 'evidence' END], lambda x: x IS NOT NULL) AS s FROM topics), p AS (SELECT doc_id, sec, unnest(s) AS slide, generate_subscripts(s, 1) - 1 AS place FROM w)
        SELECT doc_id, sec, place, slide, ({_list(T.LAYOUTS)})[((row_number() OVER (PARTITION BY doc_id ORDER BY sec, place) - 1) % 8 + 1)::INT] AS layout FROM p"""
    ),
    "table_cells": scored_sql(" SELECT doc_id, seq, row, col, cell FROM cells"),
    "numeric_series": scored_sql(
        """ , n AS (SELECT doc_id, seq FROM series WHERE value IS NOT NULL GROUP BY doc_id, seq HAVING count(*) >= 3), f AS (SELECT doc_id, min(seq) AS seq FROM n GROUP BY doc_id)
        SELECT s.doc_id, s.seq, s.row, s.label, s.value FROM series s JOIN f ON f.doc_id = s.doc_id AND f.seq = s.seq WHERE s.value IS NOT NULL"""
    ),
    "stat_extraction": scored_sql(
        r""" , v AS (SELECT doc_id, seq, regexp_extract_all(content, '(?:^|[^0-9A-Za-z_.,])(\d[\d,]*(?:\.\d+)?%?)', 1) AS xs FROM typed WHERE type IN ('paragraph', 'list', 'callout')),
        x AS (SELECT doc_id, seq, rtrim(unnest(xs), ',') AS val, generate_subscripts(xs, 1) - 1 AS pos FROM v), k AS (SELECT * FROM x WHERE try_cast(regexp_replace(val, '[,%]', '', 'g') AS DOUBLE) > 0),
        g AS (SELECT doc_id, val, min(seq * 100000 + pos) AS p, min(seq) AS first_seq FROM k GROUP BY doc_id, val), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS place FROM g) SELECT doc_id, val, first_seq, place FROM z WHERE place <= 4"""
    ),
    "bullets": scored_sql(
        """ , i AS (SELECT doc_id, sec, seq, CASE type WHEN 'callout' THEN 0 WHEN 'list' THEN 1 WHEN 'task' THEN 2 WHEN 'definition' THEN 3 WHEN 'relationship' THEN 4 WHEN 'paragraph' THEN 5 END AS prio,
        CASE type WHEN 'list' THEN 5 ELSE 2 END AS most, CASE type WHEN 'list' THEN string_split(content, chr(10)) ELSE [content] END AS xs FROM placed WHERE type IN ('callout', 'list', 'task', 'definition', 'relationship', 'paragraph')),
        u AS (SELECT *, unnest(xs) AS bullet, generate_subscripts(xs, 1) AS pos FROM i), oo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec, prio ORDER BY seq, pos) AS own FROM u),
        z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY prio, seq, pos) AS place FROM oo WHERE own <= most) SELECT doc_id, sec, place, substr(bullet, 1, 130) AS bullet FROM z WHERE place <= 5"""
    ),
    "result_record": scored_sql(
        """ SELECT s.doc_id, count(*) AS block_count, count(*) FILTER (type = 'entity') AS entities, max(importance) AS top_importance, any_value(p.project) AS project, any_value(p.confidence) AS confidence, arg_min(content, seq) AS title
        FROM scored s JOIN ptype p ON p.doc_id = s.doc_id GROUP BY s.doc_id"""
    ),
}
