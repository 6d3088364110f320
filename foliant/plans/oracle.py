"""SQL twins of the parsing plan: common table expressions over the synthesised corpus."""

from __future__ import annotations

from foliant.operators import blocks as B
from foliant.operators import lines as L
from foliant.plans.corpus import CORPUS_SQL

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_rx(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(rx(x, p) for p in patterns) + ")"


def group(x: str, patterns: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {rx(x, p)} THEN regexp_extract({x}, {q(p)}, 1)" for p in patterns) + " END"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def in_list(names: list[str] | tuple[str, ...]) -> str:
    return "[" + ",".join(q(n) for n in names) + "]"


def lines_of(docs: str) -> str:
    return f"""
t AS (SELECT doc_id, string_split(trim(coalesce(text, ''), {WS}), chr(10)) AS parts FROM {docs}),
lines AS (SELECT doc_id, line_no - 1 AS line_no, raw, trim(raw, {WS}) AS line FROM (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line_no FROM t))"""


CLASSES = f"""
fenced AS (SELECT *, starts_with(line, '```') AS is_fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fence FROM lines),
coded AS (SELECT *, (NOT is_fence AND fence % 2 = 1) AS in_code FROM fenced),
classed AS (SELECT *, CASE WHEN is_fence THEN 'fence' WHEN in_code THEN 'code' WHEN {rx('raw', L.TASK)} THEN 'task' WHEN line = '' THEN 'blank'
  WHEN {rx('line', L.HEADING)} THEN 'heading' WHEN {rx('line', L.IMAGE)} THEN 'image' WHEN {rx('line', L.DIVIDER)} THEN 'divider' WHEN starts_with(line, '|') THEN 'table'
  WHEN starts_with(line, '> ') THEN 'quote' WHEN {rx('line', L.LIST)} THEN 'list' WHEN {any_rx('line', L.CALLOUTS)} THEN 'callout' WHEN {any_rx('line', L.WARNINGS)} THEN 'warning'
  WHEN {rx('line', L.RELATIONSHIP)} THEN 'relationship' WHEN {rx('line', L.TIMELINE)} THEN 'timeline_event' WHEN {rx('line', L.DEFINITION)} THEN 'definition' ELSE 'paragraph' END AS kind FROM coded)"""

_ENTITY = f"(len({words('lower(name)')}) <= 4 AND NOT list_has_any({words('lower(name)')}, {in_list(B.GENERIC_ENTITY)}) AND {rx('name', '^[A-Z]')})"
_NAME = (
    f"(len({words('content')}) BETWEEN 1 AND 5 AND NOT ends_with(content, ':') AND NOT {rx('content', '[0-9]')}"
    f" AND len(list_filter({words('content')}, lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 1)) = 0"
    f" AND len(list_filter({words('content')}, lambda w: regexp_matches(w, '^[a-z]'))) = 0"
    f" AND NOT list_has_any(list_transform({words('content')}, lambda w: trim(lower(w), ':,&')), {in_list(B.GENERIC_NAME)}))"
)
_STARTS = r"^(?:- |\* |> |```|\|)"

BLOCKS = f"""
capt AS (SELECT *, lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2,
  coalesce({rx('line', L.CAPTION)} AND (lag(kind, 1) OVER w = 'image' OR (lag(kind, 2) OVER w = 'image' AND lag(line, 1) OVER w = '')), false) AS is_cap
  FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
m AS (SELECT * REPLACE (CASE WHEN is_cap THEN 'blank' ELSE kind END AS kind) FROM capt),
ab AS (SELECT *, kind = 'paragraph' AS a, (kind IN ('blank', 'fence', 'code') OR {rx('line', '^#{1,6}' + chr(92) + 's')} OR {rx('line', _STARTS)} OR {rx('line', '^[0-9]+[.]' + chr(92) + 's')} OR {rx('line', L.STOP_PARAGRAPH)}) AS b FROM m),
opn AS (SELECT *, coalesce(max(CASE WHEN a THEN line_no END) OVER w >= coalesce(max(CASE WHEN b THEN line_no END) OVER w, -1), false) AS is_open FROM ab WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
fst AS (SELECT *, a AND (b OR NOT coalesce(lag(is_open) OVER (PARTITION BY doc_id ORDER BY line_no), false)) AS is_first FROM opn),
para AS (SELECT *, CASE WHEN is_open THEN max(CASE WHEN is_first THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) END AS para FROM fst),
o AS (SELECT * FROM para WHERE kind NOT IN ('fence', 'code')),
runs AS (SELECT *, sum((kind <> 'list')::INT) OVER w AS l_isl, sum((kind <> 'table')::INT) OVER w AS t_isl, sum((kind <> 'task')::INT) OVER w AS k_isl,
  min(CASE WHEN kind <> 'list' THEN line_no END) OVER f AS l_end, min(CASE WHEN kind <> 'table' THEN line_no END) OVER f AS t_end, min(CASE WHEN kind <> 'task' THEN line_no END) OVER f AS k_end
  FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no), f AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
list_items AS (SELECT doc_id, l_isl AS island, line_no, regexp_replace(line, '^[-*0-9.]+\\s+', '') AS item, l_end AS flush FROM runs WHERE kind = 'list'),
table_rows AS (SELECT doc_id, t_isl AS island, line_no, line AS row, t_end AS flush FROM runs WHERE kind = 'table' AND NOT {rx('line', L.SEPARATOR)}),
task0 AS (SELECT doc_id, k_isl, line_no, length(replace(regexp_extract(raw, {q(L.TASK)}, 1), chr(9), '    ')) // 2 AS depth, lower(regexp_extract(raw, {q(L.TASK)}, 2)) = 'x' AS checked,
  trim(regexp_extract(raw, {q(L.TASK)}, 3), {WS}) AS text, k_end AS flush FROM runs WHERE kind = 'task'),
task1 AS (SELECT *, (SELECT max(p.line_no) FROM task0 p WHERE p.doc_id = c.doc_id AND p.k_isl = c.k_isl AND p.line_no < c.line_no AND p.depth < c.depth) AS parent FROM task0 c),
tasks AS (SELECT doc_id, line_no, depth, checked, text, parent, max(CASE WHEN parent IS NULL THEN line_no END) OVER (PARTITION BY doc_id, k_isl ORDER BY line_no) AS root, flush FROM task1),
one AS (SELECT *, length(regexp_extract(line, {q(L.HEADING)}, 1)) AS lv, trim(regexp_extract(line, {q(L.HEADING)}, 2), {WS}) AS name FROM para WHERE para IS NULL),
allb AS (
 SELECT doc_id, line_no * 2 AS pos, 0 AS tie, CASE WHEN kind = 'heading' AND lv >= 3 AND {_ENTITY} THEN 'entity' ELSE kind END AS type, CASE WHEN kind = 'heading' THEN lv ELSE 0 END AS level,
  CASE kind WHEN 'heading' THEN name WHEN 'image' THEN regexp_extract(line, {q(L.IMAGE)}, 1) WHEN 'quote' THEN trim(substr(line, 3), {WS}) WHEN 'callout' THEN trim({group('line', L.CALLOUTS)}, {WS}) WHEN 'warning' THEN trim({group('line', L.WARNINGS)}, {WS}) ELSE line END AS content,
  CASE WHEN kind = 'image' THEN regexp_extract(line, {q(L.IMAGE)}, 2) END AS src,
  CASE WHEN kind = 'image' THEN CASE WHEN {rx('n1', L.CAPTION)} THEN regexp_extract(n1, {q(L.CAPTION)}, 1) WHEN n1 = '' AND {rx('n2', L.CAPTION)} THEN regexp_extract(n2, {q(L.CAPTION)}, 1) END END AS caption
  FROM one WHERE kind IN ('heading', 'image', 'divider', 'quote', 'callout', 'warning', 'relationship', 'timeline_event', 'definition')
 UNION ALL SELECT doc_id, para * 2, 0, 'paragraph', 0, string_agg(line, ' ' ORDER BY line_no), NULL, NULL FROM para WHERE para IS NOT NULL GROUP BY doc_id, para
 UNION ALL SELECT doc_id, coalesce(flush * 2 - 1, 1000000000), line_no, 'task', 0, text, NULL, NULL FROM tasks WHERE parent IS NULL
 UNION ALL SELECT doc_id, coalesce(flush * 2 - 1, 1000000001), 0, 'list', 0, string_agg(item, chr(10) ORDER BY line_no), NULL, NULL FROM list_items GROUP BY doc_id, island, flush
 UNION ALL SELECT doc_id, coalesce(flush * 2 - 1, 1000000002), 0, 'table', 0, string_agg(row, chr(10) ORDER BY line_no), NULL, NULL FROM table_rows GROUP BY doc_id, island, flush
 UNION ALL SELECT f.doc_id, f.line_no * 2, 0, 'code', 0, coalesce(string_agg(c.raw, chr(10) ORDER BY c.line_no), ''), NULL, NULL FROM classed f LEFT JOIN classed c ON c.doc_id = f.doc_id AND c.in_code AND c.fence = f.fence - 1 WHERE f.is_fence AND f.fence % 2 = 0 GROUP BY f.doc_id, f.line_no),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, tie) - 1 AS seq, type, level, content, src, caption FROM allb),
typed AS (SELECT * REPLACE (CASE WHEN type = 'paragraph' THEN CASE
   WHEN regexp_matches(content, '(?i)\\*\\*(?:Important|Critical|Key Rule|Warning|Note|Danger|Alert)\\*\\*') THEN CASE WHEN regexp_matches(content, '(?i)\\b(?:warning|danger|alert)\\b') THEN 'warning' ELSE 'callout' END
   WHEN regexp_matches(content, '(?i)^(?:Warning|Danger|Alert)\\s*[:\\-]') THEN 'warning' WHEN regexp_matches(content, '(?i)^(?:Important|Critical|Key Rule|Note)\\s*[:\\-]') THEN 'callout'
   WHEN regexp_matches(content, '(?i)^(?:Relationship|Allied with|Enemy of|Mentor to|Rival of|Friend of)') THEN 'relationship' WHEN regexp_matches(content, '^(?:Year\\s+[0-9]{{3,4}}|[0-9]{{4}})\\b') OR regexp_matches(content, '^[0-9]{{4}}\\s*[:\\-]') THEN 'timeline_event'
   WHEN regexp_matches(content, '(?i)^(?:Definition|Term|Glossary)\\s*[:\\-]') THEN 'definition' WHEN regexp_matches(content, '(?i)^(?:See also|Reference|Source|Cf\\.)\\s*[:\\-]') THEN 'reference' ELSE 'paragraph' END
  WHEN type = 'heading' AND level >= 3 AND {_NAME} THEN 'entity' ELSE type END AS type) FROM blocks),
sectioned0 AS (SELECT *, sum((type = 'heading' AND level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS sec FROM typed),
sectioned AS (SELECT *, sum((type = 'heading' AND level = 2)::INT) OVER (PARTITION BY doc_id, sec ORDER BY seq) AS sub FROM sectioned0)"""


def over_corpus(select: str, deep: bool = True) -> str:
    """A query whose CTEs end in classed lines, or (deep) in blocks, typed and sectioned."""
    return "WITH " + ",".join([CORPUS_SQL, lines_of("corpus"), CLASSES, *([BLOCKS] if deep else [])]) + select
