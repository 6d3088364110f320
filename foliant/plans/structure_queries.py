"""Queries on structure: lines, blocks, sections, scores and roll-ups of the synthesised corpus."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from foliant.operators import blocks as B
from foliant.operators import lines as L
from foliant.plans.corpus import corpus
from foliant.plans.oracle import WS, over_corpus, q, rx, words


def lines(spark, sf_dir):
    return L.split_lines(corpus(spark, sf_dir))


def blocks(spark, sf_dir):
    return B.parse(lines(spark, sf_dir))


def typed(spark, sf_dir):
    """Typed blocks, kept while a query runs: scores and roll-ups read them several times."""
    return B.retype(blocks(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)


def sectioned(spark, sf_dir):
    return B.sections(typed(spark, sf_dir))


def line_stats(spark, sf_dir):
    return L.line_stats(lines(spark, sf_dir)).select("doc_id", "n_lines", "n_full", F.round("avg_len", 4).alias("avg_len"), F.col("short_limit").cast("long").alias("short_limit"))


def doc_title(spark, sf_dir):
    return L.titles(lines(spark, sf_dir))


def line_classes(spark, sf_dir):
    return L.classify(lines(spark, sf_dir)).select("doc_id", "line_no", "kind")


def heading_scan(spark, sf_dir):
    own = L.classify(lines(spark, sf_dir)).where("kind = 'heading'")
    return own.select("doc_id", "line_no", F.length(F.regexp_extract("line", L.HEADING, 1)).alias("level"), F.regexp_extract("line", L.HEADING, 2).alias("name"))


def block_stream(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "seq", "block_id", "type", "level", "content", "src", "caption")


def list_islands(spark, sf_dir):
    own = B.list_items(L.classify(lines(spark, sf_dir)))
    return own.groupBy("doc_id", "island").agg(F.count("*").alias("n_items"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def task_tree(spark, sf_dir):
    return B.tasks(L.classify(lines(spark, sf_dir))).drop("flush", "tier")


def task_progress(spark, sf_dir):
    own = B.tasks(L.classify(lines(spark, sf_dir)))
    return own.groupBy("doc_id").agg(F.count_if("checked").alias("done"), F.count("*").alias("total"))


def retyped(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", "seq", "type")


def block_type_counts(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def section_blocks(spark, sf_dir):
    return sectioned(spark, sf_dir).select("doc_id", "seq", "sec", "sub")


def section_rollup(spark, sf_dir):
    own = sectioned(spark, sf_dir)
    name = F.max(F.when((F.col("type") == "heading") & (F.col("level") == F.when(F.col("sub") == 0, 1).otherwise(2)), F.col("content")))
    return own.groupBy("doc_id", "sec", "sub").agg(name.alias("title"), F.count("*").alias("n_blocks"), F.sum(F.length("content")).alias("n_chars"))


def blocks_to_markdown(spark, sf_dir):
    return B.to_markdown(typed(spark, sf_dir))


def fence_blocks(spark, sf_dir):
    return L.fences(lines(spark, sf_dir)).groupBy("doc_id").agg(F.count_if("is_fence").alias("fences"), F.count_if("in_code").alias("code_lines"))


def raw_classes(spark, sf_dir):
    return L.classify_raw(lines(spark, sf_dir)).select("doc_id", "line_no", "tag")


QUERIES = {f.__name__: f for f in (line_stats, doc_title, line_classes, heading_scan, block_stream, list_islands, task_tree, task_progress, retyped, block_type_counts, section_blocks, section_rollup, blocks_to_markdown, fence_blocks, raw_classes)}

SQL = {
    "line_stats": over_corpus(
        """ SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '') AS n_full, round(coalesce(avg(length(line)) FILTER (line <> ''), 0), 4) AS avg_len,
        least(greatest(floor(coalesce(avg(length(line)) FILTER (line <> ''), 0) * 0.45), 15), 60)::BIGINT AS short_limit FROM classed GROUP BY doc_id""",
        False,
    ),
    "doc_title": over_corpus(
        f""" SELECT doc_id, coalesce(arg_min(trim(substr(line, 3)), line_no) FILTER (starts_with(line, '# ') AND NOT list_contains(['{"','".join(L.NON_TITLES)}'], rtrim(lower(trim(substr(line, 3))), '.:'))), 'Untitled Document') AS title
        FROM classed GROUP BY doc_id""",
        False,
    ),
    "line_classes": over_corpus(" SELECT doc_id, line_no, kind FROM classed", False),
    "heading_scan": over_corpus(r" SELECT doc_id, line_no, length(regexp_extract(line, '^(#+)\s', 1)) AS level, regexp_extract(line, '^#+\s+(.+)$', 1) AS name FROM classed WHERE kind = 'heading'", False),
    "block_stream": over_corpus(" SELECT doc_id, seq, printf('b%04d', seq + 1) AS block_id, type, level, content, src, caption FROM blocks"),
    "list_islands": over_corpus(" SELECT doc_id, island, count(*) AS n_items, min(line_no) AS first, max(line_no) AS last FROM list_items GROUP BY doc_id, island"),
    "task_tree": over_corpus(" SELECT doc_id, line_no, depth, checked, text, parent, root FROM tasks"),
    "task_progress": over_corpus(" SELECT doc_id, count(*) FILTER (checked) AS done, count(*) AS total FROM tasks GROUP BY doc_id"),
    "retyped": over_corpus(" SELECT doc_id, seq, type FROM typed"),
    "block_type_counts": over_corpus(" SELECT doc_id, type, count(*) AS n FROM typed GROUP BY doc_id, type"),
    "section_blocks": over_corpus(" SELECT doc_id, seq, sec, sub FROM sectioned"),
    "section_rollup": over_corpus(
        " SELECT doc_id, sec, sub, max(CASE WHEN type = 'heading' AND level = CASE WHEN sub = 0 THEN 1 ELSE 2 END THEN content END) AS title, count(*) AS n_blocks, sum(length(content)) AS n_chars FROM sectioned GROUP BY doc_id, sec, sub"
    ),
    "blocks_to_markdown": over_corpus(
        """ SELECT doc_id, string_agg(CASE type WHEN 'heading' THEN repeat('#', greatest(level, 1)) || ' ' || content WHEN 'entity' THEN repeat('#', greatest(level, 1)) || ' ' || content WHEN 'quote' THEN '> ' || content
        WHEN 'code' THEN '```' || chr(10) || content || chr(10) || '```' WHEN 'divider' THEN '---' WHEN 'image' THEN '![' || content || '](' || coalesce(src, '') || ')' || coalesce(chr(10) || '*' || caption || '*', '') ELSE content END, chr(10) || chr(10) ORDER BY seq) AS markdown
        FROM typed GROUP BY doc_id"""
    ),
    "fence_blocks": over_corpus(" SELECT doc_id, count(*) FILTER (is_fence) AS fences, count(*) FILTER (in_code) AS code_lines FROM classed GROUP BY doc_id", False),
}


def _size(x: str) -> str:
    return f"len({words(x)})"


_LABEL, _REST = f"trim(regexp_extract(line, {q(L.COLON_LABEL)}, 1), {WS})", f"trim(regexp_extract(line, {q(L.COLON_LABEL)}, 2), {WS})"
_TITLED = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: regexp_matches(w, '^\\p{L}') AND NOT regexp_matches(w, '^\\p{Lu}'))) = 0"
_LETTERS = f"trim(regexp_replace(line, '[^a-zA-Z\\s]', '', 'g'), {WS})"
_CAPS = f"({_LETTERS} <> '' AND {_LETTERS} = upper({_LETTERS}) AND length(line) <= 60 AND {_size('line')} <= 8)"
_SHORT = f"(length(line) <= short_limit AND after_blank AND {_TITLED})"
SQL["raw_classes"] = over_corpus(
    f""" , st AS (SELECT doc_id, least(greatest(floor(coalesce(avg(length(line)) FILTER (line <> ''), 0) * 0.45), 15), 60) AS short_limit FROM lines GROUP BY doc_id),
    ln AS (SELECT l.*, st.short_limit, coalesce(lag(line) OVER (PARTITION BY l.doc_id ORDER BY line_no), '') = '' AS after_blank FROM lines l JOIN st ON st.doc_id = l.doc_id)
    SELECT doc_id, line_no, CASE WHEN line = '' THEN 'blank' {' '.join(f"WHEN {rx('line', p)} THEN '{n}'" for n, p in L.RAW_RULES)}
    WHEN {_CAPS} AND {_size('line')} <= 3 THEN 'h1' WHEN {_CAPS} THEN 'h2'
    WHEN {rx('line', L.COLON_LABEL)} AND ({rx(_LABEL, L.HEADING_WORDS)} OR ({_size(_LABEL)} <= 4 AND {_REST} = '')) THEN 'h2'
    WHEN {rx('line', L.COLON_LABEL)} AND {_size(_LABEL)} <= 3 AND length({_REST}) > 15 THEN 'definition' WHEN {rx('line', L.COLON_LABEL)} AND {_size(_LABEL)} <= 5 AND {_REST} = '' THEN 'h3'
    WHEN {_SHORT} AND {_size('line')} <= 3 THEN 'h3_entity' WHEN {_SHORT} AND {_size('line')} <= 5 THEN 'h2' WHEN {rx('line', L.HEADING_WORDS)} AND {_size('line')} <= 4 THEN 'h2'
    WHEN contains(line, chr(9)) OR ({rx('line', ' {4,}')} AND {_size('line')} >= 3) THEN 'table_row'
    WHEN {rx('line', L.RAW_DEFINITION)} AND {_size(f"regexp_extract(line, {q(L.RAW_DEFINITION)}, 1)")} <= 3 THEN 'definition' ELSE 'para' END AS tag FROM ln""",
    False,
)
