"""Queries on whole rendered documents, with SQL that puts nested tasks together tier by tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import margin_motif
from foliant.operators import blocks as B
from foliant.operators import lines as L
from foliant.operators import pages as G
from foliant.operators import scores as S
from foliant.plans import structure_queries as Q
from foliant.plans.score_queries import scored_sql
from foliant.plans.slide_queries import _E, _IMP, BLOCK_HTML, _md
from foliant.session import settled


def task_html(spark, sf_dir):
    return G.task_trees(B.tasks(L.classify(Q.lines(spark, sf_dir)))).select("doc_id", "root", "task_html")


def _bodies(spark, sf_dir):
    lines = Q.lines(spark, sf_dir)
    scored = settled(S.importance(B.retype(B.parse(lines))), "scored")
    own = G.with_task_trees(scored, B.tasks(L.classify(lines)))
    return G.bodies(own, L.titles(lines), S.project_type(S.project_scores(scored)))


def html_document(spark, sf_dir):
    return _bodies(spark, sf_dir)


def html_page(spark, sf_dir):
    """Pages with a frame; every third has no ornaments, every second a border."""
    own = _bodies(spark, sf_dir)
    glyph = lambda x: F.when(F.col("doc_id") % 3 != 0, margin_motif(F.lit(x)))
    body = G.framed(F.col("body"), glyph("❦"), glyph("✦"), F.col("doc_id") % 2 == 0)
    css = F.concat(F.lit(".d"), F.col("doc_id").cast("string"), F.lit(" { margin: 0; }"))
    return own.select("doc_id", F.concat(G.page(F.col("title"), body, css), F.lit("\n"), G.fragment(css, body, F.lit(False))).alias("html"))


QUERIES = {f.__name__: f for f in (task_html, html_document, html_page)}

_ROW = f"""'<label class="task-row ' || CASE WHEN checked THEN 'checked' ELSE '' END || '"><input type="checkbox" disabled' || CASE WHEN checked THEN ' checked' ELSE '' END || '><span>' || {_md('text')} || '</span></label>'"""
_LIST = """coalesce('<ul class="task-subtasks">' || string_agg('<li>' || k.html || '</li>', '' ORDER BY k.line_no) || '</ul>', '')"""
_TREES = f"""tr AS (SELECT doc_id, line_no, parent, root, {_ROW} AS label, EXISTS (SELECT 1 FROM tasks u WHERE u.doc_id = t.doc_id AND u.line_no = t.parent AND u.parent IS NOT NULL) AS third FROM tasks t),
t3 AS (SELECT doc_id, line_no, parent, label AS html FROM tr WHERE third),
t2 AS (SELECT t.doc_id, t.line_no, t.parent, label || {_LIST} AS html FROM tr t LEFT JOIN t3 k ON k.doc_id = t.doc_id AND k.parent = t.line_no WHERE t.parent IS NOT NULL AND NOT third GROUP BY t.doc_id, t.line_no, t.parent, label),
t1 AS (SELECT t.doc_id, t.line_no AS root, label || {_LIST} AS task_html FROM tr t LEFT JOIN t2 k ON k.doc_id = t.doc_id AND k.parent = t.line_no WHERE t.parent IS NULL GROUP BY t.doc_id, t.line_no, label)"""
_PAGE = f""", {_TREES}, tk AS (SELECT doc_id, task_html, row_number() OVER (PARTITION BY doc_id ORDER BY root) AS k FROM t1),
bk AS (SELECT *, sum((type = 'task')::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM scored),
hb AS (SELECT doc_id, seq, type, level, content, CASE WHEN type = 'task' THEN '<div class="task-item ' || {_IMP} || '">' || task_html || '</div>' ELSE {BLOCK_HTML} END AS html FROM bk LEFT JOIN tk USING (doc_id, k)),
ti AS (SELECT s_suppkey AS doc_id, s_name || ' Notes' AS title FROM supplier),
bodies AS (SELECT doc_id, title, '<h1>' || {_E.format(x='title')} || '</h1>' || chr(10) || CASE WHEN any_value(project) <> 'Document' THEN '<p class="doc-meta">' || any_value(project) || ' &mdash; ' || count(*) || ' blocks detected</p>' || chr(10) ELSE '' END
 || string_agg(CASE WHEN type = 'heading' AND lower(content) = lower(title) THEN NULL ELSE html END, chr(10) ORDER BY seq) AS body FROM hb JOIN ti USING (doc_id) JOIN ptype USING (doc_id) GROUP BY doc_id, title)"""
_RULE = "'<div class=\"margin-ornament margin-{w}\" aria-hidden=\"true\">───  {g}' || chr(65038) || '  ───</div>'"
_FRAMED = f"""fr AS (SELECT doc_id, title, '.d' || doc_id || ' {{ margin: 0; }}' AS css, '<div class="page-frame' || CASE WHEN doc_id % 2 = 0 THEN ' page-frame-border' ELSE '' END || '">' || CASE WHEN doc_id % 3 <> 0 THEN {_RULE.format(w='top', g='❦')} ELSE '' END
 || body || CASE WHEN doc_id % 3 <> 0 THEN {_RULE.format(w='bottom', g='✦')} ELSE '' END || '</div>' AS body FROM bodies)"""

SQL = {
    "task_html": scored_sql(f", {_TREES} SELECT doc_id, root, task_html FROM t1"),
    "html_document": scored_sql(f"{_PAGE} SELECT doc_id, title, body FROM bodies"),
    "html_page": scored_sql(
        f"""{_PAGE}, {_FRAMED} SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<meta name="viewport" content="width=device-width, initial-scale=1.0">' || chr(10)
        || '<title>' || {_E.format(x='title')} || '</title>' || chr(10) || '<style>' || chr(10) || css || chr(10) || '</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || body || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)
        || '<!--FRAGMENT:' || to_json({{'css': css, 'html': body, 'fa': false}})::VARCHAR || ':FRAGMENT-->' AS html FROM fr"""
    ),
}
