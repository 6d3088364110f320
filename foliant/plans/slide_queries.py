"""Queries on slide texts, HTML blocks and aligned text, with SQL written apart from the code it checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.text import html_escaped, strip
from foliant.operators import details as D
from foliant.operators import layout as Y
from foliant.operators import slides as P
from foliant.operators import topics as T
from foliant.plans import design_queries as G
from foliant.plans import score_queries as S
from foliant.plans import structure_queries as Q
from foliant.plans.detail_queries import _ICON
from foliant.plans.oracle import over_corpus
from foliant.plans.score_queries import scored_sql
from foliant.session import table


def _head():
    return F.max(F.when((F.col("type") == "heading") & (F.col("level") == F.when(F.col("sub") == 0, 1).otherwise(2)), F.col("content")))


def _title():
    return F.coalesce("title", F.lit("Overview"))


def _topics(blocks):
    """A topic for each part under a heading of level 1 or 2 with content."""
    return blocks.groupBy("doc_id", "sec", "sub").agg(_head().alias("title"), F.count_if(F.col("type") != "heading").alias("n")).where("n > 0")


def title_tagline(spark, sf_dir):
    return P.tagline(S.scored(spark, sf_dir))


def agenda(spark, sf_dir):
    return P.agenda(_topics(S.scored_sections(spark, sf_dir)), _title())


def key_points(spark, sf_dir):
    own = S.scored_sections(spark, sf_dir)
    return P.key_points(_topics(own), own, _title())


def evidence_slides(spark, sf_dir):
    return P.evidence(S.scored_sections(spark, sf_dir))


def brief_cards(spark, sf_dir):
    return P.brief(S.scored_sections(spark, sf_dir), F.coalesce(_head(), F.lit("Overview")))


def topic_icons(spark, sf_dir):
    own = T.topics(S.scored_sections(spark, sf_dir))
    return own.select("doc_id", "sec", P.icon_of(F.col("type"), "◆").alias("icon"))


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o, k


def list_series(spark, sf_dir):
    """Lists of four items from orders; every third value is no number, every fifth list has other separators."""
    o, k = _orders(spark, sf_dir)
    sep = F.when(k % 5 == 0, " — ").when(k % 5 == 1, "-").otherwise(": ")
    item = lambda n, x: F.concat(F.lit(f"{n} of "), "o_orderstatus", sep, x)
    third = F.when(k % 3 == 0, "none").otherwise((k % 97).cast("string"))
    text = F.concat_ws("\n", item("Count", F.concat((k % 1000).cast("string"), F.lit("%"))), item("Share", F.lit("1,250.5")), item("Rest", third), F.lit("no number here"))
    own = o.select(k.alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("a: 1\nb: 2").alias("content")), F.struct(F.lit(1).alias("seq"), text.alias("content")))).alias("b"), F.lit("list").alias("type"))
    return P.list_series(own.select("doc_id", "type", "b.*"))


def labelled_stats(spark, sf_dir):
    """Numbers in the structured corpus and in sentences of orders."""
    o, k = _orders(spark, sf_dir)
    text = F.concat(F.lit("Sold "), (k % 7).cast("string"), F.lit(" crates of ore. Grew 40% in "), (F.lit(1990) + k % 30).cast("string"), F.lit(", then 3x more. Took 1,200 days, "), (k % 3).cast("string"), F.lit(" crates left; 9 8 7 6"))
    return P.labelled_stats(o.select(k.alias("doc_id"), F.lit(0).alias("seq"), F.lit("paragraph").alias("type"), text.alias("content")))


def topic_series(spark, sf_dir):
    """What the chart of each topic shows; every third document has no tables, so that its lists serve."""
    own = Q.sectioned(spark, sf_dir).where("NOT (type = 'table' AND doc_id % 3 = 1)")
    return P.chart_series(own, ("doc_id", "sec", "sub"))


def topic_stats(spark, sf_dir):
    return P.labelled_stats(Q.sectioned(spark, sf_dir), ("doc_id", "sec", "sub"))


def aligned_tables(spark, sf_dir):
    """Texts of aligned columns from parts, with tabs or runs of spaces, some rows short."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    sep = F.when(k % 3 == 0, "\t").when(k % 3 == 1, "    ").otherwise("   ")
    text = F.concat_ws("\n", F.concat(F.lit("name"), sep, F.lit("size"), sep, F.lit("type  x")), F.concat("p_name", sep, F.col("p_size").cast("string")), F.concat(sep, F.lit("only"), sep), F.lit("  "), F.concat("p_brand", sep, F.lit("7"), sep, "p_type"))
    return D.aligned_tables(p.select(k.alias("doc_id"), text.alias("text")))


def inline_signals(spark, sf_dir):
    """Sentences of parts with signals inside."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, ("Warning", "note", "KEY RULE", "Hint", "Danger"))), (k % 5 + 1).cast("int"))
    text = F.concat(F.col("p_name"), F.when(k % 2 == 0, ".  ").otherwise(" "), word, F.when(k % 3 == 0, " - ").otherwise(": "), "p_type", F.lit(". Important: keep dry. End"))
    return D.inline_signals(p.select(k.alias("doc_id"), text.alias("text")))


def page_folios(spark, sf_dir):
    """Pages whose last line is a number, near or far from the line above."""
    own = Y.visual_lines(G._pages(spark, sf_dir))
    last = F.col("line") == F.max("line").over(Window.partitionBy("doc_id", "page"))
    far = F.when(F.col("page") % 2 == 0, 30.0).otherwise(0.0)
    own = own.withColumns({"text": F.when(last, F.col("page").cast("string")).otherwise(F.col("text")), "top": F.when(last, F.col("top") + far).otherwise(F.col("top"))})
    return Y.without_folios(own).groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.max("line").alias("last"))


def column_margins(spark, sf_dir):
    """The margin of the left and of the right half of each document's pages."""
    size = G.WORDS_PER_LINE
    half = lambda i, col, at: F.struct(i.alias("line"), F.lit(col).alias("col"), F.array_min(F.transform(F.filter(F.slice("words", i * size + 1, size), lambda w: at(w["x0"])), lambda w: w["x0"])).alias("x0"))
    each = lambda i: F.array(half(i, 0, lambda x: x < 320), half(i, 1, lambda x: x >= 320))
    rows = F.sequence(F.lit(0), F.ceil(F.size("words") / size).cast("int") - 1)
    lines = G._pages(spark, sf_dir).select("doc_id", "page", F.inline(F.flatten(F.transform(rows, each)))).where("x0 IS NOT NULL")
    return Y.column_margins(lines)


def block_html(spark, sf_dir):
    own = S.scored(spark, sf_dir).where("type <> 'task'")
    return T.block_html(own).select("doc_id", "seq", "html")


def document_titles(spark, sf_dir):
    """Titles by blocks; documents of even number have no heading and take their file's name."""
    own = Q.typed(spark, sf_dir).where((F.col("doc_id") % 2 == 1) | ~F.col("type").isin("heading", "entity"))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("/in/the_new-notes of_"), F.col("s_suppkey").cast("string"), F.lit(".v2.docx")).alias("path"))
    return T.document_titles(files, own)


def html_fragments(spark, sf_dir):
    """The trailer of a rendered document: its fragment as JSON in a comment."""
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("<p>"), html_escaped(strip(F.col("p_name"))), F.lit("</p>"))
    return p.select("p_partkey", F.concat(F.lit("<!--FRAGMENT:"), F.to_json(F.struct(F.concat(F.lit("."), F.lower("p_brand")).alias("css"), body.alias("html"), (F.col("p_size") > 25).alias("fa"))), F.lit(":FRAGMENT-->")).alias("trailer"))


QUERIES = {
    f.__name__: f
    for f in (
        title_tagline, agenda, key_points, evidence_slides, brief_cards, topic_icons, list_series, labelled_stats, topic_series, topic_stats, aligned_tables, inline_signals, page_folios, column_margins, block_html, document_titles, html_fragments,
    )
}

_TOPICS = """, tp AS (SELECT doc_id, sec, sub, coalesce(max(CASE WHEN type = 'heading' AND level = CASE WHEN sub = 0 THEN 1 ELSE 2 END THEN content END), 'Overview') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY sec, sub) AS place,
  count(*) OVER (PARTITION BY doc_id) AS topics FROM placed GROUP BY doc_id, sec, sub HAVING count(*) FILTER (type <> 'heading') > 0)"""
_E = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _md(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({_E.format(x=x)}, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'gs'), '\*(.+?)\*', '<em>\1</em>', 'gs'), '`(.+?)`', '<code>\1</code>', 'gs')"


_IMP = "CASE WHEN importance >= 70 THEN 'importance-high' WHEN importance >= 40 THEN 'importance-med' ELSE '' END"
_CELLS = "list_transform(string_split(trim(r, '|'), '|'), lambda c: trim(c))"
_LINES = """l AS (SELECT doc_id, word_seq // 8 AS ln, word_seq % 8 AS col, text FROM (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word_seq FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM documents))),
pl AS (SELECT doc_id, ln // 20 AS page, ln % 20 AS line, string_agg(text, ' ' ORDER BY col) AS text, (ln % 20) * 12.0 AS top FROM l GROUP BY doc_id, ln)"""

BLOCK_HTML = rf"""CASE type WHEN 'heading' THEN '<h' || least(greatest(level, 1), 6) || '>' || {_md('content')} || '</h' || least(greatest(level, 1), 6) || '>'
    WHEN 'entity' THEN '<div class="entity-card entity ' || {_IMP} || '"><div class="entity-name">' || {_ICON} || ' ' || {_md('content')} || '</div></div>' WHEN 'callout' THEN '<div class="callout ' || {_IMP} || '">' || {_md('content')} || '</div>'
    WHEN 'warning' THEN '<div class="warning ' || {_IMP} || '">' || {_md('content')} || '</div>' WHEN 'timeline_event' THEN '<div class="timeline-event timeline">' || {_md('content')} || '</div>' WHEN 'relationship' THEN '<p class="relationship">' || {_md('content')} || '</p>'
    WHEN 'definition' THEN '<div class="definition">' || {_md('content')} || '</div>' WHEN 'quote' THEN '<blockquote>' || {_md('content')} || '</blockquote>' WHEN 'code' THEN '<pre><code class="language-">' || {_E.format(x='content')} || '</code></pre>' WHEN 'divider' THEN '<hr>'
    WHEN 'reference' THEN '<p class="reference">↗ ' || {_md('content')} || '</p>'
    WHEN 'image' THEN '<figure class="figure figure-wide"><img src="' || src || '" alt="' || {_E.format(x='content')} || '" loading="lazy"><figcaption>' || {_E.format(x='caption')} || '</figcaption></figure>'
    WHEN 'list' THEN '<ul>' || array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda i: trim(i) <> ''), lambda i: '<li>' || {_md('trim(i)')} || '</li>'), '') || '</ul>'
    WHEN 'table' THEN '<table>' || chr(10) || array_to_string(list_transform(string_split(content, chr(10)), lambda r, n: CASE WHEN n = 1 THEN '<thead><tr><th>' || array_to_string(list_transform({_CELLS}, lambda c: {_E.format(x='c')}), '</th><th>') || '</th></tr></thead><tbody>'
      ELSE '<tr><td>' || array_to_string(list_transform({_CELLS}, lambda c: {_E.format(x='c')}), '</td><td>') || '</td></tr>' END), chr(10)) || chr(10) || '</tbody></table>'
    ELSE '<p class="' || {_IMP} || '">' || {_md('content')} || '</p>' END"""

SQL = {
    "title_tagline": scored_sql(" , r AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, seq) AS k FROM scored WHERE type IN ('paragraph', 'callout')) SELECT doc_id, substr(content, 1, 160) AS tagline FROM r WHERE k = 1"),
    "agenda": scored_sql(_TOPICS + " SELECT doc_id, place, title AS bullet FROM tp WHERE topics >= 2 AND place <= 10"),
    "key_points": scored_sql(
        _TOPICS + """, r AS (SELECT doc_id, sec, sub, content, row_number() OVER (PARTITION BY doc_id, sec, sub ORDER BY importance DESC, type = 'paragraph', seq) AS k FROM placed WHERE type IN ('callout', 'paragraph'))
    SELECT tp.doc_id, place, title || coalesce(': ' || substr(content, 1, 100), '') AS point FROM tp LEFT JOIN r ON r.doc_id = tp.doc_id AND r.sec = tp.sec AND r.sub = tp.sub AND k = 1 WHERE place <= 6"""
    ),
    "evidence_slides": scored_sql(" , r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec, sub ORDER BY importance DESC, seq) AS place FROM placed WHERE type = 'paragraph') SELECT doc_id, sec, sub, place, substr(content, 1, 200) AS bullet FROM r WHERE place <= 3"),
    "brief_cards": scored_sql(
        """ , g AS (SELECT doc_id, sec, sub, coalesce(max(CASE WHEN type = 'heading' AND level = CASE WHEN sub = 0 THEN 1 ELSE 2 END THEN content END), 'Overview') AS title,
      list(content ORDER BY importance DESC, seq) FILTER (type IN ('paragraph', 'callout')) AS best, list(content ORDER BY seq) FILTER (type = 'entity') AS ent, count(*) AS n_blocks FROM placed GROUP BY doc_id, sec, sub),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, sub) AS place FROM g)
    SELECT doc_id, place, title, coalesce(substr(best[1], 1, 220), '') AS text, coalesce(array_to_string(ent[1:3], '; '), '') AS entities, n_blocks, (place - 1) % 2 AS shade FROM n WHERE place <= 6"""
    ),
    "topic_icons": scored_sql(" SELECT doc_id, sec, CASE type WHEN 'entities' THEN '👤' WHEN 'timeline' THEN '📅' WHEN 'data' THEN '📊' WHEN 'warning' THEN '⚠️' WHEN 'quote' THEN '💬' ELSE '◆' END AS icon FROM topics"),
    "list_series": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE o_orderkey % 5 WHEN 0 THEN ' — ' WHEN 1 THEN '-' ELSE ': ' END AS sep FROM orders),
    i AS (SELECT k, 0 AS row, substr('Count of ' || s, 1, 20) AS label, (k % 1000)::DOUBLE AS value FROM o UNION ALL SELECT k, 1, 'Share of ' || s, 1250.5 FROM o UNION ALL SELECT k, 2, 'Rest of ' || s, k % 97 FROM o WHERE k % 3 <> 0)
    SELECT k AS doc_id, 1 AS seq, row, label, value FROM i WHERE k % 3 <> 0""",
    "labelled_stats": r"""WITH o AS (SELECT o_orderkey AS k, 'Sold ' || (o_orderkey % 7) || ' crates of ore. Grew 40% in ' || (1990 + o_orderkey % 30) || ', then 3x more. Took 1,200 days, ' || (o_orderkey % 3) || ' crates left; 9 8 7 6' AS t FROM orders),
    m AS (SELECT k, t, unnest(regexp_extract_all(t, '\b(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?')) AS hit, generate_subscripts(regexp_extract_all(t, '\b(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?'), 1) AS pos FROM o),
    p AS (SELECT k, pos, t, regexp_extract(hit, '^(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?', ['num', 'unit', 'words']) AS g FROM m),
    f AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) AS n, g.num || g.unit AS val, CASE WHEN trim(g.words) <> '' THEN substr(trim(g.words), 1, 30) ELSE substr(t, 1, 30) END AS label FROM p WHERE replace(g.num, ',', '')::DOUBLE > 0),
    d AS (SELECT k, val, arg_min(label, n) AS label, min(n) AS n FROM f WHERE n <= 6 GROUP BY k, val), r AS (SELECT k, val, label, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM d)
    SELECT k AS doc_id, place, val, label FROM r WHERE place <= 4""",
    "topic_series": over_corpus(
        r""", sx AS (SELECT * FROM sectioned WHERE NOT (type = 'table' AND doc_id % 3 = 1)),
    tb AS (SELECT doc_id, sec, sub, seq, list_filter(string_split(content, chr(10)), lambda r: trim(r) <> '' AND NOT regexp_matches(r, '^\|[-:\s|]+\|?$')) AS rs FROM sx WHERE type = 'table'),
    tr AS (SELECT doc_id, sec, sub, seq, trim(string_split(trim(rs[1], '|'), '|')[1]) AS title, unnest(rs[2:9]) AS r, generate_subscripts(rs[2:9], 1) - 1 AS row FROM tb WHERE len(rs) >= 3), tc AS (SELECT *, string_split(trim(r, '|'), '|') AS c FROM tr),
    li AS (SELECT doc_id, sec, sub, seq, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS row FROM sx WHERE type = 'list'),
    ps AS (SELECT doc_id, sec, sub, seq, 0 AS kind, row, trim(c[1])[1:20] AS label, try_cast(nullif(regexp_replace(c[2], '[^0-9.\-]', '', 'g'), '') AS DOUBLE) AS value, title FROM tc
      UNION ALL SELECT doc_id, sec, sub, seq, 1, row, trim(regexp_extract(x, '^(.+?)[\s:—\-]+(\d[\d,.]*)%?\s*$', 1))[1:20], try_cast(nullif(replace(regexp_extract(x, '^(.+?)[\s:—\-]+(\d[\d,.]*)%?\s*$', 2), ',', ''), '') AS DOUBLE), '' FROM li),
    en AS (SELECT doc_id, sec, sub, seq, kind FROM ps WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), ch AS (SELECT doc_id, sec, sub, min((kind, seq)) AS p FROM en GROUP BY ALL)
    SELECT ps.doc_id, ps.sec, ps.sub, ps.seq, row, label, value, title FROM ps JOIN ch ON ch.doc_id = ps.doc_id AND ch.sec = ps.sec AND ch.sub = ps.sub AND ch.p = (ps.kind, ps.seq) WHERE value IS NOT NULL"""
    ),
    "topic_stats": over_corpus(
        r""", hx AS (SELECT doc_id, sec, sub, seq, content AS t, unnest(regexp_extract_all(content, '\b(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?')) AS hit,
      generate_subscripts(regexp_extract_all(content, '\b(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?'), 1) AS at_ FROM sectioned WHERE type IN ('paragraph', 'list', 'callout')),
    px AS (SELECT *, regexp_extract(hit, '^(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?', ['num', 'unit', 'words']) AS g FROM hx),
    fx AS (SELECT doc_id, sec, sub, row_number() OVER (PARTITION BY doc_id, sec, sub ORDER BY seq, at_) AS n, g.num || g.unit AS val, CASE WHEN trim(g.words) <> '' THEN substr(trim(g.words), 1, 30) ELSE substr(t, 1, 30) END AS label FROM px WHERE replace(g.num, ',', '')::DOUBLE > 0),
    dx AS (SELECT doc_id, sec, sub, val, arg_min(label, n) AS label, min(n) AS n FROM fx WHERE n <= 6 GROUP BY ALL)
    SELECT doc_id, sec, sub, val, label, row_number() OVER (PARTITION BY doc_id, sec, sub ORDER BY n) AS place FROM dx QUALIFY place <= 4"""
    ),
    "aligned_tables": """WITH p AS (SELECT p_partkey AS k, p_name AS a, p_size AS b, p_brand AS c, p_type AS d FROM part)
    SELECT k AS doc_id, concat_ws(chr(10), '| name | size | type  x |', '| --- | --- | --- |', '| ' || a || ' | ' || b || ' |  |', '| only |  |  |', '| ' || c || ' | 7 | ' || d || ' |') AS markdown FROM p""",
    "inline_signals": """WITH p AS (SELECT p_partkey AS k, p_name AS a, p_type AS d, (['Warning', 'note', 'KEY RULE', 'Hint', 'Danger'])[p_partkey % 5 + 1] || CASE WHEN p_partkey % 3 = 0 THEN ' - ' ELSE ': ' END AS w FROM part)
    SELECT k AS doc_id, 0 AS part, CASE WHEN k % 2 = 0 AND k % 5 <> 3 THEN a || '.' ELSE a || CASE WHEN k % 2 = 0 THEN '.  ' ELSE ' ' END || w || d || '.' END AS text FROM p
    UNION ALL SELECT k, 1, w || d || '.' FROM p WHERE k % 2 = 0 AND k % 5 <> 3 UNION ALL SELECT k, CASE WHEN k % 2 = 0 AND k % 5 <> 3 THEN 2 ELSE 1 END, 'Important: keep dry. End' FROM p""",
    "page_folios": f"""WITH {_LINES}, m AS (SELECT *, max(line) OVER (PARTITION BY doc_id, page) AS last FROM pl), n AS (SELECT doc_id, page, line, last, CASE WHEN line = last THEN page::VARCHAR ELSE text END AS text, top + CASE WHEN line = last AND page % 2 = 0 THEN 30 ELSE 0 END AS top FROM m),
    a AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM n), s AS (SELECT doc_id, page, list_sort(list(gap) FILTER (gap > 0)) AS gaps FROM a GROUP BY doc_id, page)
    SELECT a.doc_id, a.page, count(*) AS lines, max(line) AS last FROM a JOIN s ON s.doc_id = a.doc_id AND s.page = a.page
    WHERE NOT (line = a.last AND (a.last = 0 OR gap > gaps[len(gaps) // 2 + 1] * 1.6)) GROUP BY a.doc_id, a.page""",
    "column_margins": f"""WITH {_LINES}, x AS (SELECT doc_id, ln, CASE WHEN col >= 4 THEN 1 ELSE 0 END AS col, min(50.0 + col * 60 + CASE WHEN col >= 4 THEN 40 ELSE 0 END + CASE WHEN ln % 5 = 0 THEN 12 ELSE 0 END) AS x0 FROM l GROUP BY doc_id, ln, CASE WHEN col >= 4 THEN 1 ELSE 0 END),
    c AS (SELECT doc_id, col, x0, count(*) AS n FROM x GROUP BY doc_id, col, x0) SELECT doc_id, col, min(x0)::DOUBLE AS margin FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, col) AS most FROM c) WHERE n >= most * 0.2 GROUP BY doc_id, col""",
    "block_html": scored_sql(
        f" SELECT doc_id, seq, {BLOCK_HTML} AS html FROM scored WHERE type <> 'task'"
    ),
    "document_titles": scored_sql(
        """ , h AS (SELECT doc_id, arg_min(content, seq) AS title FROM typed WHERE doc_id % 2 = 1 AND type IN ('heading', 'entity') AND level = 1 GROUP BY doc_id)
    SELECT s_suppkey AS doc_id, coalesce(title, 'The New-Notes Of ' || s_suppkey || '.V2') AS title FROM supplier LEFT JOIN h ON h.doc_id = s_suppkey"""
    ),
    "html_fragments": f"""SELECT p_partkey, '<!--FRAGMENT:{{"css":"' || '.' || lower(p_brand) || '","html":"<p>' || {_E.format(x='p_name')} || '</p>","fa":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || '}}:FRAGMENT-->' AS trailer FROM part""",
}
