"""Queries on reading order: gutters, columns, running edges and Markdown of positioned words.

The words are those of documents, set on pages of 26 rows in one column or two, with a running
head, a folio, headings across both columns, indented rows, parted words and large initials. The
SQL knows how the pages are set: rows lie 14 points apart, and no line of one word that goes parts a word itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import layout as Y
from foliant.operators import reading as R
from foliant.plans.design_queries import page_texts

PER_ROW, PER_PAGE = 8, 208
FIELDS = (*Y.WORD, "page_width")


def _places(single: bool, odd: bool) -> list[tuple]:
    """Top, x0, width and size of every word of a full page; only these depend on the columns and on the page's number."""
    out = []
    for k in range(PER_PAGE):
        r, c = divmod(k, PER_ROW)
        title = odd and r == 5
        x = 50 + c * 62 if single else 50 + c * 65 if title else 50 + c % 4 * 60 + (290 if c >= 4 else 0)
        out.append((60.0 + r * 14 + c % 2, float(x + (12 if r % 6 == 0 and not title else 0)), 60.0 if title else 50.0, 14.0 if title else 10.0))
    return out


def page_words(spark, sf_dir):
    """Pages of positioned words of every document; every third document has one column."""
    kinds = [_places(single, odd) for single in (False, True) for odd in (False, True)]
    kind = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0) + F.col("page") % 2
    given = {n: F.array(*[F.lit([f(x) for x in places]) for places in kinds]) for n, f in (("top", lambda x: x[0]), ("x0", lambda x: x[1]), ("x1", lambda x: x[1] + x[2]), ("size", lambda x: x[3]))}
    parted = [(k % 8 == 7 and k // 8 % 5 == 2) or (k % 8 == 3 and k // 8 % 7 == 1) for k in range(PER_PAGE)]
    page = F.col("page")

    def word(w, i):
        columns = {c: F.get(F.get(x, kind), i) for c, x in given.items()} | {
            "page_width": F.lit(612.0),
            "word_seq": (page * PER_PAGE + i) * 8,
            "text": F.when(F.get(F.lit(parted), i), F.concat(w, F.lit("-"))).otherwise(w),
        }
        return F.struct(*[columns[c].alias(c) for c in FIELDS])

    def extra(offset, text, x, wide, top, size):
        values = {"page_width": F.lit(612.0), "top": F.lit(top), "x0": F.lit(x), "word_seq": page * PER_PAGE * 8 + offset, "x1": F.lit(x + wide), "size": F.lit(size), "text": text}
        return F.struct(*[values[c].alias(c) for c in FIELDS])

    always = F.array(
        extra(1, F.lit("Running"), 50.0, 40.0, 30.0, 10.0), extra(2, F.concat(F.lit("Head"), F.col("doc_id").cast("string")), 95.0, 40.0, 30.0, 10.0), extra(4, (page + 1).cast("string"), 300.0, 12.0, 464.0, 10.0)
    )
    initial = F.array(extra(3, F.lit("T"), 50.0, 20.0, 44.0, 30.0))
    every = F.concat(F.flatten(F.transform("texts", lambda text: F.transform(text, word))), F.when(page % 3 == 1, F.concat(always, initial)).otherwise(always))
    return page_texts(spark, sf_dir, PER_PAGE).select("doc_id", "page", every.alias("words"))


def page_columns(spark, sf_dir):
    own = R.gutters(page_words(spark, sf_dir))
    return own.select("doc_id", "page", F.round("left", 6).alias("left_edge"), F.round("right", 6).alias("right_edge"))


def reading_order(spark, sf_dir):
    own = R.assembled(R.with_gutters(R.paged(page_words(spark, sf_dir))))
    return own.select("doc_id", "page", "line", "col", R.line_text(F.col("words")).alias("text"))


def page_edges(spark, sf_dir):
    return R.edge_texts(page_words(spark, sf_dir))


def reading_lines(spark, sf_dir):
    own = R.body_lines(R.paged(page_words(spark, sf_dir)))
    return own.select("doc_id", "page", "line", "col", R.line_text(F.col("words")).alias("text"))


def reading_markdown(spark, sf_dir):
    return R.markdown(page_words(spark, sf_dir))


QUERIES = {f.__name__: f for f in (page_columns, reading_order, page_edges, reading_lines, reading_markdown)}

WS = r"'[ \t\n\x0B\f\r]+'"
_WORDS = f"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {WS}), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(0, len(ws) - 1)) AS i FROM d),
p AS (SELECT *, i // 208 AS page, i % 208 // 8 AS r, i % 8 AS c, (i // 208) % 2 = 1 AND i % 208 // 8 = 5 AS title FROM i),
b AS (SELECT doc_id, page, i * 8 AS seq, CASE WHEN (c = 7 AND r % 5 = 2) OR (c = 3 AND r % 7 = 1) THEN w || '-' ELSE w END AS text,
 (CASE WHEN doc_id % 3 = 0 THEN 50 + c * 62 WHEN title THEN 50 + c * 65 WHEN c >= 4 THEN 340 + (c - 4) * 60 ELSE 50 + c * 60 END + CASE WHEN r % 6 = 0 AND NOT title THEN 12 ELSE 0 END)::DOUBLE AS x0,
 CASE WHEN title THEN 60 ELSE 50 END AS wide, (60 + r * 14 + c % 2)::DOUBLE AS top, CASE WHEN title THEN 14.0 ELSE 10.0 END AS size FROM p),
pg AS (SELECT DISTINCT doc_id, page FROM p),
words AS (SELECT * FROM b UNION ALL SELECT doc_id, page, page * 1664 + 1, 'Running', 50, 40, 30, 10 FROM pg UNION ALL SELECT doc_id, page, page * 1664 + 2, 'Head' || doc_id, 95, 40, 30, 10 FROM pg
 UNION ALL SELECT doc_id, page, page * 1664 + 3, 'T', 50, 20, 44, 30 FROM pg WHERE page % 3 = 1 UNION ALL SELECT doc_id, page, page * 1664 + 4, (page + 1)::VARCHAR, 300, 12, 464, 10 FROM pg),
v AS (SELECT *, floor(top / 14)::INT AS slot, x0 + wide AS x1, x0 + wide / 2 AS mid FROM words)"""
_BANDS = f"""{_WORDS},
touch AS (SELECT DISTINCT doc_id, page, slot, unnest(generate_series(floor(x0 / 3.06)::INT, floor(x1 / 3.06)::INT)) AS bin FROM v),
rn AS (SELECT doc_id, page, count(DISTINCT slot) AS n FROM v GROUP BY ALL HAVING count(DISTINCT slot) >= 12),
cover AS (SELECT doc_id, page, bin, count(*) AS k FROM touch GROUP BY ALL),
grid AS (SELECT doc_id, page, n, unnest(generate_series(50, 149)) AS bin FROM rn),
free AS (SELECT g.doc_id, g.page, g.bin, g.bin - row_number() OVER (PARTITION BY g.doc_id, g.page ORDER BY g.bin) AS isl FROM grid g LEFT JOIN cover c USING (doc_id, page, bin) WHERE coalesce(k, 0) / n <= 0.05),
band AS (SELECT doc_id, page, min(bin) * 3.06 AS lo, (max(bin) + 1) * 3.06 AS hi, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(bin)) AS rank FROM free GROUP BY doc_id, page, isl HAVING count(*) * 3.06 >= 10),
gut AS (SELECT b.doc_id, b.page, any_value(lo) AS lo, any_value(hi) AS hi FROM band b JOIN v USING (doc_id, page) WHERE rank = 1 GROUP BY b.doc_id, b.page HAVING avg((mid < (lo + hi) / 2)::INT) BETWEEN 0.15 AND 0.85)"""
_LINES = f"""{_BANDS},
a AS (SELECT v.*, lo, hi, coalesce(bool_or(x0 < hi AND x1 > lo) OVER (PARTITION BY v.doc_id, v.page, slot), false) AS wide_row FROM v LEFT JOIN gut USING (doc_id, page)),
l0 AS (SELECT doc_id, page, slot, CASE WHEN lo IS NULL OR wide_row OR mid < (lo + hi) / 2 THEN 0 ELSE 1 END AS col, bool_or(wide_row) AS wide_row, list(text ORDER BY x0, top, seq) AS ws, list(size ORDER BY x0, top, seq) AS sizes, min(x0) AS x0, arg_min(top, x0) AS top FROM a GROUP BY ALL),
l1 AS (SELECT *, coalesce(sum(wide_row::INT) OVER (PARTITION BY doc_id, page ORDER BY slot, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM l0),
l AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY part, CASE WHEN wide_row THEN 2 ELSE col END, slot) - 1 AS line, col, x0, top, ws, sizes[1] AS size FROM l1)"""
_EDGES = """e0 AS (SELECT doc_id, page, slot, min(slot) OVER w AS s0, max(slot) OVER w AS s1, text, x0, top, seq FROM v WINDOW w AS (PARTITION BY doc_id, page)),
e1 AS (SELECT doc_id, page, slot = s0 AS first, slot = s1 AS last, string_agg(text, ' ' ORDER BY x0, top, seq) AS text FROM e0 WHERE slot IN (s0, s1) GROUP BY ALL),
e2 AS (SELECT doc_id, page, 'head' AS edge, text FROM e1 WHERE first UNION ALL SELECT doc_id, page, 'foot', text FROM e1 WHERE last),
e3 AS (SELECT doc_id, edge, text, count(*) AS n, min(page) AS since FROM e2 GROUP BY ALL),
e4 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, edge) AS pages, row_number() OVER (PARTITION BY doc_id, edge ORDER BY n DESC, since) AS rank FROM e3),
edges AS (SELECT doc_id, max(text) FILTER (edge = 'head') AS head, max(text) FILTER (edge = 'foot') AS foot FROM e4 WHERE rank = 1 AND pages >= 4 AND n >= greatest(3, pages * 0.4) GROUP BY doc_id)"""
_BODY = f"""{_LINES}, {_EDGES},
k0 AS (SELECT l.*, array_to_string(ws, ' ') AS text, max(line) OVER (PARTITION BY l.doc_id, l.page) AS last FROM l),
k1 AS (SELECT k0.* EXCLUDE (last) FROM k0 LEFT JOIN edges USING (doc_id) WHERE NOT coalesce(line = 0 AND text = head, false) AND NOT coalesce(line = last AND text = foot, false)),
k2 AS (SELECT *, top - lag(top) OVER w AS gap, line = max(line) OVER (PARTITION BY doc_id, page) AS last, count(*) OVER (PARTITION BY doc_id, page) AS n FROM k1 WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
k3 AS (SELECT doc_id, page, list(gap ORDER BY gap) AS gaps FROM k2 WHERE gap > 0 GROUP BY ALL),
k4 AS (SELECT k2.* FROM k2 LEFT JOIN k3 USING (doc_id, page) WHERE NOT coalesce(last AND regexp_matches(text, '^[0-9]+$') AND (n = 1 OR gaps IS NULL OR gap > gaps[len(gaps) // 2 + 1] * 1.6), false)),
h0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS pos, regexp_matches(ws[-1], '[^-]-$') AND length(ws[-1]) > 2 AS parts FROM k4),
h1 AS (SELECT *, coalesce(lag(parts) OVER (PARTITION BY doc_id ORDER BY pos), false) AND regexp_matches(ws[1], '^\\p{{Ll}}') AS gives FROM h0),
h2 AS (SELECT *, coalesce(lead(gives) OVER o, false) AS takes, lead(ws[1]) OVER o AS next1, lead(gives AND len(ws) = 1) OVER o AS goes1 FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
h3 AS (SELECT * REPLACE (list_concat(CASE WHEN gives THEN ws[2:-2] ELSE ws[1:-2] END, [CASE WHEN takes THEN left(ws[-1], length(ws[-1]) - 1) || next1 ELSE ws[-1] END]) AS ws) FROM h2 WHERE NOT (gives AND len(ws) = 1)),
bs AS (SELECT doc_id, arg_max(size, n * 1000 - size) AS body FROM (SELECT doc_id, size, sum(length(text)) AS n FROM v GROUP BY ALL) GROUP BY doc_id),
c0 AS (SELECT *, len(ws) = 1 AND size >= body * 1.6 AND regexp_matches(ws[1], '^\\p{{L}}{{1,2}}$') AND lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS cap FROM h3 JOIN bs USING (doc_id)),
c1 AS (SELECT *, CASE WHEN lag(cap) OVER o THEN lag(ws[1]) OVER o ELSE '' END AS carry FROM c0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c2 AS (SELECT * REPLACE (list_concat([carry || ws[1]], ws[2:]) AS ws) FROM c1 WHERE NOT cap)"""
_MARKDOWN = f"""{_BODY},
m0 AS (SELECT doc_id, col, round_even(x0, 0) AS x, count(*) AS n FROM c2 GROUP BY ALL),
m1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col ORDER BY n DESC, x) AS rank, max(n) OVER (PARTITION BY doc_id, col) AS most FROM m0),
m2 AS (SELECT doc_id, col, min(x) AS margin FROM m1 WHERE rank <= 3 AND n >= most * 0.2 GROUP BY ALL),
s0 AS (SELECT *, len(ws) <= 4 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '^[A-Z][A-Z'']+$'))) = 0 AS label FROM c2),
s1 AS (SELECT doc_id, count(*) >= 20 AND count(*) FILTER (label) >= greatest(15, count(*) * 0.12) AS script FROM s0 GROUP BY doc_id),
r0 AS (SELECT s0.*, size >= body * 1.3 AND (length(ws[1]) > 2 OR len(ws) > 1) AS heading, (script AND label) OR x0 > margin + 8 AS starts FROM s0 JOIN s1 USING (doc_id) JOIN m2 USING (doc_id, col)),
r1 AS (SELECT *, coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY pos) <> heading, true) OR (NOT heading AND starts) AS new FROM r0),
r2 AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM r1),
r3 AS (SELECT doc_id, part, heading, string_agg(array_to_string(ws, ' '), ' ' ORDER BY pos) AS text FROM r2 GROUP BY ALL)"""

SQL = {
    "page_columns": f"WITH {_BANDS} SELECT doc_id, page, round(lo::DOUBLE, 6) AS left_edge, round(hi::DOUBLE, 6) AS right_edge FROM gut",
    "reading_order": f"WITH {_LINES} SELECT doc_id, page, line, col, array_to_string(ws, ' ') AS text FROM l",
    "page_edges": f"WITH {_WORDS}, {_EDGES} SELECT * FROM edges",
    "reading_lines": f"WITH {_BODY} SELECT doc_id, page, line, col, array_to_string(ws, ' ') AS text FROM c2",
    "reading_markdown": f"WITH {_MARKDOWN} SELECT doc_id, string_agg(CASE WHEN heading THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY part) AS markdown FROM r3 GROUP BY doc_id",
}
