"""Queries on imported designs: pages with style rules or inline styles in colours of their own, and coloured runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import imports as D
from foliant.session import table

#: Style rules of one page in four; {n} is the page's n-th colour.
CSS = (
    "body, html { background: #abc url(x); color: {0} } h1{border-bottom: 2px solid {1}; font-family: 'EB Garamond', serif} .entity-card{color:#fff;background-color:{2}} "
    "td{border:1px solid {3}} pre{font-family: Courier Prime} @media print { blockquote { color: #000; COLOR: {0}; background: none } } h1 { margin: 0 }"
)
#: Tags that get inline styles: what is replaced, and by what, in two pages of four; the last one in one of four only.
INLINE = (
    ("<style>p{margin:0}</style>", ""),
    ("<p>", '<p style="color:{0};font-family:Karla, serif">'),
    ("<li>", "<li class=\"Entity row\" style='background: {1}; color: #fff'>"),
    ("<h1>", '<h1 STYLE="color:{2}">'),
    ("<div ", '<div style="background-color:{3};color:#123" '),
)
PLAIN = "<style>p{margin:0}</style>"


def styled_pages(spark, sf_dir):
    """Pages as they are, with rules, and with inline styles, in turn."""
    own = table(spark, sf_dir, "pages").select("page_id", "html", F.md5(F.coalesce("url", F.lit(""))).alias("h"))

    def coloured(text):
        x = F.lit(text)
        for k in range(4):
            x = F.replace(x, F.lit(f"{{{k}}}"), F.concat(F.lit("#"), F.substring("h", 1 + 6 * k, 6)))
        return x

    inline = F.col("html")
    for a, b in INLINE[:-1]:
        inline = F.replace(inline, F.lit(a), coloured(b))
    more = F.replace(inline, F.lit(INLINE[-1][0]), coloured(INLINE[-1][1]))
    kind = F.col("page_id") % 4
    ruled = F.replace("html", F.lit(PLAIN), F.concat(F.lit("<style>"), coloured(CSS), F.lit("</style>")))
    return own.select("page_id", F.when(kind == 1, ruled).when(kind == 2, inline).when(kind == 3, more).otherwise(F.col("html")).alias("html"))


def page_designs(spark, sf_dir):
    return D.as_rows(D.page_designs(styled_pages(spark, sf_dir)), "page_id", "origin")


def style_votes(spark, sf_dir):
    """Counts of every value in every bucket of the pages' inline styles."""
    return D.inline_votes(styled_pages(spark, sf_dir)).groupBy("page_id", "bucket", "value").agg(F.count("*").alias("n"))


def run_designs(spark, sf_dir):
    """Items as runs of an order's text, some coloured, bold or large; orders as what their documents' styles and themes say."""
    pick = lambda k, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    i = table(spark, sf_dir, "lineitem")
    pos = F.col("l_partkey").cast("long") * 100000 + F.col("l_suppkey")
    runs = i.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("par"), pos.alias("pos"), pick(F.col("l_linenumber"), "Heading 2", "Normal", None, "Body").alias("style"), (F.col("l_partkey") % 3 == 0).alias("bold"), (F.col("l_suppkey") % 6 + 10).alias("size"),
        pick(F.col("l_partkey"), "a1b2c3", "#777", "C02020", None, "204080").alias("color"), pick(F.col("l_partkey") + F.col("l_suppkey"), "Lora", "Karla", "").alias("font"), pick(F.col("l_suppkey"), None, "YELLOW (7)", "BRIGHT_GREEN (4)", "GRAY_25 (16)").alias("highlight"),
    )
    k = F.col("o_orderkey")
    said = table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), pick(k, None, "808080", "112299").alias("h1_color"), pick(k, None, "Cinzel").alias("h1_font"), pick(k, None, "111111", "223344").alias("text_color"), pick(k, "Inter", None, "Georgia").alias("text_font"),
        pick(k, None, "4472C4", "7F7F7F").alias("accent1"), pick(k, None, "000000").alias("dark1"), pick(k, "FFFFFF", "FAF0E6", None).alias("light1"), pick(k, None, None, None, "ffeedd").alias("page_color"),
    )
    return D.as_rows(D.run_designs(runs, said), "doc_id")


QUERIES = {f.__name__: f for f in (page_designs, style_votes, run_designs)}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _colored(text: str) -> str:
    x = _q(text)
    for k in range(4):
        x = f"replace({x}, '{{{k}}}', '#' || h[{1 + 6 * k}:{6 + 6 * k}])"
    return x


def _inline(steps) -> str:
    x = "html"
    for a, b in steps:
        x = f"replace({x}, {_q(a)}, {_colored(b)})"
    return x


def _gray(x: str) -> str:
    n = [f"concat('0x', {x}[{a}:{a + 1}])::INT" for a in (2, 4, 6)]
    return f"(greatest({', '.join(n)}) - least({', '.join(n)}) < 18)"


_DEF = "(VALUES " + ",".join(f"({_q(k)}, {_q(v)})" for k, v in D.DEFAULTS.items()) + ") AS d(key, value)"
_BUCKETS = " UNION ALL ".join(
    [
        f"SELECT page_id, pos, CASE WHEN name IN ('h1', 'h2', 'h3', 'strong', 'b') AND NOT {_gray('fg')} THEN 'accent' ELSE 'text' END AS bucket, fg AS value FROM col",
        "SELECT page_id, pos, 'bg', bg FROM col",
        "SELECT page_id, pos, 'font', font FROM col",
        *[f"SELECT page_id, pos, '{k}:{p}', {k} FROM col WHERE name = '{t}'" for t, p in D.VOTED_TAGS.items() for k in ("fg", "bg")],
        *[f"SELECT page_id, pos, '{k}:{p}', {k} FROM col WHERE contains(classes, '{p}')" for p in D.CLASSES for k in ("fg", "bg")],
    ]
)
_SIX = "CASE WHEN length({x}) = 4 THEN '#' || upper(repeat({x}[2], 2) || repeat({x}[3], 2) || repeat({x}[4], 2)) WHEN {x} <> '' THEN upper({x}) END"
_VOTES = rf"""WITH src AS (SELECT page_id, html, md5(coalesce(url, '')) AS h FROM pages), styled AS (SELECT page_id, h, CASE page_id % 4 WHEN 2 THEN {_inline(INLINE[:-1])} ELSE {_inline(INLINE)} END AS html FROM src WHERE page_id % 4 >= 2),
t0 AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script.*?</script>', '', 'gs'), '<[a-zA-Z][^>]*>') AS ts FROM styled), t1 AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM t0),
t2 AS (SELECT page_id, pos, lower(regexp_extract(t, '^<([a-zA-Z0-9]+)', 1)) AS name, lower(regexp_extract(t, 'class="([^"]*)"', 1)) AS classes, regexp_extract(t, '(?i) style=["'']([^"'']*)', 1) AS s FROM t1 WHERE regexp_matches(t, '(?i) style=')),
t3 AS (SELECT *, regexp_extract(s, '(?:^|;)\s*color\s*:\s*(#[0-9a-f]+)', 1) AS c, regexp_extract(s, 'background(?:-color)?\s*:\s*(#[0-9a-f]+)', 1) AS b, nullif(regexp_extract(s, 'font-family:([^,]*)', 1), '') AS font FROM t2),
col AS (SELECT page_id, pos, name, classes, font, {_SIX.format(x='c')} AS fg, {_SIX.format(x='b')} AS bg FROM t3),
cast0 AS (SELECT * FROM ({_BUCKETS}) WHERE value IS NOT NULL), vt AS (SELECT page_id, bucket, value, count(*) AS n, min(pos) AS first FROM cast0 GROUP BY ALL)"""


def _own(n: int) -> str:
    return f"upper('#' || h[{1 + 6 * n}:{6 + 6 * n}])"


_RULED = f"""ru AS (SELECT page_id, {_own(0)} AS c0, {_own(1)} AS c1, {_own(2)} AS c2, {_own(3)} AS c3 FROM src WHERE page_id % 4 = 1),
ruo AS (SELECT page_id, unnest([{{'key': 'color_bg', 'value': '#AABBCC'}}, {{'key': 'color_text', 'value': c0}}, {{'key': 'font_heading', 'value': 'EB Garamond'}}, {{'key': 'color_accent', 'value': CASE WHEN NOT {_gray('c1')} THEN c1 END}},
  {{'key': 'h1.fg', 'value': CASE WHEN NOT {_gray('c1')} THEN c1 END}}, {{'key': 'entity.fg', 'value': '#FFFFFF'}}, {{'key': 'entity.bg', 'value': c2}}, {{'key': 'color_entity', 'value': CASE WHEN {_gray('c2')} THEN '#FFFFFF' ELSE c2 END}},
  {{'key': 'color_border', 'value': c3}}, {{'key': 'font_mono', 'value': 'Courier Prime'}}, {{'key': 'quote.fg', 'value': c0}}], recursive := true) FROM ru)"""
_PICK = lambda k, *v: f"([{', '.join('NULL' if x is None else _q(x) for x in v)}])[({k}) % {len(v)} + 1]"
_RUNS = f"""WITH r0 AS (SELECT l_orderkey AS doc_id, l_linenumber AS par, l_partkey * 100000 + l_suppkey AS pos, l_partkey % 3 = 0 AND l_suppkey % 6 + 10 >= 14 AS large, l_linenumber % 4 = 0 AS titled,
  {_PICK('l_partkey', '#A1B2C3', '#777777', '#C02020', None, '#204080')} AS color, {_PICK('l_partkey + l_suppkey', 'Lora', 'Karla', None)} AS font, {_PICK('l_suppkey', None, 'YELLOW', 'BRIGHT_GREEN', 'GRAY')} AS mark FROM lineitem),
r1 AS (SELECT *, bool_or(large OR titled) OVER (PARTITION BY doc_id, par) AS head FROM r0),
r2 AS (SELECT doc_id, par, pos, CASE WHEN head THEN 'accent' ELSE 'text' END AS bucket, color AS value FROM r1 WHERE NOT head OR color <> '#777777' UNION ALL SELECT doc_id, par, pos, CASE WHEN head THEN 'font_h' ELSE 'font_b' END, font FROM r1 UNION ALL SELECT doc_id, par, pos, 'mark', mark FROM r1),
r3 AS (SELECT doc_id, bucket, value, count(*) AS n, min((par, pos)) AS first FROM r2 WHERE value IS NOT NULL GROUP BY ALL), r4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY n DESC, first) AS k FROM r3),
w AS (SELECT doc_id, max(value) FILTER (bucket = 'accent') AS accent, max(value) FILTER (bucket = 'text') AS txt, max(value) FILTER (bucket = 'font_h') AS fh, max(value) FILTER (bucket = 'font_b') AS fb, max(value) FILTER (bucket = 'mark') AS mark FROM r4 WHERE k = 1 GROUP BY doc_id),
al AS (SELECT DISTINCT o_orderkey AS doc_id FROM orders UNION SELECT DISTINCT l_orderkey FROM lineitem), j AS (SELECT al.doc_id, accent, txt, fh, fb, mark, o_orderkey AS k FROM al LEFT JOIN w ON w.doc_id = al.doc_id LEFT JOIN orders ON o_orderkey = al.doc_id),
a AS (SELECT doc_id, CASE WHEN coalesce(accent, CASE WHEN k % 3 = 2 THEN '#112299' END) IS NULL AND k % 3 = 1 THEN '#4472C4' ELSE coalesce(accent, CASE WHEN k % 3 = 2 THEN '#112299' END) END AS accent,
  coalesce(txt, {_PICK('k', None, '#111111', '#223344')}) AS txt, k % 2 = 1 AS dark, coalesce(fh, {_PICK('k', None, 'Cinzel')}) AS fh, coalesce(fb, {_PICK('k', 'Inter', None, 'Georgia')}) AS fb, CASE mark WHEN 'YELLOW' THEN '#FFF3A0' WHEN 'BRIGHT_GREEN' THEN '#D4F7D4' END AS mark,
  coalesce({_PICK('k', None, None, None, '#FFEEDD')}, {_PICK('k', '#FFFFFF', '#FAF0E6', None)}) AS paper FROM j),
o AS (SELECT doc_id, unnest([{{'key': 'color_accent', 'value': accent}}, {{'key': 'h1.fg', 'value': accent}}, {{'key': 'color_text', 'value': CASE WHEN dark AND coalesce(txt, '#111111') = '#111111' THEN '#000000' ELSE txt END}}, {{'key': 'font_heading', 'value': fh}},
  {{'key': 'font_body', 'value': fb}}, {{'key': 'color_bg', 'value': paper}}, {{'key': 'callout.bg', 'value': mark}}], recursive := true) FROM a)"""
SQL = {
    "style_votes": _VOTES + " SELECT page_id, bucket, value, n FROM vt",
    "page_designs": _VOTES
    + f""", wn AS (SELECT *, row_number() OVER (PARTITION BY page_id, bucket ORDER BY n DESC, first) AS k FROM vt), win AS (SELECT page_id, bucket, value FROM wn WHERE k = 1), {_RULED},
    pr AS (SELECT f.page_id, replace(f.bucket, 'fg:', 'color_') AS key, CASE WHEN {_gray('f.value')} AND NOT {_gray('g.value')} THEN g.value ELSE f.value END AS value FROM win f LEFT JOIN win g ON g.page_id = f.page_id AND g.bucket = replace(f.bucket, 'fg:', 'bg:') WHERE f.bucket IN ('fg:entity', 'fg:callout', 'fg:warning')),
    ino AS (SELECT page_id, unnest(CASE bucket WHEN 'accent' THEN ['color_accent'] WHEN 'text' THEN ['color_text', 'body.fg'] WHEN 'bg' THEN ['color_bg'] WHEN 'font' THEN ['font_body', 'font_heading'] ELSE [regexp_replace(bucket, '(..):(.*)', '\\2.\\1')] END) AS key, value FROM win UNION ALL SELECT * FROM pr),
    o AS (SELECT * FROM ino UNION ALL SELECT * FROM ruo WHERE value IS NOT NULL), org AS (SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'rules' WHEN page_id IN (SELECT page_id FROM win) THEN 'inline' ELSE 'none' END AS origin FROM pages)
    SELECT org.page_id, origin, d.key, coalesce(o.value, d.value) AS value FROM org CROSS JOIN {_DEF} LEFT JOIN o ON o.page_id = org.page_id AND o.key = d.key
    UNION ALL SELECT page_id, origin, key, value FROM o JOIN org USING (page_id) WHERE contains(key, '.')""",
    "run_designs": _RUNS + f" SELECT a.doc_id, d.key, coalesce(o.value, d.value) AS value FROM a CROSS JOIN {_DEF} LEFT JOIN o ON o.doc_id = a.doc_id AND o.key = d.key UNION ALL SELECT doc_id, key, value FROM o WHERE contains(key, '.') AND value IS NOT NULL",
}
