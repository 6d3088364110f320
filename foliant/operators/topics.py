"""Topics, slides and summary tables of scored blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import html_escaped, inline_html, strip, title_case
from foliant.operators import images
from foliant.operators.details import entity_icon

# fixed values: the round of slide layouts
LAYOUTS = ("split_right", "full_header", "two_column", "card_grid", "split_left", "stat_spotlight", "timeline_flow", "quote_full")


def topics(blocks: DataFrame) -> DataFrame:
    """(doc_id, sec, title, n_blocks, importance, type and counts): a topic for each section with content."""
    body = ~((F.col("type") == "heading"))
    title = F.max(F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("content")))
    counts = [F.count_if(F.col("type") == t).alias(n) for t, n in (("entity", "entities"), ("timeline_event", "timelines"), ("table", "tables"), ("warning", "warnings"), ("quote", "quotes"), ("task", "tasks"), ("paragraph", "paragraphs"))]
    strong = F.count_if((F.col("type") == "warning") & (F.col("importance") >= 50)).alias("strong_warnings")
    first_quote = F.min_by(F.length("content"), F.when((F.col("type") == "quote") & (F.col("importance") >= 40), F.col("seq"))).alias("quote_size")
    own = blocks.groupBy("doc_id", "sec").agg(strong, first_quote, title.alias("title"), F.count_if(body).alias("n_blocks"), F.round(F.avg(F.when(body, F.col("importance"))), 4).alias("importance"), *counts)
    kind = (
        F.when(F.col("entities") >= 3, "entities").when(F.col("timelines") >= 3, "timeline").when(F.col("tables") >= 1, "data").when(F.col("warnings") >= 1, "warning").when(F.col("quotes") >= 1, "quote").otherwise("general")
    )
    return own.where("n_blocks > 0").withColumn("type", kind)


def slide_plan(found: DataFrame) -> DataFrame:
    """(doc_id, sec, place, slide, layout): the slides that a topic's content calls for, in detailed mode."""
    rules = [
        (F.lit(True), "main"), ((F.col("type") == "entities") & (F.col("entities") >= 3), "entities"), (F.col("timelines") >= 3, "timeline"), (F.col("tables") >= 1, "data"),
        (F.col("strong_warnings") >= 1, "warning"), (F.col("quote_size") > 30, "quote"), (F.col("paragraphs") >= 2, "evidence"),
    ]
    wanted = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    own = found.select("doc_id", "sec", F.posexplode(wanted).alias("place", "slide"))
    w = Window.partitionBy("doc_id").orderBy("sec", "place")
    layout = F.element_at(F.array(*map(F.lit, LAYOUTS)), F.pmod(F.row_number().over(w) - 1, F.lit(len(LAYOUTS))) + 1)
    return own.withColumn("layout", layout)


def top_of_type(blocks: DataFrame, kinds: tuple[str, ...], k: int, per: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k most important blocks of some types, document order among equals."""
    w = Window.partitionBy(*per).orderBy(F.desc("importance"), "seq")
    return blocks.where(F.col("type").isin(*kinds)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def lead(blocks: DataFrame) -> DataFrame:
    """(doc_id, lead): the two best distinct paragraphs or callouts, shortened and joined."""
    best = top_of_type(blocks, ("paragraph", "callout"), 3)
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda y: F.substring(y["content"], 1, 200)))
    return best.groupBy("doc_id").agg(F.substring(F.array_join(F.slice(texts, 1, 2), " "), 1, 380).alias("lead"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, row, col, cell) of every table block."""
    rows = blocks.where("type = 'table'").select("doc_id", "seq", F.posexplode(F.split("content", "\n")).alias("row", "x"))
    cells = rows.select("doc_id", "seq", "row", F.posexplode(F.split(F.regexp_replace("x", r"^\|+|\|+$", ""), r"\|")).alias("col", "cell"))
    return cells.withColumn("cell", strip(F.col("cell")))


def numeric_series(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, row, label, value): the first table of each document with three numbers in its second column."""
    cells = table_cells(blocks).where((F.col("row") >= 1) & (F.col("row") <= 8))
    value = F.expr("try_cast(nullif(regexp_replace(cell, '[^0-9.\\\\-]', ''), '') AS double)")
    pairs = cells.groupBy("doc_id", "seq", "row").agg(F.max(F.when(F.col("col") == 0, F.substring("cell", 1, 20))).alias("label"), F.max(F.when(F.col("col") == 1, value)).alias("value")).where("value IS NOT NULL")
    enough = pairs.groupBy("doc_id", "seq").agg(F.count("*").alias("n")).where("n >= 3").groupBy("doc_id").agg(F.min("seq").alias("seq"))
    return pairs.join(enough, ["doc_id", "seq"], "left_semi").select("doc_id", "seq", "row", "label", "value")


def stats(blocks: DataFrame) -> DataFrame:
    """(doc_id, val, first_seq): up to four distinct numbers with their units in prose, in order of their first place."""
    text = blocks.where(F.col("type").isin("paragraph", "list", "callout"))
    pattern = r"(?:^|[^0-9A-Za-z_.,])(\d[\d,]*(?:\.\d+)?%?)"
    own = text.select("doc_id", "seq", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("pos", "val"))
    own = own.withColumn("val", F.regexp_replace("val", ",+$", "")).where(F.expr("try_cast(regexp_replace(val, '[,%]', '') AS double)") > 0)
    first = own.groupBy("doc_id", "val").agg(F.min(F.struct("seq", "pos")).alias("at"))
    w = Window.partitionBy("doc_id").orderBy("at")
    return first.withColumn("place", F.row_number().over(w)).where("place <= 4").select("doc_id", "val", F.col("at.seq").alias("first_seq"), "place")


def bullets(blocks: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, sec, place, bullet): the first k of callouts, list items, tasks, definitions, relationships and paragraphs, each with its own limit."""
    item = F.when(F.col("type") == "list", F.split("content", "\n")).otherwise(F.array("content"))
    order: Column = F.lit(None)
    limits: Column = F.lit(0)
    for p, (t, n) in enumerate((("callout", 2), ("list", 5), ("task", 2), ("definition", 2), ("relationship", 2), ("paragraph", 2))):
        order = F.when(F.col("type") == t, p).otherwise(order)
        limits = F.when(F.col("type") == t, n).otherwise(limits)
    own = blocks.withColumns({"prio": order, "most": limits}).where("prio IS NOT NULL").select("doc_id", "sec", "seq", "prio", "most", F.posexplode(item).alias("pos", "bullet"))
    inner = Window.partitionBy("doc_id", "sec", "prio").orderBy("seq", "pos")
    own = own.withColumn("own", F.row_number().over(inner)).where("own <= most")
    outer = Window.partitionBy("doc_id", "sec").orderBy("prio", "seq", "pos")
    return own.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= k).select("doc_id", "sec", "place", F.substring("bullet", 1, 130).alias("bullet"))


def field_labels(blocks: DataFrame) -> DataFrame:
    """(doc_id, label, n): capital labels that start at least two blocks."""
    label = F.regexp_extract("content", r"^([A-Z][A-Z /'-]{2,28})\s[A-Z][a-z]", 1)
    own = blocks.where(F.col("type").isin("paragraph", "entity")).select("doc_id", label.alias("label")).where("label <> '' AND (length(label) >= 5 OR label LIKE '% %')")
    return own.groupBy("doc_id", "label").agg(F.count("*").alias("n")).where("n >= 2")


def _wrapped(open_tag: str | Column, x: Column, close_tag: str) -> Column:
    return F.concat(F.lit(open_tag) if isinstance(open_tag, str) else open_tag, x, F.lit(close_tag))


def _classed(start: str, importance: Column, end: str) -> Column:
    return F.concat(F.lit(start), importance, F.lit(end))


def table_html(raw: Column) -> Column:
    """A pipe table as HTML: the first row is its head; blank rows do not count, a text without rows is empty."""
    rows = F.filter(F.split(strip(raw), r"\r\n|\n|\r"), lambda r: strip(r) != "")

    def row(r: Column, k: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), lambda c: html_escaped(strip(c)))
        head = F.concat(F.lit("<thead><tr><th>"), F.array_join(cells, "</th><th>"), F.lit("</th></tr></thead><tbody>"))
        return F.when(k == 0, head).otherwise(F.concat(F.lit("<tr><td>"), F.array_join(cells, "</td><td>"), F.lit("</td></tr>")))

    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>\n"), F.array_join(F.transform(rows, row), "\n"), F.lit("\n</tbody></table>"))).otherwise("")


def task_row(text: Column, done: Column) -> Column:
    """A task's box and text."""
    box = F.concat(F.lit('<label class="task-row '), F.when(done, "checked").otherwise(""), F.lit('"><input type="checkbox" disabled'), F.when(done, " checked").otherwise(""), F.lit("><span>"))
    return F.concat(box, inline_html(text), F.lit("</span></label>"))


def block_html(blocks: DataFrame) -> DataFrame:
    """blocks (type, level, content, importance, src, caption) with ``html``, each by the template of its type.

    An image's content is its alternative text. A task shows the tree of a column ``task_html``;
    without one it is a box of its own, open unless a column ``checked`` says otherwise. Code names the
    language of a column ``language``. Unknown types become paragraphs.
    """
    c = inline_html(F.col("content"))
    strong = F.when(F.col("importance") >= 70, "importance-high").when(F.col("importance") >= 40, "importance-med").otherwise("")
    level = F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(6)).cast("string")
    items = F.transform(F.filter(F.split("content", "\n"), lambda i: strip(i) != ""), lambda i: _wrapped("<li>", inline_html(strip(i)), "</li>"))
    done = F.coalesce(F.col("checked"), F.lit(False)) if "checked" in blocks.columns else F.lit(False)
    task = task_row(F.col("content"), done)
    if "task_html" in blocks.columns:
        task = F.coalesce("task_html", task)
    language = F.coalesce("language", F.lit("")) if "language" in blocks.columns else F.lit("")
    templates = {
        "heading": F.concat(F.lit("<h"), level, F.lit(">"), c, F.lit("</h"), level, F.lit(">")),
        "entity": _wrapped(_classed('<div class="entity-card entity ', strong, '"><div class="entity-name">'), F.concat(entity_icon(F.col("content")), F.lit(" "), c), "</div></div>"),
        "callout": _wrapped(_classed('<div class="callout ', strong, '">'), c, "</div>"),
        "warning": _wrapped(_classed('<div class="warning ', strong, '">'), c, "</div>"),
        "timeline_event": _wrapped('<div class="timeline-event timeline">', c, "</div>"),
        "task": _wrapped(_classed('<div class="task-item ', strong, '">'), task, "</div>"),
        "relationship": _wrapped('<p class="relationship">', c, "</p>"),
        "definition": _wrapped('<div class="definition">', c, "</div>"),
        "quote": _wrapped("<blockquote>", c, "</blockquote>"),
        "code": _wrapped(_classed('<pre><code class="language-', language, '">'), html_escaped(F.col("content")), "</code></pre>"),
        "list": _wrapped("<ul>", F.array_join(items, ""), "</ul>"),
        "table": table_html(F.col("content")),
        "reference": _wrapped('<p class="reference">↗ ', c, "</p>"),
        "divider": F.lit("<hr>"),
        "image": F.col("_image.figure"),
    }
    html: Column = _wrapped(_classed('<p class="', strong, '">'), c, "</p>")
    for kind, template in templates.items():
        html = F.when(F.col("type") == kind, template).otherwise(html)
    figures = images.resolved(blocks.select("*", F.struct("content", "caption").alias("_own")).withColumns({"alt": F.col("content"), "content": F.lit("")}))
    own = figures.withColumn("_image", F.struct("figure")).withColumns({"content": F.col("_own.content")})
    return own.withColumn("html", html).withColumn("caption", F.col("_own.caption")).drop("_image", "_own", "alt", "size_class", "figure")


def document_titles(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading or entity of level 1; else the file's name without its ending in title case."""
    first = blocks.where(F.col("type").isin("heading", "entity") & (F.col("level") == 1)).groupBy("doc_id").agg(F.min_by("content", "seq").alias("title"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    return files.join(first, "doc_id", "left").select("doc_id", F.coalesce("title", title_case(F.replace(stem, F.lit("_"), F.lit(" ")))).alias("title"))
