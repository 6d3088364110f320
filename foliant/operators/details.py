"""Smaller projections of blocks: splits, icons, chart specs, seeds, style rules and raw text to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.color import seed_int
from foliant.functions.text import named, strip


def split_once(x: Column, sep: str) -> tuple[Column, Column]:
    """Before and after the first separator; all and null without one."""
    at = F.instr(x, sep)
    return F.when(at > 0, strip(F.substring_index(x, sep, 1))).otherwise(x), F.when(at > 0, strip(F.substr(x, at + len(sep))))


def timeline_parts(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, year, event) of timeline blocks."""
    year, event = split_once(F.col("content"), ":")
    return blocks.where("type = 'timeline_event'").select("doc_id", "seq", year.alias("year"), event.alias("event"))


def definition_parts(blocks: DataFrame) -> DataFrame:
    term, meaning = split_once(F.col("content"), ":")
    return blocks.where("type = 'definition'").select("doc_id", "seq", term.alias("term"), meaning.alias("meaning"))


def quote_parts(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, quote, author): split at the last spaced dash."""
    c = F.col("content")
    has = F.contains(c, F.lit(" - "))
    author = F.when(has, strip(F.substring_index(c, " - ", -1)))
    quote = F.when(has, strip(F.substr(c, F.lit(1), F.length(c) - F.length(F.substring_index(c, " - ", -1)) - 3))).otherwise(c)
    return blocks.where("type = 'quote'").select("doc_id", "seq", quote.alias("quote"), author.alias("author"))


# fixed values: parts of names and the icons that they stand for, first match first
ENTITY_ICONS = (
    ("♔", ("king", "queen", "prince", "princess", "lord", "duke", "earl")),
    ("🏰", ("city", "town", "village", "kingdom", "empire", "palace", "castle")),
    ("🗺", ("mountain", "river", "forest", "sea", "ocean", "plain")),
    ("⚔", ("guild", "order", "faction", "clan", "tribe", "house")),
)
OTHER_ICON = "◆"


def entity_icon(name: Column) -> Column:
    icon: Column = F.lit(OTHER_ICON)
    for mark, parts in reversed(ENTITY_ICONS):
        icon = F.when(F.lower(name).rlike("|".join(parts)), mark).otherwise(icon)
    return icon


def entity_icons(blocks: DataFrame) -> DataFrame:
    return blocks.where("type = 'entity'").select("doc_id", "seq", entity_icon(F.col("content")).alias("icon"))


def chart_specs(series: DataFrame) -> DataFrame:
    """(doc_id, seq, points, kind, total): a pie for up to six points, else bars."""
    own = series.groupBy("doc_id", "seq").agg(F.count("*").alias("points"), F.sum("value").alias("total"))
    return own.withColumn("kind", F.when(F.col("points") <= 6, "pie").otherwise("bar"))


def visual_choices(sections: DataFrame) -> DataFrame:
    """(doc_id, sec, painter, seed) of the procedural picture of each titled section."""
    return sections.where("title IS NOT NULL").select("doc_id", "sec", F.pmod(F.col("sec"), F.lit(6)).alias("painter"), seed_int(F.col("title")).alias("seed"))


def css_rules(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, selector, prop, value): rules of style elements; the last declaration of a property wins."""
    style = F.explode(F.regexp_extract_all(html, F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1))).alias("css")
    rules = pages.select("page_id", style).select("page_id", F.posexplode(F.regexp_extract_all("css", F.lit(r"[^{}]+\{[^{}]*\}"), F.lit(0))).alias("at", "rule"))
    own = rules.select("page_id", "at", strip(F.substring_index("rule", "{", 1)).alias("selector"), F.posexplode(F.split(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), ";")).alias("k", "decl"))
    pairs = own.where(F.contains("decl", F.lit(":"))).select("page_id", "selector", "at", "k", F.lower(strip(F.substring_index("decl", ":", 1))).alias("prop"), strip(F.expr("substr(decl, instr(decl, ':') + 1)")).alias("value"))
    return pairs.groupBy("page_id", "selector", "prop").agg(F.max_by("value", F.struct("at", "k")).alias("value"))


def pipe_table(rows: Column) -> Column:
    """Lines of columns parted by tabs or three spaces as a pipe table, short rows filled up; null if there is no cell."""
    parts = lambda row: F.when(F.contains(row, F.lit("\t")), F.split(row, r"\t")).otherwise(F.split(row, r" {3,}"))
    cells = F.filter(F.transform(rows, lambda row: F.filter(F.transform(parts(row), strip), lambda c: c != "")), lambda r: F.size(r) > 0)

    def table(wide: Column, own: Column) -> Column:
        rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
        line = lambda r, k: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"), F.when(k == 0, rule).otherwise(""))
        return F.array_join(F.transform(own, line), "\n")

    sized = named(cells, lambda own: F.struct(F.array_max(F.transform(own, F.size)).alias("wide"), own.alias("own")))
    return named(sized, lambda t: F.when(F.size(t["own"]) > 0, table(t["wide"], t["own"])))


def aligned_tables(texts: DataFrame) -> DataFrame:
    """(doc_id, markdown): texts of aligned columns as pipe tables; a text without any cell stays as it is."""
    return texts.select("doc_id", F.coalesce(pipe_table(F.split(strip(F.col("text")), r"\r\n|\n|\r")), F.col("text")).alias("markdown"))


def signal_parts(text: Column) -> Column:
    """The parts of a paragraph, cut before the signals that follow a sentence's end."""
    own = F.regexp_replace(text, r"(?i)\.\s+((?:Important|Critical|Warning|Danger|Note|Key Rule)\s*[:\-])", ".\n$1")
    parts = F.filter(F.transform(F.split(own, r"\r\n|\n|\r"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def inline_signals(texts: DataFrame) -> DataFrame:
    """(doc_id, part, text): paragraphs cut before the signals that follow a sentence's end."""
    return texts.select("doc_id", F.posexplode(signal_parts(F.col("text"))).alias("part", "text"))


#: Neighbouring lines with one of these tags are one item.
MERGED = ("list_item", "ordered_item", "table_row", "para")


def raw_items(classified: DataFrame) -> DataFrame:
    """(doc_id, item, tag, contents): classified raw lines in which neighbours of one kind are one item.

    A line starts an item unless it goes on with the tag of the line before and that tag merges. A table of one row
    is a paragraph of its own, also beside others.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    goes_on = F.col("tag").isin(*MERGED) & (F.lag("tag").over(w) == F.col("tag"))
    own = classified.withColumn("item", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    contents = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"])
    items = own.groupBy("doc_id", "item", "tag").agg(contents.alias("contents"))
    single = (F.col("tag") == "table_row") & (F.size("contents") == 1)
    return items.withColumn("tag", F.when(single, "para").when(F.col("tag").isin("list_item", "ordered_item"), "list").when(F.col("tag") == "table_row", "table").otherwise(F.col("tag")))


def raw_markdown(classified: DataFrame) -> DataFrame:
    """(doc_id, markdown): classified raw lines as the Markdown that the block parser reads.

    The first heading of level 1 or 2 is the title. Every item is followed by an empty line.
    """
    w = Window.partitionBy("doc_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum(F.col("tag").isin("h1", "h2").cast("int")).over(w)
    one, tag = F.element_at("contents", 1), F.col("tag")
    text = (
        F.when(tag == "list", F.array_join(F.transform("contents", lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(tag == "table", F.coalesce(pipe_table(F.col("contents")), F.array_join("contents", "\n")))
        .when(tag == "para", F.array_join(signal_parts(F.array_join("contents", " ")), "\n"))
        .when((tag == "h1") | ((tag == "h2") & (top == 1)), F.concat(F.lit("# "), one)).when(tag == "h2", F.concat(F.lit("## "), one))
        .when(tag.isin("h3", "h3_entity"), F.concat(F.lit("### "), one)).when(tag == "timeline", F.concat(F.lit("- "), one))
        .when(tag == "quote", F.concat(F.lit("> "), one)).otherwise(one)
    )
    lines = raw_items(classified).select("doc_id", "item", text.alias("x"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "x"))), lambda y: y["x"]), "\n\n")
    return lines.groupBy("doc_id").agg(F.concat(whole, F.lit("\n")).alias("markdown"))
