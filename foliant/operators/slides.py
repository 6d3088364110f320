"""Texts of slides: tagline, agenda, key points, evidence, icons, list series and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.operators.topics import top_of_type

# fixed values: icons of project types, topic types and slides
ICONS = {
    "Story Bible": "📖", "Research Notes": "🔬", "Project Plan": "📋", "Knowledge Base": "🧠", "Worldbuilding Document": "🌍", "Study Notes": "📝", "Document": "📄", "Debate Preparation": "⚖", "Competition Planning": "🏆",
    "entities": "👤", "timeline": "📅", "data": "📊", "warning": "⚠️", "quote": "💬", "general": "◆", "summary": "✅", "agenda": "📋", "conclusion": "🎯",
}
AGENDA, KEY_TOPICS, KEY_POINTS, EVIDENCE, BRIEF = 10, 7, 6, 3, 6


def icon_of(kind: Column, default: str = "📄") -> Column:
    icon: Column = F.lit(default)
    for name, mark in ICONS.items():
        icon = F.when(kind == name, mark).otherwise(icon)
    return icon


def tagline(blocks: DataFrame) -> DataFrame:
    """(doc_id, tagline): the most important paragraph or callout, shortened; documents without one are not listed."""
    return top_of_type(blocks, ("paragraph", "callout"), 1).select("doc_id", F.substring("content", 1, 160).alias("tagline"))


def agenda(topics: DataFrame, title: Column) -> DataFrame:
    """(doc_id, place, bullet): the first topics of documents that have two at least."""
    w = Window.partitionBy("doc_id")
    own = topics.withColumns({"bullet": title, "place": F.row_number().over(w.orderBy("sec", "sub")), "_n": F.count("*").over(w)})
    return own.where((F.col("_n") >= 2) & (F.col("place") <= AGENDA)).select("doc_id", "place", "bullet")


def key_points(topics: DataFrame, blocks: DataFrame, title: Column) -> DataFrame:
    """(doc_id, place, point): the first topics, each with its most important callout or paragraph if it has one.

    Among equals callouts stand before paragraphs, then the earlier block.
    """
    order = F.struct(-F.col("importance"), (F.col("type") != "callout").cast("int"), F.col("seq"))
    best = blocks.where(F.col("type").isin("callout", "paragraph")).groupBy("doc_id", "sec", "sub").agg(F.min_by("content", order).alias("best"))
    first = topics.withColumns({"title": title, "place": F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "sub"))}).where(F.col("place") <= min(KEY_TOPICS, KEY_POINTS))
    point = F.when(F.col("best").isNotNull(), F.concat("title", F.lit(": "), F.substring("best", 1, 100))).otherwise(F.col("title"))
    return first.join(best, ["doc_id", "sec", "sub"], "left").select("doc_id", "place", point.alias("point"))


def evidence(blocks: DataFrame) -> DataFrame:
    """(doc_id, sec, sub, place, bullet): the most important paragraphs of each topic, shortened."""
    own = top_of_type(blocks, ("paragraph",), EVIDENCE, ("doc_id", "sec", "sub"))
    return own.select("doc_id", "sec", "sub", "place", F.substring("content", 1, 200).alias("bullet"))


def brief(blocks: DataFrame, title: Column) -> DataFrame:
    """(doc_id, place, title, text, entities, n_blocks, shade): the first sections with their best text and first three names.

    Cards take two shades in turn.
    """
    text = F.max_by(F.substring("content", 1, 220), F.when(F.col("type").isin("paragraph", "callout"), F.struct(F.col("importance"), -F.col("seq"))))
    names = F.slice(F.array_sort(F.collect_list(F.when(F.col("type") == "entity", F.struct("seq", "content")))), 1, 3)
    own = blocks.groupBy("doc_id", "sec", "sub").agg(title.alias("title"), text.alias("text"), F.array_join(names["content"], "; ").alias("entities"), F.count("*").alias("n_blocks"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "sub"))).where(F.col("place") <= BRIEF)
    return own.select("doc_id", "place", "title", F.coalesce("text", F.lit("")).alias("text"), "entities", "n_blocks", F.pmod(F.col("place") - 1, F.lit(2)).cast("int").alias("shade"))


def list_series(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, row, label, value): the first list of each document with three items "label: number" at least."""
    items = blocks.where("type = 'list'").select("doc_id", "seq", F.posexplode(F.split("content", "\n")).alias("row", "x"))
    item = strip(F.regexp_replace(strip(F.col("x")), r"^[-•*]+", ""))
    pattern = r"^(.+?)[\s:—\-]+(\d[\d,.]*)%?\s*$"
    number = F.regexp_replace(F.regexp_extract(item, pattern, 2), ",", "")
    pairs = items.select("doc_id", "seq", "row", F.substring(strip(F.regexp_extract(item, pattern, 1)), 1, 20).alias("label"), F.when(item.rlike(pattern), number.try_cast("double")).alias("value")).where("value IS NOT NULL")
    enough = pairs.groupBy("doc_id", "seq").agg(F.count("*").alias("n")).where("n >= 3").groupBy("doc_id").agg(F.min("seq").alias("seq"))
    return pairs.join(enough, ["doc_id", "seq"], "left_semi").select("doc_id", "seq", "row", "label", "value")


def chart_series(blocks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, seq, row, label, value, title): what a chart of each document or topic shows, its first table with enough numbers, else its first such list.

    A table needs three rows with its header and three numbers in the second column of the eight rows after it;
    separator and blank rows do not count as rows. Its title is the first cell of the header; lists have none.
    """
    keys = [*by, "seq"]
    listed = F.filter(F.split("content", "\n"), lambda r: (strip(r) != "") & ~r.rlike(r"^\|[-:\s|]+\|?$"))
    cells = lambda r: F.transform(F.split(F.regexp_replace(strip(r), r"^\|+|\|+$", ""), r"\|"), strip)
    tables = blocks.where("type = 'table'").select(*keys, listed.alias("rows")).where(F.size("rows") >= 3)
    table_rows = tables.select(*keys, cells(F.element_at("rows", 1))[0].alias("title"), F.posexplode(F.slice("rows", 2, 8)).alias("row", "r")).withColumn("c", cells(F.col("r")))
    number = F.nullif(F.regexp_replace(F.try_element_at("c", F.lit(2)), r"[^0-9.\-]", ""), F.lit("")).try_cast("double")
    of_tables = table_rows.select(*keys, F.lit(0).alias("kind"), "row", F.substring(F.col("c")[0], 1, 20).alias("label"), number.alias("value"), "title")
    pattern = r"^(.+?)[\s:—\-]+(\d[\d,.]*)%?\s*$"
    items = blocks.where("type = 'list'").select(*keys, F.posexplode(F.split("content", "\n")).alias("row", "x"))
    item = strip(F.regexp_replace(strip(F.col("x")), r"^[-•*]+", ""))
    value = F.when(item.rlike(pattern), F.regexp_replace(F.regexp_extract(item, pattern, 2), ",", "").try_cast("double"))
    of_lists = items.select(*keys, F.lit(1).alias("kind"), "row", F.substring(strip(F.regexp_extract(item, pattern, 1)), 1, 20).alias("label"), value.alias("value"), F.lit("").alias("title"))
    pairs = of_tables.unionByName(of_lists).where("value IS NOT NULL")
    enough = pairs.groupBy(*keys, "kind").agg(F.count("*").alias("n")).where("n >= 3").groupBy(*by).agg(F.min(F.struct("kind", "seq")).alias("at"))
    return pairs.join(enough.select(*by, "at.kind", "at.seq"), [*keys, "kind"], "left_semi").drop("kind")


def labelled_stats(blocks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, place, val, label): up to four distinct numbers of the prose of a document, or topic, with unit and label.

    Only the first six numbers above zero count; a number without words behind it is labelled
    by the start of its block.
    """
    pattern = r"\b(\d[\d,]*(?:\.\d+)?)\s*(%|x|X|\+)?\b\s*([A-Za-z][^.\n]{3,40})?"
    text = blocks.where(F.col("type").isin("paragraph", "list", "callout"))
    found = text.select(*by, "seq", "content", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("pos", "hit"))
    number = F.regexp_extract("hit", pattern, 1)
    label = F.substring(strip(F.regexp_extract("hit", pattern, 3)), 1, 30)
    own = found.select(*by, "seq", "pos", F.concat(number, F.regexp_extract("hit", pattern, 2)).alias("val"), F.when(label != "", label).otherwise(F.substring("content", 1, 30)).alias("label"), F.regexp_replace(number, ",", "").try_cast("double").alias("x")).where("x > 0")
    six = own.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("seq", "pos"))).where("k <= 6")
    first = six.groupBy(*by, "val").agg(F.min_by("label", "k").alias("label"), F.min("k").alias("k"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).where("place <= 4").select(*by, "place", "val", "label")
