"""Positioned words to lines and Markdown: visual lines, headers, gutters, margins, hyphens and drop caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip


def body_size(words: DataFrame) -> DataFrame:
    """(doc_id, size): the font size with most characters, the smaller among equals."""
    by = words.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return by.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))


def _starts(values: Column, tolerance: float) -> Column:
    """For each value of a sorted array, the value that starts its run: the first one, then each that lies further than the tolerance from the last start."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.when(x - last <= tolerance, last).otherwise(x)))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), step)


#: The fields of a word; a page's words are an array of these.
WORD = ("top", "x0", "word_seq", "x1", "size", "text")


def pages_of(words: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page, words): the words of each page as one array; pages stay as they are.

    A source that has a page's words at once hands pages over, and no row per word is shuffled.
    """
    if "words" in words.columns:
        return words
    return words.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*WORD, *more)).alias("words"))


def row_starts(tops: Column, tolerance: float) -> Column:
    """The heights, of sorted ones, at which rows start: the first one, then each that lies more than the tolerance below the start before."""
    return F.aggregate(tops, F.slice(tops, 1, 1), lambda acc, t: F.when(t - F.element_at(acc, -1) > tolerance, F.array_append(acc, t)).otherwise(acc))


def by_rows(pages: DataFrame, tolerance: float, row: Callable[[Column, Callable], Column] = F.transform) -> DataFrame:
    """pages with ``rows``: the words parted by height, top to bottom, each row as ``row`` makes it of places and the word at a place.

    Words are sorted by height, so that a row is a run of them. It is read word by word, as slice() copies the whole page for each row.
    """
    own = pages.withColumn("words", F.sort_array("words")).withColumn("tops", F.col("words.top"))
    own = own.withColumn("starts", row_starts(F.array_distinct("tops"), tolerance)).withColumn("at", F.transform("starts", lambda t: F.array_position("tops", t).cast("int")))
    places = lambda k, i: F.sequence(k - 1, F.coalesce(F.get("at", i + 1), F.size("words") + 1) - 2)
    return own.withColumn("rows", F.transform("at", lambda k, i: row(places(k, i), lambda j: F.get("words", j)))).drop("words", "tops", "starts", "at")


#: The fields of a line.
LINE = ("line", "top", "x0", "x1", "size", "text")


def _line(fields: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    """A row's words and its number as a line of these fields."""

    def line(r: Column, i: Column) -> Column:
        text = F.array_join(F.transform(F.sort_array(F.transform(r, lambda w: F.struct(w["x0"], w["word_seq"], w["text"]))), lambda w: w["text"]), " ")
        every = {"line": i, "top": F.array_min(r["top"]), "x0": F.array_min(r["x0"]), "x1": F.array_max(r["x1"]), "size": F.array_max(r["size"]), "text": text}
        return F.struct(*[every[f].alias(f) for f in fields])

    return line


def page_lines(words: DataFrame, tolerance: float = 3.0, fields: tuple[str, ...] = LINE, ends: bool = False) -> DataFrame:
    """(doc_id, page, lines): the lines of visual_lines, top to bottom, as one array a page; of these fields only, or only the first and the last line."""
    rows, line = by_rows(pages_of(words), tolerance), _line(fields)
    last = F.size("rows") - 1
    at = F.when(last > 0, F.array(F.lit(0), last)).when(last == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    lines = F.transform(at, lambda i: line(F.get("rows", i), i)) if ends else F.transform("rows", line)
    return rows.select("doc_id", "page", lines.alias("lines"))


def visual_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, line, top, x0, x1, size, text): words of about one height, left to right.

    A line starts where a word lies more than the tolerance below the first word of the line
    before, so words that drift down do not chain. Words are rows or pages; a page's words,
    which its size bounds, are parted inside of its row.
    """
    return by_rows(pages_of(words), tolerance).select("doc_id", "page", F.inline(F.transform("rows", _line(LINE))))


def running_edges(lines: DataFrame, least_pages: int = 4) -> DataFrame:
    """(doc_id, edge, text): first or last lines that repeat on 3 pages and 40 % of them at least; lines are rows or pages of page_lines."""
    both = lambda first, last: F.array(*[F.struct(F.lit(e).alias("edge"), x.alias("text")) for e, x in (("first", first), ("last", last))])
    if "lines" in lines.columns:
        # a filter of rows would be pushed below the lines and make them a second time
        edges = F.filter(both(F.get("lines.text", F.lit(0)), F.get("lines.text", F.size("lines") - 1)), lambda _: F.size("lines") > 0)
    else:
        lines = lines.groupBy("doc_id", "page").agg(F.min_by("text", "line").alias("first"), F.max_by("text", "line").alias("last"))
        edges = both(F.col("first"), F.col("last"))
    own = lines.select("doc_id", F.explode(edges).alias("e")).select("doc_id", "e.*")
    counts = own.groupBy("doc_id", "edge", "text").agg(F.count("*").alias("n"))
    # each page has one text for each edge, so the counts of an edge are its pages
    best = counts.groupBy("doc_id", "edge").agg(F.sum("n").alias("pages"), F.max_by(F.struct("text", "n"), F.struct("n", "text")).alias("b"))
    return best.where((F.col("pages") >= least_pages) & (F.col("b.n") >= F.greatest(F.lit(3.0), F.col("pages") * 0.4))).select("doc_id", "edge", "b.text")


def median_gap(lines: DataFrame) -> DataFrame:
    """(doc_id, gap): the upper median of positive distances between lines of a page; lines are rows or pages of page_lines.

    Equal distances are counted first, so that only a document's different ones are sorted.
    """
    if "lines" in lines.columns:
        tops = F.col("lines.top")
        gaps = lines.select("doc_id", F.explode(F.zip_with(F.slice(tops, F.lit(2), F.size(tops)), tops, lambda t, before: t - before)).alias("gap"))
    else:
        gaps = lines.select("doc_id", (F.col("top") - F.lag("top").over(Window.partitionBy("doc_id", "page").orderBy("line"))).alias("gap"))
    counts = gaps.where("gap > 0").groupBy("doc_id", "gap").agg(F.count("*").alias("n"))
    doc = Window.partitionBy("doc_id")
    own = counts.withColumns({"upto": F.sum("n").over(doc.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)), "k": F.floor(F.sum("n").over(doc) / 2)})
    return own.where((F.col("upto") - F.col("n") <= F.col("k")) & (F.col("k") < F.col("upto"))).select("doc_id", "gap")


def gutter(words: DataFrame, lines_tolerance: float = 3.0, bins: int = 200) -> DataFrame:
    """(doc_id, page, low, high): the widest empty band of the page's middle half, in bins.

    A row's words become one bit set of covered bins, so words are shuffled once by page and
    no row per bin is made; a page's bit sets, one a row, are counted bin by bin.
    """
    width = F.max("x1").over(Window.partitionBy("doc_id", "page"))
    bin_of = lambda x: F.least(F.floor(x / F.col("w") * bins), F.lit(bins - 1)).cast("int")
    own = words.withColumn("w", width).select("doc_id", "page", F.floor(F.col("top") / lines_tolerance).alias("row"), bin_of(F.col("x0")).alias("a"), bin_of(F.col("x1")).alias("b"))
    ones = F.lit(-1).cast("long")

    def mask(k: int) -> Column:
        low, high = F.greatest(F.col("a") - 64 * k, F.lit(0)), F.least(F.col("b") - 64 * k, F.lit(63))
        bits = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, 63 - high))
        return F.when((low <= 63) & (high >= 0), bits).otherwise(F.lit(0).cast("long"))

    rows = own.groupBy("doc_id", "page", "row").agg(F.array(*[F.bit_or(mask(k)) for k in range(-(-bins // 64))]).alias("covered"))
    pages = rows.groupBy("doc_id", "page").agg(F.collect_list("covered").alias("rows"))
    free = lambda b: F.size(F.filter("rows", lambda r: F.call_function("bit_get", F.element_at(r, (b / 64).cast("int") + 1), (b % 64).cast("int")) == 1)) <= F.size("rows") * 0.05
    found = pages.select("doc_id", "page", F.posexplode(F.filter(F.sequence(F.lit(bins // 4), F.lit(bins * 3 // 4 - 1)), free)).alias("k", "bin"))
    islands = found.groupBy("doc_id", "page", (F.col("bin") - F.col("k")).alias("isl")).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    return islands.groupBy("doc_id", "page").agg(F.max_by(F.struct("low", "high"), F.struct((F.col("high") - F.col("low")).alias("s"), -F.col("low"))).alias("b")).select("doc_id", "page", "b.*")


def left_margin(lines: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, margin): the smallest of the three commonest left edges that have 20 % of the largest one's lines.

    Rounded edges within the tolerance of the first of their cluster count as one edge, named
    by that first one; of equally common edges the smaller comes first. Lines are rows or pages of page_lines.
    """
    if "lines" in lines.columns:
        lines = lines.select("doc_id", F.explode("lines.x0").alias("x0"))
    by = lines.groupBy("doc_id", F.bround("x0").alias("x0")).agg(F.count("*").alias("n"))
    edges = by.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x0", "n"))).alias("edges"))
    named = F.arrays_zip(F.col("edges.n").alias("n"), _starts(F.col("edges.x0"), tolerance).alias("margin"))
    own = edges.select("doc_id", F.inline(named)).groupBy("doc_id", "margin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "margin")
    own = own.withColumns({"k": F.row_number().over(w), "most": F.max("n").over(Window.partitionBy("doc_id"))})
    return own.where((F.col("k") <= 3) & (F.col("n") >= F.col("most") * 0.2)).groupBy("doc_id").agg(F.min("margin").alias("margin"))


def column_margins(lines: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, col, margin): the left margin of each column of a document."""
    own = lines.withColumnsRenamed({"doc_id": "_doc"}).withColumn("doc_id", F.struct("_doc", "col"))
    return left_margin(own, tolerance).select(F.col("doc_id._doc").alias("doc_id"), F.col("doc_id.col").alias("col"), "margin")


def without_folios(lines: DataFrame, factor: float = 1.6) -> DataFrame:
    """lines without page numbers: a number that is a page's only line, or its last one further below than usual.

    Usual is the upper median of the page's positive gaps; without one a last number goes.
    """
    page = Window.partitionBy("doc_id", "page")
    w = page.orderBy("line")
    own = lines.withColumns({"_gap": F.col("top") - F.lag("top").over(w), "_last": F.max("line").over(page), "_n": F.count("*").over(page)})
    gaps = F.array_sort(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap"))).over(page))
    own = own.withColumn("_g", gaps).withColumn("_usual", F.get("_g", F.floor(F.size("_g") / 2).cast("int"))).drop("_g")
    folio = (F.col("line") == F.col("_last")) & strip(F.col("text")).rlike(r"^\d+$") & ((F.col("_n") == 1) | F.col("_usual").isNull() | (F.col("_gap") > F.col("_usual") * factor))
    return own.where(~folio).drop("_gap", "_last", "_n", "_usual")


def dehyphenated(lines: DataFrame) -> DataFrame:
    """lines with ``joined``: a line that ends in a hyphen takes the next line's first word, which leaves that line."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    ends = lambda x: x.rlike(r"[A-Za-z]-$")
    next_text, before = F.lead("text").over(w), F.lag("text").over(w)
    takes = ends(F.col("text")) & next_text.rlike(r"^\p{Ll}")
    gave = F.coalesce(ends(before) & F.col("text").rlike(r"^\p{Ll}"), F.lit(False))
    own = lines.withColumns({"_next": F.regexp_extract(next_text, r"^(\S+)", 1), "_takes": F.coalesce(takes, F.lit(False)), "_gave": gave})
    rest: Column = F.when(F.col("_gave"), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
    return own.withColumn("joined", F.when(F.col("_takes"), F.concat(F.regexp_replace(rest, "-$", ""), F.col("_next"))).otherwise(rest)).drop("_next", "_takes", "_gave")


def headings(lines: DataFrame, factor: float = 1.15) -> DataFrame:
    """lines with ``is_heading``: set in a size well above the body's."""
    return lines.join(body_size(lines.withColumn("text", F.col("text"))).withColumnRenamed("size", "body"), "doc_id").withColumn("is_heading", F.col("size") > F.col("body") * factor).drop("body")


def looks_like_script(lines: DataFrame) -> DataFrame:
    """(doc_id, script): twenty lines and enough of them speaker labels in capitals."""
    own = lines.where("text <> ''")
    label = F.forall(F.split("text", r"\s+"), lambda w: w.rlike(r"^[A-Z][A-Z']+$")) & (F.size(F.split("text", r"\s+")) <= 4)
    return own.groupBy("doc_id").agg(((F.count("*") >= 20) & (F.count_if(label) >= F.greatest(F.lit(15.0), F.count("*") * 0.12))).alias("script"))
