"""Positioned words to Markdown in reading order: rows, columns, running edges, split words, initials and paragraphs.

Words have doc_id, page, page_width, word_seq, text, x0, x1, top and size. What needs a page
groups by (doc_id, page), what needs the stream of all lines by doc_id; every order is an explicit key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip, without_private_marks
from foliant.operators import layout as Y
from foliant.session import settled

# fixed values: shares of the body's size, points and shares of a page
HEADING_RATIO = 1.3
INITIAL_RATIO = 1.6
ROW_TOLERANCE = 3.0
INDENT = 8.0
GUTTER_LEAST = 10.0
GUTTER_FROM, GUTTER_TO = 0.25, 0.75
GUTTER_ROWS = 12
GUTTER_SIDE = 0.15
GUTTER_COVER = 0.05
BINS = 200

PAGE = ("doc_id", "page")


def paged(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """(doc_id, page, page_width, rows): each page with its visual rows, top to bottom, words by x0, top and word_seq.

    A row starts at a word that lies more than the tolerance below the first word of the row
    before. Words are rows or pages; paged frames stay as they are.
    """
    if "rows" in words.columns:
        return words
    pages = Y.pages_of(words, "page_width").select(*PAGE, F.array_max("words.page_width").alias("page_width"), "words")
    word = lambda w: F.struct(*[w[c].alias(c) for c in ("x0", "top", "word_seq", "text", "size", "x1")])
    # sorted where a row is made, as each transform copies its words
    return Y.by_rows(pages, tolerance, lambda places, at: F.sort_array(F.transform(places, lambda j: word(at(j))))).select(*PAGE, "page_width", "rows")


def rows_of(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """words with ``row``: the number of the visual row on its page, from 0."""
    rows = paged(words, tolerance).select(*PAGE, "page_width", F.posexplode("rows").alias("row", "r"))
    return rows.select(*PAGE, "page_width", F.inline("r"), "row")


def _center(word: Column) -> Column:
    return (word["x0"] + word["x1"]) / 2


def with_gutters(pages: DataFrame) -> DataFrame:
    """pages with left and right: the widest band of the page's middle half that hardly a row touches; else null.

    A page needs GUTTER_ROWS rows, the band GUTTER_LEAST points, and either side GUTTER_SIDE of the words. Of equally
    wide bands the first counts. A row's words are one bit set of the middle's bins that they touch, cut into longs.
    """
    first, end = int(BINS * GUTTER_FROM), int(BINS * GUTTER_TO)
    longs = [range(k, min(k + 50, end)) for k in range(first, end, 50)]
    step = F.col("page_width") / BINS
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")

    def ends(word: Column) -> Column:
        low, high = [F.least(F.greatest((word[c] / F.col("_step")).cast("int"), F.lit(0)), F.lit(BINS - 1)) for c in ("x0", "x1")]
        return F.struct(low.alias("a"), (high + 1).alias("b"))

    def before(j: Column, own: range) -> Column:
        return F.call_function("shiftleft", one, F.least(F.greatest(j - own.start, F.lit(0)), F.lit(len(own))))

    def union(acc: Column, x: Column) -> Column:
        # the sets of all bins before two bins differ by the bins from one to the other
        return F.struct(*[acc[f"m{k}"].bitwiseOR(before(F.greatest(x["b"], x["a"]), own) - before(x["a"], own)).alias(f"m{k}") for k, own in enumerate(longs)])

    none = F.struct(*[zero.alias(f"m{k}") for k in range(len(longs))])
    enough = (F.col("page_width") > 0) & (F.size("rows") >= GUTTER_ROWS)
    own = pages.withColumn("_step", F.when(enough, step))
    own = own.withColumn("_touched", F.when(F.col("_step").isNotNull(), F.transform("rows", lambda r: F.aggregate(F.transform(r, ends), none, union))))
    # bins that one row touches at least, two rows, and so on up to one row more than a free bin may have
    most = F.floor(F.size("rows") * GUTTER_COVER).cast("int")

    def level(acc: Column, m: Column) -> Column:
        below = lambda j, k: F.when(j == 0, m[k]).otherwise(F.get(acc, j - 1)[k].bitwiseAND(m[k]))
        return F.transform(acc, lambda x, j: F.struct(*[x[k].bitwiseOR(below(j, k)).alias(k) for k in (f"m{i}" for i in range(len(longs)))]))

    own = own.withColumn("_crowded", F.element_at(F.aggregate("_touched", F.array_repeat(none, most + 1), level), -1))

    def free(k: int, own: range) -> Column:
        return F.filter(F.sequence(F.lit(own.start), F.lit(own.stop - 1)), lambda b: F.call_function("bit_get", F.col(f"_crowded.m{k}"), b - own.start) == 0)

    own = own.withColumn("_free", F.when(F.col("_touched").isNotNull(), F.concat(*[free(k, b) for k, b in enumerate(longs)])))

    def widest(acc: Column, b: Column) -> Column:
        low = F.when(b == acc["last"] + 1, acc["low"]).otherwise(b)
        more = b - low > acc["to"] - acc["from"]
        return F.struct(low.alias("low"), b.alias("last"), F.when(more, low).otherwise(acc["from"]).alias("from"), F.when(more, b).otherwise(acc["to"]).alias("to"))

    start = F.struct(F.lit(-9).alias("low"), F.lit(-9).alias("last"), F.lit(0).alias("from"), F.lit(-1).alias("to"))
    own = own.withColumn("_band", F.aggregate("_free", start, widest, lambda acc: F.struct(acc["from"].alias("low"), (acc["to"] + 1).alias("high"))))
    wide = (F.col("_band.high") - F.col("_band.low")) * F.col("_step") >= GUTTER_LEAST
    own = own.withColumns({"_left": F.when(wide, F.col("_band.low") * F.col("_step")), "_right": F.when(wide, F.col("_band.high") * F.col("_step"))})
    centers = F.flatten(F.transform("rows", lambda r: F.transform(r, _center)))
    own = own.withColumns({"_middle": (F.col("_left") + F.col("_right")) / 2, "_centers": F.when(F.col("_left").isNotNull(), centers)})
    own = own.withColumn("_share", F.size(F.filter("_centers", lambda c: c < F.col("_middle"))) / F.size("_centers"))
    held = (F.col("_share") >= GUTTER_SIDE) & (1 - F.col("_share") >= GUTTER_SIDE)
    return own.select(*PAGE, "page_width", "rows", F.when(held, F.col("_left")).alias("left"), F.when(held, F.col("_right")).alias("right"))


def gutters(words: DataFrame) -> DataFrame:
    """(doc_id, page, left, right) of the pages that have a gutter."""
    # no filter, which Spark would push down with every expression below it spelled out
    found = F.when(F.col("left").isNotNull(), F.array(F.struct("left", "right")))
    return with_gutters(paged(words)).select(*PAGE, F.inline(found))


def in_order(pages: DataFrame) -> DataFrame:
    """pages with ``lines``: each page's lines (line, col, x0, top, size, size2, words) in reading order, by its gutter.

    A row with a word in the gutter stands across both columns; other rows are parted at its
    middle. Between two rows across, the left column is read before the right one. Words are texts; the sizes
    are those of the first and of the second word.
    """
    crosses = lambda r: F.coalesce(F.exists(r, lambda w: (w["x0"] < F.col("right")) & (w["x1"] > F.col("left"))), F.lit(False))
    own = pages.withColumn("_across", F.when(F.col("left").isNull(), F.transform("rows", lambda r: F.lit(False))).otherwise(F.transform("rows", crosses)))
    own = own.withColumns({"_wide": F.filter(F.transform("_across", lambda a, i: F.when(a, i)), lambda i: i.isNotNull()), "_middle": (F.col("left") + F.col("right")) / 2})

    def parts(r: Column, i: Column) -> Column:
        across = F.get("_across", i)
        whole = across | F.col("_middle").isNull()
        side = lambda keep: F.filter(r, keep)
        line = lambda col, order, words: F.struct(F.size(F.filter("_wide", lambda k: k < i)).alias("part"), order.alias("order"), i.alias("row"), F.lit(col).alias("col"), words.alias("words"))
        left = side(lambda w: _center(w) < F.col("_middle"))
        right = side(lambda w: ~F.coalesce(_center(w) < F.col("_middle"), F.lit(False)))
        return F.when(whole, F.array(line(0, F.when(across, 2).otherwise(0), r))).otherwise(F.array(line(0, F.lit(0), left), line(1, F.lit(1), right)))

    lines = F.sort_array(F.filter(F.flatten(F.transform("rows", parts)), lambda x: F.size(x["words"]) > 0))

    def numbered(x: Column, n: Column) -> Column:
        first = F.get(x["words"], F.lit(0))
        size2 = F.get(x["words"], F.lit(1))["size"]
        return F.struct(n.alias("line"), x["col"].alias("col"), first["x0"].alias("x0"), first["top"].alias("top"), first["size"].alias("size"), size2.alias("size2"), x["words"]["text"].alias("words"))

    return own.withColumn("lines", F.transform(lines, numbered)).drop("_across", "_wide", "_middle")


def assembled(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, col, x0, top, size, size2, words): the lines of in_order as rows."""
    return in_order(pages).select(*PAGE, F.inline(F.filter("lines", lambda x: x.isNotNull())))


def line_text(words: Column) -> Column:
    return strip(F.array_join(words, " "))


def _edge(at: int) -> Column:
    """The text of a page's first (1) or last (-1) row."""
    return line_text(F.element_at("rows", at)["text"])


def edge_texts(words: DataFrame) -> DataFrame:
    """(doc_id, head, foot): the text of the first or last row that recurs on 3 pages and 40 % of them at least, of 4 or more with text.

    Of equally frequent texts, the one that comes first in the document.
    """
    both = F.array(*[F.struct(F.lit(e).alias("edge"), _edge(at).alias("text")) for e, at in (("head", 1), ("foot", -1))])
    edges = paged(words).select(*PAGE, F.inline(both)).where("text <> ''")
    counts = edges.groupBy("doc_id", "edge", "text").agg(F.count("*").alias("n"), F.min("page").alias("since"))
    best = counts.groupBy("doc_id", "edge").agg(F.sum("n").alias("pages"), F.max_by(F.struct("text", "n"), F.struct("n", -F.col("since"))).alias("b"))
    best = best.where((F.col("pages") >= 4) & (F.col("b.n") >= F.greatest(F.lit(3.0), F.col("pages") * 0.4)))
    of = lambda edge: F.max(F.when(F.col("edge") == edge, F.col("b.text")))
    return best.groupBy("doc_id").agg(of("head").alias("head"), of("foot").alias("foot"))


def with_document(pages: DataFrame) -> DataFrame:
    """pages of in_order with body, the document's commonest size, and head and foot, its edge_texts.

    These are windows over rows of pages, so that a page's lines are made once. A page is a row for each of its
    sizes; the first of these has its lines.
    """
    length = lambda r, s: F.aggregate(r, F.lit(0).cast("long"), lambda acc, w: acc + F.when(w["size"].eqNullSafe(s), F.coalesce(F.length(w["text"]), F.lit(0))).otherwise(0))
    total = lambda s: F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + length(r, s))
    # an expression, not a column: for a column Spark would add a filter and push it down with every expression below it spelled out
    sizes = F.transform("sizes", lambda s: F.struct(F.round(s, 1).alias("size"), total(s).alias("n")))
    own = pages.select(*PAGE, "lines", "rows", _edge(1).alias("head"), _edge(-1).alias("foot"), F.array_distinct(F.flatten(F.transform("rows", lambda r: F.array_distinct(r["size"])))).alias("sizes"))
    own = own.select(*PAGE, "lines", "head", "foot", F.posexplode(sizes).alias("k", "s"))
    own = own.select(*PAGE, "k", *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in ("lines", "head", "foot")], F.col("s.size").alias("size"), F.col("s.n").alias("n"))
    doc = Window.partitionBy("doc_id")
    own = own.withColumn("n", F.sum("n").over(Window.partitionBy("doc_id", "size")))
    own = own.withColumn("body", F.max_by("size", F.struct("n", -F.col("size"))).over(doc)).where("k = 0").drop("k", "size", "n")
    for edge in ("head", "foot"):
        same = Window.partitionBy("doc_id", edge)
        own = own.withColumns({f"_{edge}_n": F.count("*").over(same), f"_{edge}_since": F.min("page").over(same)})
    best = {}
    for edge in ("head", "foot"):
        given = F.col(edge) != ""
        best[f"_{edge}_pages"] = F.count_if(given).over(doc)
        best[f"_{edge}_b"] = F.max_by(F.struct(F.col(edge).alias("text"), F.col(f"_{edge}_n").alias("n")), F.when(given, F.struct(f"_{edge}_n", -F.col(f"_{edge}_since")))).over(doc)
    own = own.withColumns(best)
    recurs = lambda n, pages: (pages >= 4) & (n >= F.greatest(F.lit(3.0), pages * 0.4))
    return own.select(*PAGE, "lines", "body", *[F.when(recurs(F.col(f"_{e}_b.n"), F.col(f"_{e}_pages")), F.col(f"_{e}_b.text")).alias(e) for e in ("head", "foot")])


def without_edges(pages: DataFrame) -> DataFrame:
    """The lines, as rows, of pages of with_document, without running heads, feet and page numbers.

    A page number is as in layout.without_folios.
    """
    text = lambda i: line_text(F.get("lines", i)["words"])
    is_edge = lambda i, edge: F.coalesce(text(i) == F.col(edge), F.lit(False)).cast("int")
    own = pages.withColumns({"_from": is_edge(F.lit(0), "head"), "_last": F.size("lines") - 1 - is_edge(F.size("lines") - 1, "foot")})
    number = (F.col("_last") >= F.col("_from")) & text(F.col("_last")).rlike(r"^\d+$")
    top = lambda i: F.get("lines", i)["top"]
    gaps = F.when(F.col("_last") > F.col("_from"), F.transform(F.sequence(F.col("_from") + 1, F.col("_last")), lambda i: top(i) - top(i - 1)))
    own = own.withColumn("_number", number).withColumn("_gaps", F.when(F.col("_number"), gaps))
    own = own.withColumn("_sorted", F.sort_array(F.filter("_gaps", lambda g: g > 0)))
    usual = F.get("_sorted", F.floor(F.size("_sorted") / 2).cast("int"))
    folio = F.col("_number") & (F.col("_gaps").isNull() | usual.isNull() | (F.element_at("_gaps", -1) > usual * 1.6))
    own = own.withColumn("_last", F.col("_last") - F.when(~folio, 0).otherwise(1))
    return own.select(*PAGE, "body", F.inline(F.filter("lines", lambda x, i: (i >= F.col("_from")) & (i <= F.col("_last")))))


_LINE = ("page", "line", "col", "x0", "size", "words")


def _with_text(words: Column, at: int, text: Column) -> Column:
    """words with another text in place of the first (1) or the last (-1) of them."""
    rest = F.size(words) - 1
    return F.concat(F.array(text), F.slice(words, F.lit(2), rest)) if at == 1 else F.concat(F.slice(words, F.lit(1), rest), F.array(text))


def rejoined(lines: DataFrame) -> DataFrame:
    """Lines, numbered by ``pos``, in which words that a line's end parts with a hyphen are whole again, over borders of columns and pages.

    The second part leaves its line. A line of that word only goes, and if that ends in a hyphen
    too, the next line's first word follows.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    alone = F.size("words") == 1
    # a word of two characters parts nothing of its own, but goes on with what is parted before it
    short = alone & last.rlike(r"^\p{Ll}-$")
    parts = last.rlike("[^-]-$") & (F.length(last) > 2)
    parted = F.last(F.when(~short, parts), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = lines.withColumn("_gives", F.coalesce(parted, F.lit(False)) & first.rlike(r"^\p{Ll}")).withColumn("_goes", F.col("_gives") & alone)
    # a line that stays has an even number, the lines behind it that go the odd one above
    stays = F.sum(F.when(F.col("_goes"), 0).otherwise(2)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("pos", stays + F.col("_goes").cast("int"))
    by = Window.partitionBy("doc_id").orderBy("pos")
    own = own.withColumn("_tail", F.collect_list(F.struct("page", "line", first.alias("text"))).over(by.rangeBetween(1, 1))).where(~F.col("_goes"))
    own = own.withColumns({"_next": F.when(F.lead("_gives").over(by), F.lead(first).over(by))})
    following = F.when(F.col("_next").isNotNull(), F.array("_next")).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("_pieces", F.when((F.size("_tail") > 0) | F.col("_next").isNotNull(), F.concat(F.array(last), F.sort_array("_tail")["text"], following)))
    whole = F.concat(F.array_join(F.transform(F.slice("_pieces", F.lit(1), F.size("_pieces") - 1), lambda p: F.regexp_replace(p, "-$", "")), ""), F.element_at("_pieces", -1))
    words = F.when(F.col("_gives"), F.slice("words", F.lit(2), F.size("words") - 1)).otherwise(F.col("words"))
    own = own.withColumns({"words": words, "size": F.when(F.col("_gives"), F.col("size2")).otherwise(F.col("size"))})
    own = own.withColumn("words", F.when(F.col("_pieces").isNotNull(), _with_text(F.col("words"), -1, whole)).otherwise(F.col("words")))
    return own.select("doc_id", "pos", "body", *_LINE)


def with_initials(lines: DataFrame) -> DataFrame:
    """Lines of rejoined in which large initials, lines of one word of up to two letters, stand before the next line's first word.

    Two such lines in a row join as long as they are an initial together.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    initial = (F.size("words") == 1) & (F.col("size") >= F.col("body") * INITIAL_RATIO) & F.element_at("words", 1).rlike(r"^\p{L}{1,2}$")
    own = lines.withColumn("_initial", initial & F.lead("pos").over(w).isNotNull())
    # a line that stays has an even number, the initials before it the odd one below
    own = own.withColumn("_at", 2 * F.coalesce(F.count_if(~F.col("_initial")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.when(F.col("_initial"), 1).otherwise(2))
    before = F.collect_list(F.struct(*_LINE)).over(Window.partitionBy("doc_id").orderBy("_at").rangeBetween(-1, -1))
    own = own.withColumn("_before", before).where(~F.col("_initial"))

    def step(acc: Column, x: Column) -> Column:
        text = F.concat(acc["carry"], F.element_at(x["words"], 1))
        goes = F.length(text) <= 2
        kept = F.array_append(acc["out"], x.withField("words", F.array(text)))
        return F.struct(F.when(goes, acc["out"]).otherwise(kept).alias("out"), F.when(goes, text).otherwise("").alias("carry"))

    start = F.struct(F.slice("_before", 1, 0).alias("out"), F.lit("").alias("carry"))
    own = own.withColumn("_joined", F.when(F.size("_before") > 0, F.aggregate(F.sort_array("_before"), start, step)))
    line = F.struct(*_LINE)
    with_carry = line.withField("words", _with_text(F.col("words"), 1, F.concat("_joined.carry", F.element_at("words", 1))))
    every = F.when(F.col("_joined").isNull(), F.array(line)).otherwise(F.array_append("_joined.out", with_carry))
    return own.select("doc_id", "body", F.inline(every))


def rendered(lines: DataFrame) -> DataFrame:
    """(doc_id, part, kind, text): headings and paragraphs in order.

    Neighbouring lines in heading type are one heading. A paragraph starts behind a heading, at a line that
    is indented in its column, and in a script at a speaker's name.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    first = F.element_at("words", 1)
    margins = Y.column_margins(lines.select("doc_id", "col", "x0")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "margin"))).alias("margins"))
    own = lines.join(margins, "doc_id").withColumn("margin", F.element_at("margins", F.col("col"))).drop("margins")
    own = own.withColumn("text", F.array_join("words", " "))
    own = own.join(Y.looks_like_script(own.select("doc_id", "text")), "doc_id", "left")
    speaker = F.coalesce(F.col("script"), F.lit(False)) & (F.size("words") <= 4) & F.forall("words", lambda x: x.rlike(r"^[A-Z][A-Z']+$"))
    heading = (F.col("size") >= F.col("body") * HEADING_RATIO) & ((F.length(first) > 2) | (F.size("words") > 1))
    own = own.withColumns({"kind": F.when(heading, "heading").otherwise("para"), "starts": speaker | (F.col("x0") > F.col("margin") + INDENT)})
    changes = F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))
    own = own.withColumn("part", F.sum((changes | ((F.col("kind") == "para") & F.col("starts"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), " ")
    parts = own.groupBy("doc_id", "part", "kind").agg(strip(without_private_marks(text)).alias("text"))
    return parts.where("text <> ''")


def body_lines(pages: DataFrame) -> DataFrame:
    """The lines of the text proper with ``body``: in reading order, without edges, words whole and initials joined."""
    return with_initials(rejoined(without_edges(with_document(in_order(with_gutters(pages))))))


def markdown(words: DataFrame) -> DataFrame:
    """(doc_id, markdown): each document of positioned words as Markdown. Lines are read several times, so they are written once."""
    parts = rendered(settled(body_lines(paged(words)), "lines"))
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    own = parts.select("doc_id", "part", line.alias("x"))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "x"))), lambda y: y["x"]), "\n\n").alias("markdown"))
