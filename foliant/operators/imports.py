"""Designs of finished documents: colours and fonts of pages by their style rules or inline styles, and of runs of text.

Rules are read row by row without any shuffle. Only pages without a rule vote: each styled tag
votes once for each of its buckets, votes are counted per value before they are shuffled,
and of equal counts the value that comes first in the page wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.color import is_gray
from foliant.functions.text import normal_hex, strip

# fixed values: what a design has where its source says nothing
DEFAULTS = {
    "color_bg": "#FFFFFF", "color_text": "#111111", "color_accent": "#3B5BDB", "color_entity": "#5C3BC9", "color_callout": "#1A6E4A", "color_warning": "#C0392B", "color_border": "#E0E0E0",
    "font_heading": "Inter", "font_body": "Inter", "font_mono": "monospace", "base_font_size": "16px", "line_height": "1.7", "border_radius": "6px", "body_max_width": "840px",
}
# fixed values: elements of a design
ELEMENTS = ("h1", "h2", "h3", "body", "entity", "callout", "warning", "timeline", "quote", "th", "code")
# fixed values: selectors that speak for a part, the first that is there; properties that hold its colour
SELECTORS = {
    "body": ("body", "html"), "h1": ("h1",), "entity": (".entity", ".entity-card"), "callout": (".callout",), "warning": (".warning",), "timeline": (".timeline", ".timeline-event"),
    "quote": ("blockquote",), "th": ("th",), "code": ("code", "pre"), "border": ("hr", "td"),
}
BACKGROUND = ("background", "background-color")
SIDE = ("color", "border-left-color", "border-left", "border-color", "border")
COLORS = {
    "body": ("color",), "h1": ("color", "border-bottom-color", "border-bottom", "border-color", "border"),
    "border": ("border-color", "border-top-color", "border-bottom-color", "border-top", "border-bottom", "border"),
}
CLASSES = ("entity", "callout", "warning", "timeline")
VOTED_TAGS = {"h1": "h1", "h2": "h2", "h3": "h3", "blockquote": "quote", "th": "th", "code": "code", "pre": "pre"}
ACCENTED = ("h1", "h2", "h3", "strong", "b")
# fixed values: backgrounds for highlighters, the first whose name is part of the highlight's
HIGHLIGHTS = (
    ("YELLOW", "#FFF3A0"), ("BRIGHT_GREEN", "#D4F7D4"), ("TURQUOISE", "#CFF7F0"), ("PINK", "#FCE0EC"), ("RED", "#FCE0E0"), ("DARK_BLUE", "#DCE6FA"), ("TEAL", "#D6F5F0"), ("GREEN", "#DEF2DE"), ("VIOLET", "#EBE0FA"),
)
LARGE = 14

_RULE = r"([^{}]+)\{([^{}]+)\}"
_DECLARATION = r"([\p{L}\p{N}_-]+)\s*:\s*([^;]+)"
_HEX = r"#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})\b"
_UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TAG = r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_ATTRIBUTE = r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _pairs(x: Column, pattern: str, first: str, second: str) -> Column:
    """All matches of a pattern as structs of its two groups."""
    return F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias(first), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias(second))


def declarations(x: Column) -> Column:
    """array<struct<prop, value>> of "prop: value; ...", properties in lower case."""
    return F.transform(_pairs(x, _DECLARATION, "prop", "value"), lambda d: F.struct(F.lower(strip(d["prop"])).alias("prop"), strip(d["value"]).alias("value")))


def color_in(value: Column) -> Column:
    """The first hexadecimal colour of a value, in six digits; null without one."""
    found = F.regexp_extract(value, _HEX, 0)
    return F.when(found != "", normal_hex(found))


def _last(own: Column, prop: str) -> Column:
    """The value of the last declaration of a property."""
    return F.try_element_at(F.filter(own, lambda d: d["prop"] == prop), F.lit(-1))["value"]


def color_of(own: Column, props: tuple[str, ...]) -> Column:
    """The colour of the first of these properties that has one; the last declaration of a property counts."""
    return F.coalesce(*[color_in(_last(own, p)) for p in props])


def font_of(own: Column) -> Column:
    """The first family of the last font-family declaration, without quotes; null if empty."""
    name = F.regexp_replace(strip(F.substring_index(_last(own, "font-family"), ",", 1)), "^['\"]+|['\"]+$", "")
    return F.when(name != "", name)


def style_rules(html: Column) -> Column:
    """array<struct<selectors, own>> of all style elements, in page order."""
    css = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    return F.transform(_pairs(css, _RULE, "head", "body"), lambda r: F.struct(F.transform(F.split(F.lower(strip(r["head"])), ","), strip).alias("selectors"), declarations(r["body"]).alias("own")))


def by_rules(pages: DataFrame) -> DataFrame:
    """The pages with ``ruled`` and, for each part of SELECTORS, ``_<part>``: its colour, background and font."""
    own = pages.withColumn("_rules", style_rules(F.coalesce("html", F.lit(""))))
    said = lambda s: F.flatten(F.transform(F.filter("_rules", lambda r: F.array_contains(r["selectors"], s)), lambda r: r["own"]))
    parts = {part: F.coalesce(*[F.when(F.size(said(s)) > 0, said(s)) for s in names], said(names[0])) for part, names in SELECTORS.items()}
    own = own.withColumns({"ruled": F.size("_rules") > 0, **{f"_{part}": own for part, own in parts.items()}})
    looks = {f"_{p}": F.struct(color_of(F.col(f"_{p}"), COLORS.get(p, SIDE)).alias("fg"), color_of(F.col(f"_{p}"), BACKGROUND).alias("bg"), font_of(F.col(f"_{p}")).alias("font")) for p in SELECTORS}
    return own.withColumns(looks).drop("_rules")


def leading(votes: DataFrame, key: str) -> DataFrame:
    """(key, v): the most frequent value of each bucket as a map, of equal ones the first; votes are (key, bucket, value, pos)."""
    counted = votes.groupBy(key, "bucket", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy(key, "bucket").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    return best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("v"))


def inline_votes(pages: DataFrame) -> DataFrame:
    """(page_id, bucket, value, pos) of the styled tags of pages (page_id, html).

    Buckets are accent, text, bg and font, and fg:<part> and bg:<part> of tags and classes. A tag with a quote that is never closed is passed over.
    """
    read = F.regexp_replace(F.coalesce("html", F.lit("")), _UNREAD, "")
    tags = pages.select("page_id", F.posexplode(_pairs(read, _TAG, "name", "rest")).alias("pos", "tag")).where(F.lower("tag.rest").contains("style"))
    listed = tags.select("page_id", "pos", F.lower("tag.name").alias("name"), _pairs(F.col("tag.rest"), _ATTRIBUTE, "k", "v").alias("has"))
    given = lambda k: F.regexp_replace(F.try_element_at(F.filter("has", lambda a: F.lower(a["k"]) == k), F.lit(1))["v"], "^[\"']|[\"']$", "")
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    own = listed.select("page_id", "pos", "name", F.lower(F.coalesce(given("class"), F.lit(""))).alias("classes"), declarations(plain(given("style"))).alias("own")).where("own IS NOT NULL")
    own = own.select("page_id", "pos", "name", "classes", color_of(F.col("own"), ("color",)).alias("fg"), color_of(F.col("own"), BACKGROUND).alias("bg"), font_of(F.col("own")).alias("font"))
    vote = lambda bucket, value: F.struct(bucket.alias("bucket"), F.col(value).alias("value"))
    accent = F.col("name").isin(*ACCENTED) & ~is_gray(F.col("fg"))
    part: Column = F.lit(None).cast("string")
    for tag, name in VOTED_TAGS.items():
        part = F.when(F.col("name") == tag, name).otherwise(part)
    votes = [vote(F.when(accent, "accent").otherwise("text"), "fg"), vote(F.lit("bg"), "bg"), vote(F.lit("font"), "font")]
    votes += [vote(F.concat(F.lit(f"{kind}:"), part), kind) for kind in ("fg", "bg")]
    votes += [vote(F.when(F.contains("classes", F.lit(name)), f"{kind}:{name}"), kind) for name in CLASSES for kind in ("fg", "bg")]
    cast = own.select("page_id", "pos", F.explode(F.filter(F.array(*votes), lambda x: x["value"].isNotNull() & x["bucket"].isNotNull())).alias("x"))
    return cast.select("page_id", "x.bucket", "x.value", "pos")


def _brand(fg: Column, bg: Column) -> Column:
    """The colour that stands for a part: its own, or its background where its own is grey and that is not."""
    return F.when(is_gray(fg) & ~is_gray(bg), bg).otherwise(fg)


def _design(own: DataFrame, kept: list[str], props: dict[str, Column], elements: dict[str, tuple[Column, Column]]) -> DataFrame:
    none = F.lit(None).cast("string")
    all_props = [x for name, value in DEFAULTS.items() for x in (F.lit(name), F.coalesce(props.get(name, none), F.lit(value)))]
    all_parts = [x for name in ELEMENTS for fg, bg in [elements.get(name, (none, none))] for x in (F.lit(name), F.struct(fg.alias("fg"), bg.alias("bg")))]
    return own.select(*kept, F.create_map(*all_props).alias("properties"), F.create_map(*all_parts).alias("elements"))


def page_designs(pages: DataFrame) -> DataFrame:
    """(page_id, origin, properties, elements) of pages (page_id, html): the shape that the theme store keeps.

    origin is "rules" where a page has any style rule, "inline" where tags vote, else "none". A null page is an empty
    one. Rows that share a page_id and have no rule vote together.
    """
    read = by_rules(pages.select("page_id", "html"))
    at = lambda part, what: F.col(f"_{part}.{what}")
    accent = F.when(~is_gray(at("h1", "fg")), at("h1", "fg"))
    props = {"color_bg": at("body", "bg"), "color_text": at("body", "fg"), "font_body": at("body", "font"), "color_accent": accent, "font_heading": at("h1", "font"), "font_mono": at("code", "font"), "color_border": at("border", "fg")}
    props |= {f"color_{p}": _brand(at(p, "fg"), at(p, "bg")) for p in ("entity", "callout", "warning")}
    elements = {p: (at(p, "fg"), at(p, "bg")) for p in (*CLASSES, "quote", "th")} | {"h1": (accent, F.lit(None).cast("string"))}
    ruled = _design(read.where("ruled").withColumn("origin", F.lit("rules")), ["page_id", "origin"], props, elements)

    loose = read.where("NOT ruled").select("page_id", "html")
    own = loose.join(leading(inline_votes(loose), "page_id"), "page_id", "left").withColumn("origin", F.when(F.col("v").isNotNull(), "inline").otherwise("none"))
    won = lambda bucket: F.element_at("v", bucket)
    props = {"color_accent": won("accent"), "color_text": won("text"), "color_bg": won("bg"), "font_body": won("font"), "font_heading": won("font")}
    props |= {f"color_{p}": _brand(won(f"fg:{p}"), won(f"bg:{p}")) for p in ("entity", "callout", "warning")}
    elements = {p: (won(f"fg:{p}"), won(f"bg:{p}")) for p in (*CLASSES, "h1", "h2", "h3", "quote", "th")}
    elements |= {"code": (F.coalesce(won("fg:code"), won("fg:pre")), F.coalesce(won("bg:code"), won("bg:pre"))), "body": (won("text"), F.lit(None).cast("string"))}
    return ruled.unionByName(_design(own, ["page_id", "origin"], props, elements))


def run_designs(runs: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(doc_id, properties, elements) from runs of text (doc_id, par, pos, style, bold, size, color, font, highlight).

    A paragraph is a heading by its style's name, or if any run of it is bold and large. Coloured
    runs of headings vote for the accent, greys left out; other runs vote for the text's colour. What the runs leave open
    comes from ``defaults`` (doc_id, h1_color, h1_font, text_color, text_font, accent1, dark1, light1, page_color), all of which may be null.
    """
    titled = F.coalesce(F.contains(F.lower("style"), F.lit("heading")), F.lit(False)) | F.coalesce(F.col("bold") & (F.col("size") >= LARGE), F.lit(False))
    # ranked by document first: paragraphs, counts and winners then need no further exchange
    own = runs.where("doc_id IS NOT NULL AND par IS NOT NULL").select("doc_id", "par", "pos", titled.alias("titled"), "color", "font", "highlight")
    own = own.withColumn("at", F.rank().over(Window.partitionBy("doc_id").orderBy("par", "pos")))
    own = own.withColumn("head", F.max("titled").over(Window.partitionBy("doc_id", "par"))).withColumn("color", normal_hex(F.col("color")))
    vote = lambda when, bucket, value: F.when(when, F.struct(F.lit(bucket).alias("bucket"), F.col(value).alias("value")))
    votes = F.array(vote(~F.col("head"), "text", "color"), vote(F.col("head") & ~is_gray(F.col("color")), "accent", "color"), vote(F.col("head"), "font_heading", "font"), vote(~F.col("head"), "font_body", "font"), vote(F.lit(True), "highlight", "highlight"))
    cast = own.select("doc_id", "at", F.inline(votes)).where("value <> ''")
    counted = cast.groupBy("doc_id", "bucket", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    most = lambda bucket: F.max(F.when(F.col("bucket") == bucket, F.struct("n", -F.col("first"), "value")))["value"]
    won = counted.groupBy("doc_id").agg(*[most(b).alias(f"_{b}") for b in ("accent", "text", "font_heading", "font_body", "highlight")])
    all_docs = runs.select("doc_id").distinct() if defaults is None else runs.select("doc_id").unionByName(defaults.select("doc_id")).distinct()
    given = ("h1_color", "h1_font", "text_color", "text_font", "accent1", "dark1", "light1", "page_color")
    read = all_docs.join(won, "doc_id", "left")
    read = read.join(defaults.select("doc_id", *given), "doc_id", "left") if defaults is not None else read.select("*", *[F.lit(None).cast("string").alias(c) for c in given])
    v = lambda bucket: F.col(f"_{bucket}")
    hexes = ("h1_color", "text_color", "accent1", "dark1", "light1", "page_color")
    read = read.withColumns({c: normal_hex(F.col(c)) for c in hexes})
    read = read.withColumns({c: F.when(~is_gray(F.col(c)), F.col(c)) for c in ("h1_color", "accent1")})
    read = read.withColumns({"_accent": F.coalesce(v("accent"), F.col("h1_color")), "_text": F.coalesce(v("text"), F.col("text_color"))})
    unset = lambda c, name: F.coalesce(F.col(c), F.lit(DEFAULTS[name])) == DEFAULTS[name]
    own = {"_accent": F.when(unset("_accent", "color_accent"), F.coalesce("accent1", "_accent")).otherwise(F.col("_accent")), "_text": F.when(unset("_text", "color_text"), F.coalesce("dark1", "_text")).otherwise(F.col("_text"))}
    read = read.withColumns(own)
    accent = F.col("_accent")
    props = {"color_accent": accent, "color_text": F.col("_text"), "color_bg": F.coalesce("page_color", "light1"), "font_heading": F.coalesce(v("font_heading"), F.col("h1_font")), "font_body": F.coalesce(v("font_body"), F.col("text_font"))}
    marked: Column = F.lit(None).cast("string")
    for name, color in reversed(HIGHLIGHTS):
        marked = F.when(F.contains(F.upper(v("highlight")), F.lit(name)), color).otherwise(marked)
    return _design(read, ["doc_id"], props, {"h1": (accent, F.lit(None).cast("string")), "callout": (F.lit(None).cast("string"), marked)})


def as_rows(designs: DataFrame, *keys: str) -> DataFrame:
    """(keys, key, value): every property and every colour of an element that is set."""
    row = lambda key, part, value: F.struct(key.alias("key"), F.lit(part).alias("part"), value.alias("value"))
    props = F.transform(F.map_entries("properties"), lambda e: row(e["key"], "", e["value"]))
    parts = F.flatten(F.transform(F.map_entries("elements"), lambda e: F.array(row(e["key"], ".fg", e["value"]["fg"]), row(e["key"], ".bg", e["value"]["bg"]))))
    # keys are joined behind the explosion, as Spark compiles nothing inside of lambdas
    return designs.select(*keys, F.inline(F.concat(props, parts))).where("value IS NOT NULL").select(*keys, F.concat("key", "part").alias("key"), "value")
