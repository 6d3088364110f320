"""Designs of documents: neutral variants, modifiers, properties, element colours, palettes of exports, style sheets, requested themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.color import mixed, with_palette
from foliant.functions.text import font_class, pretty_label

# fixed values: designs of documents without a genre
NEUTRAL = (
    (18.0, 0.42, 0.22, "Fraunces", "Karla", "DM Mono", "italic_label"),
    (78.0, 0.4, 0.2, "Space Grotesk", "Inter", "Roboto Mono", "tracked_upper"),
    (130.0, 0.38, 0.18, "Lora", "Source Sans 3", "DM Mono", "small_caps"),
    (195.0, 0.5, 0.3, "IBM Plex Sans", "IBM Plex Sans", "IBM Plex Mono", "tracked_upper"),
)
STYLE = ("hue", "sat", "energy", "heading_font", "body_font", "mono_font", "label_style")
# fixed values: elements, their text and their ground: a colour's name, or a colour and the share of white in it
ELEMENTS = {
    "h1": ("accent", None), "h2": ("accent", None), "h3": ("text", None), "body": ("text", None), "entity": ("entity", ("entity", 0.92)), "callout": ("callout", ("callout", 0.92)),
    "warning": ("warning", ("warning", 0.93)), "timeline": ("accent", None), "quote": ("entity", None), "th": ("bg", ("accent", 0.0)), "code": ("text", ("accent", 0.92)),
}


def neutral(docs: DataFrame, seed: Column) -> DataFrame:
    """docs with the style of the neutral variant that a seed of 0..1 picks; genre is "neutral"."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, STYLE, strict=True)]) for row in NEUTRAL])
    own = docs.withColumn("_v", F.element_at(rows, F.pmod(F.floor(seed * len(NEUTRAL)), F.lit(len(NEUTRAL))).cast("int") + 1))
    return own.select("*", F.lit("neutral").alias("genre"), "_v.*").drop("_v")


def modified(styles: DataFrame) -> DataFrame:
    """styles (hue, sat, energy, genre) under a modifier, whose columns are null where there is none.

    Its name, shift, sat_mult and energy_mult are modifier, hue_shift, sat_mult and
    energy_mult. It does not apply to neutral styles, nor where the genre's last part names it.
    """
    leaf = F.lower(F.substring_index("genre", "/", -1))
    applies = F.col("modifier").isNotNull() & (F.col("genre") != "neutral") & ~F.contains(leaf, F.col("modifier"))
    clamp = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(0.85), x))
    return styles.withColumn("_on", F.coalesce(applies, F.lit(False))).withColumns({
        "hue": F.when(F.col("_on"), F.pmod(F.col("hue") + F.coalesce("hue_shift", F.lit(0.0)) + 360, F.lit(360.0))).otherwise(F.col("hue")),
        "sat": F.when(F.col("_on"), clamp(F.col("sat") * F.coalesce("sat_mult", F.lit(1.0)), 0.12)).otherwise(F.col("sat")),
        "energy": F.when(F.col("_on"), clamp(F.col("energy") * F.coalesce("energy_mult", F.lit(1.0)), 0.05)).otherwise(F.col("energy")),
        "modifier": F.when(F.col("_on"), F.col("modifier")),
    }).drop("_on", "hue_shift", "sat_mult", "energy_mult")


def assembled(styles: DataFrame) -> DataFrame:
    """styles (STYLE, genre, modifier, seed, second_hue, quotes) with palette, label, line height, radius and width."""
    label = pretty_label(F.col("genre"))
    return with_palette(styles).withColumns({
        "label": F.when(F.col("modifier").isNotNull(), F.concat(label, F.lit(" ["), "modifier", F.lit("]"))).otherwise(label),
        "line_height": F.when(F.col("dark_bg"), "1.75").otherwise("1.7"),
        "border_radius": F.when(F.col("label_style").isin("tracked_upper", "small_caps"), "3px").otherwise("8px"),
        "max_width": F.when(F.col("quotes") > 2, "760px").otherwise("820px"),
        "big_quotes": F.col("quotes") >= 2,
    })


def elements(designs: DataFrame) -> DataFrame:
    """(doc_id, element, fg, bg): literal colours of each kind of element."""

    def ground(spec: tuple[str, float] | None) -> Column:
        return F.lit(None).cast("string") if spec is None else mixed(F.col(f"color_{spec[0]}"), 255, spec[1])

    rows = F.array(*[F.struct(F.lit(n).alias("element"), F.col(f"color_{fg}").alias("fg"), ground(bg).alias("bg")) for n, (fg, bg) in ELEMENTS.items()])
    return designs.select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.*")


def slide_palette(designs: DataFrame) -> DataFrame:
    """The colours of slides, without #, and their fonts."""
    bare = {n: F.upper(F.ltrim(F.col(f"color_{n}"), F.lit("#"))) for n in ("bg", "text", "accent", "entity", "callout", "border", "warning")}
    dark = F.col("dark_bg")
    ink = F.lit("1A1A2E")
    return designs.select(
        "doc_id", bare["bg"].alias("bg"), F.when(dark, bare["text"]).otherwise(ink).alias("dark"), bare["accent"].alias("primary"), bare["entity"].alias("secondary"), bare["callout"].alias("accent"), bare["border"].alias("muted"),
        F.when(dark, "FFFFFF").otherwise(bare["text"]).alias("text_dark"), F.when(dark, ink).otherwise(bare["text"]).alias("text_light"), bare["bg"].alias("card"), bare["border"].alias("card2"), bare["warning"].alias("warn"),
        bare["callout"].alias("success"), F.col("heading_font").alias("font_h"), F.col("body_font").alias("font_b"),
    )


def page_palette(designs: DataFrame) -> DataFrame:
    """The colours of written documents with # and the classes of their fonts."""
    return designs.select("doc_id", *[F.col(f"color_{n}").alias(n) for n in ("bg", "accent", "text", "entity", "callout", "warning", "border")], font_class(F.col("heading_font")).alias("heading_class"), font_class(F.col("body_font")).alias("body_class"))


def style_sheet(designs: DataFrame) -> DataFrame:
    """(doc_id, css): a design as a style sheet: variables, then one rule for each element."""
    names = ("bg", "text", "accent", "entity", "callout", "warning", "border", "tertiary")
    root = F.concat(F.lit(":root { "), F.concat_ws(" ", *[F.concat(F.lit(f"--{n}: "), F.col(f"color_{n}"), F.lit(";")) for n in names]), F.lit(" }"))
    page = F.concat(F.lit("body { font-family: '"), "body_font", F.lit("'; line-height: "), "line_height", F.lit("; max-width: "), "max_width", F.lit("; }"))
    ground = F.when(F.col("bg").isNotNull(), F.concat(F.lit(" background: "), "bg", F.lit(";"))).otherwise("")
    rule = F.concat("element", F.lit(" { color: "), "fg", F.lit(";"), ground, F.lit(" }"))
    rules = elements(designs).select("doc_id", "element", rule.alias("rule")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "rule"))), lambda e: e["rule"]), "\n").alias("rules"))
    return designs.select("doc_id", root.alias("root"), page.alias("page")).join(rules, "doc_id").select("doc_id", F.concat_ws("\n", "root", "page", "rules").alias("css"))


def resolved_themes(requests: DataFrame, builtin: DataFrame, custom: DataFrame, default: str = "academic") -> DataFrame:
    """requests (theme, css; both may be null) with the theme that is used and where its style comes from.

    Given CSS, "auto" and built-in ids stay; a custom id brings its own style sheet; anything
    else falls back to the default.
    """
    known = builtin.select(F.col("id").alias("_builtin")).distinct()
    own = custom.select(F.col("id").alias("_custom")).distinct()
    joined = requests.join(known, F.col("theme") == F.col("_builtin"), "left").join(own, F.col("theme") == F.col("_custom"), "left")
    origin = F.when(F.col("css") != "", "given").when(F.col("theme") == "auto", "auto").when(F.col("_builtin").isNotNull(), "builtin").when(F.col("_custom").isNotNull(), "custom").otherwise("default")
    used = F.when(origin == "custom", "custom:").when(origin == "default", default).otherwise(F.col("theme"))
    return joined.withColumns({"origin": origin, "used": used}).drop("_builtin", "_custom")


def label_spans(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, html): a document's own labels at the start of its paragraphs as spans, the longest label first.

    pages is (doc_id, html), labels (doc_id, label) of capital letters, spaces and / ' -. The
    pattern's second form asks for one more > behind a name's opening tag, so a label right
    behind that tag is not marked; results must be the same there.
    """
    own = labels.distinct().groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("label")).alias("n"), "label"))), lambda e: e["label"]), "|").alias("any"))
    pattern = F.concat(F.lit(r'(<(?:p|div class="entity-name">)[^>]*>)('), "any", F.lit(r")(\s)"))
    marked = F.regexp_replace("html", pattern, F.lit('$1<span class="auto-label">$2</span>$3'))
    return pages.join(own, "doc_id", "left").select("doc_id", F.when(F.col("any").isNotNull(), marked).otherwise(F.col("html")).alias("html"))


def last_wins(*tables: DataFrame, key: str = "key") -> DataFrame:
    """Tables of one schema as one; of rows with one key that of the last table stays."""
    every = tables[0].withColumn("_from", F.lit(0))
    for k, more in enumerate(tables[1:], 1):
        every = every.unionByName(more.withColumn("_from", F.lit(k)))
    w = Window.partitionBy(key).orderBy(F.desc("_from"))
    return every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_from")
