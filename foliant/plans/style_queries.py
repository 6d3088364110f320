"""Queries on designs, themes, images and ornaments, with SQL written apart from the code it checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import color as C
from foliant.functions import text as X
from foliant.operators import decoration as O
from foliant.operators import design as A
from foliant.operators import images as I
from foliant.operators import lexicon as L
from foliant.plans import design_queries as G
from foliant.session import table
from foliant.sources import lexicon as D
from foliant.sources import themes as TH


def _designs(spark, sf_dir):
    """A design for every document: its blended genre or a neutral variant, its modifier, its palette."""
    text = F.coalesce("text", F.lit(""))
    docs = G.texts(spark, sf_dir).select("doc_id", C.seed_unit(text).alias("seed"), C.seed_unit(F.reverse(text)).alias("back"), (F.col("doc_id") % 4).alias("quotes"))
    genres = G.genre_blend(spark, sf_dir).withColumnRenamed("label", "genre")
    known = docs.join(genres, "doc_id").select("doc_id", "seed", "quotes", "genre", "hue", "sat", "energy", F.lit("Cinzel").alias("heading_font"), "body_font", F.lit("DM Mono").alias("mono_font"), F.lit("italic_label").alias("label_style"))
    plain = A.neutral(docs.join(genres, "doc_id", "left_anti"), F.col("back")).drop("back")
    mods = spark.createDataFrame([(n, *rest) for _, n, _, *rest in D.MODIFIERS], "modifier string, hue_shift double, sat_mult double, energy_mult double")
    picks = G.modifier_pick(spark, sf_dir).select("doc_id", F.col("key").alias("modifier"))
    own = known.unionByName(plain).join(picks, "doc_id", "left").join(F.broadcast(mods), "modifier", "left")
    return A.assembled(A.modified(own).withColumn("second_hue", F.when(F.col("doc_id") % 3 == 0, F.col("hue") / 2)))


def design_assembly(spark, sf_dir):
    return _designs(spark, sf_dir).select("doc_id", "label", "modifier", "dark_bg", *[f"color_{n}" for n in C.COLORS], "heading_font", "body_font", "line_height", "border_radius", "max_width", "big_quotes")


def element_colors(spark, sf_dir):
    return A.elements(_designs(spark, sf_dir))


def slide_palettes(spark, sf_dir):
    return A.slide_palette(_designs(spark, sf_dir))


def page_palettes(spark, sf_dir):
    return A.page_palette(_designs(spark, sf_dir))


def style_sheets(spark, sf_dir):
    return A.style_sheet(_designs(spark, sf_dir))


def theme_requests(spark, sf_dir):
    """Requests of customers: built-in ids, "auto", ids of custom themes, unknown ids, none, and given CSS."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    theme = F.when(k == 0, "noir").when(k == 1, "auto").when(k == 2, F.lower("n_name")).when(k == 3, "nowhere").when(k == 4, F.lower("c_mktsegment"))
    asked = c.select("c_custkey", theme.alias("theme"), F.when(F.col("c_custkey") % 7 == 0, "p {}").otherwise("").alias("css"))
    custom = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("id"))
    return A.resolved_themes(asked, TH.builtin(spark), custom).select("c_custkey", "origin", "used")


def ornaments(spark, sf_dir):
    """The style, the margin motif and the density asked for by parts."""
    k = F.col("p_partkey")
    asked = F.element_at(F.array(*map(F.lit, ("royal", "auto", "nothing", "dots", "music"))), (k % 5 + 1).cast("int"))
    found = F.when(k % 3 == 0, "leaf")
    many = F.element_at(F.array(*map(F.lit, ("3", " 9 ", "-4", "x", "", "1.5", "0"))), (k % 7 + 1).cast("int"))
    own = table(spark, sf_dir, "part").select("p_partkey", O.resolved_style(asked, found).alias("style"), X.density(many).alias("density"))
    return own.withColumn("motif", X.margin_motif(O.glyph(F.col("style"))))


def image_fields(spark, sf_dir):
    """Sources, alternative texts and captions of parts in all their states, resolved."""
    k = F.col("p_partkey")
    alt = F.when(k % 9 == 1, "").when(k % 9 == 2, "Image 12").when(k % 9 == 3, "img").when(k % 9 == 4, F.col("p_name")).when(k % 9 == 5, "photo-7.PNG").when(k % 9 == 6, " abc ").when(k % 9 == 7, F.concat(F.lit(" <b> "), "p_brand", F.lit(" Chart"))).when(k % 9 == 8, "screenshot")
    caption = F.when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit("A **map** of "), "p_type")).when(k % 4 == 3, "Company Logo & more")
    src = F.when(k % 5 == 1, I.to_data_uri(F.encode("p_name", "UTF-8"), F.lit(".GIF"))).when(k % 5 == 2, " data:image/webp;base64,!! ").when(k % 5 > 2, "img/x.png")
    content = F.when(k % 3 == 0, F.lit("img/x.png")).when(k % 3 == 1, F.col("p_name"))
    own = table(spark, sf_dir, "part").select("p_partkey", content.alias("content"), src.alias("src"), alt.alias("alt"), caption.alias("caption"))
    data, ending = I.from_data_uri(F.col("src"))
    extra = own.select("*", I.alt_says_something(F.col("alt")).alias("says"), I.caption_or_number(F.col("alt"), k).alias("label"), I.is_data_uri(F.col("src")).alias("embedded"), F.decode(data, "UTF-8").alias("data"), ending.alias("ending"))
    return I.resolved(extra).drop("content")


def font_classes(spark, sf_dir):
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, ("DM Mono", "Source Serif 4", "Inter", "EB Garamond", "Courier Prime", "Karla"))), k)
    return table(spark, sf_dir, "part").select("p_partkey", X.font_class(F.when(F.col("p_partkey") % 5 > 0, name)).alias("font"))


def hex_forms(spark, sf_dir):
    """Colours with and without #, of three, six and other lengths; and as rgba."""
    k = F.col("p_partkey")
    digits = F.substring(F.md5("p_name"), 1, 6)
    given = F.when(k % 4 == 0, F.concat(F.lit(" #"), digits)).when(k % 4 == 1, F.substring(digits, 1, 3)).when(k % 4 == 2, digits).otherwise(F.concat(F.lit("#"), F.substring(digits, 1, 4)))
    return table(spark, sf_dir, "part").select("p_partkey", X.normal_hex(given).alias("hex"), C.rgba(F.concat(F.lit("#"), digits), F.lit("0.4")).alias("rgba"))


def mark_repairs(spark, sf_dir):
    """Private-use marks at the start of and within names."""
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, "\ue0b7  ").otherwise(""), "p_name", F.when(k % 3 == 0, " \uf8ff\ue000x").otherwise(" y"))
    return table(spark, sf_dir, "part").select("p_partkey", X.without_private_marks(text).alias("clean"))


def html_labels(spark, sf_dir):
    """Labels of parts, one within another, marked where a paragraph begins with them."""
    p = table(spark, sf_dir, "part")
    html = F.concat(F.lit('<p class="a">CORE RULE of '), "p_name", F.lit('</p><div class="entity-name">CORE held</div><p>not CORE</p><p>'), F.upper("p_brand"), F.lit("</p><p>FATAL-FLAW now</p>"))
    k = F.col("p_partkey")
    labels = p.where("p_partkey % 4 <> 0").select(k.alias("doc_id"), F.explode(F.when(k % 2 == 0, F.array(F.lit("CORE"), F.lit("CORE RULE"))).otherwise(F.array(F.lit("FATAL-FLAW"), F.lit("CORE")))).alias("label"))
    return A.label_spans(p.select(k.alias("doc_id"), html.alias("html")), labels)


def missing_icons(spark, sf_dir):
    """Icons that types of parts ask for and names of parts do not have."""
    p = table(spark, sf_dir, "part")
    wanted = p.select(F.explode(F.split(F.lower("p_type"), r"\s+")).alias("icon")).distinct()
    return wanted.join(p.select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("icon")).distinct(), "icon", "left_anti")


def dictionary_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"))
    return A.last_wins(nation, table(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).cast("long").alias("key"), F.col("r_name").alias("value")))


QUERIES = {
    f.__name__: f
    for f in (
        design_assembly, element_colors, slide_palettes, page_palettes, style_sheets, theme_requests, ornaments, image_fields, font_classes, hex_forms, mark_repairs, html_labels, missing_icons, dictionary_union,
    )
}

_SEED = "(concat('0x', substr(md5(substr({x}, 1, 2000)), 1, 8))::UBIGINT / 4294967295.0::DOUBLE)"


def _hex(h: str, s: str, light: str) -> str:
    return "'#' || " + " || ".join(
        f"printf('%02X', floor((({light}) - ({s}) * least({light}, 1 - ({light})) * greatest(-1.0, least((({k} + ({h}) / 30) % 12) - 3, 9 - (({k} + ({h}) / 30) % 12), 1.0))) * 255 + 0.5)::INT)" for k in (0, 8, 4)
    )


def _both(dark: tuple[str, str, str], light: tuple[str, str, str]) -> str:
    return f"CASE WHEN dark_bg THEN {_hex(*dark)} ELSE {_hex(*light)} END"


_DESIGNS = f"""WITH docs AS (SELECT doc_id, {_SEED.format(x="coalesce(text, '')")} AS seed, {_SEED.format(x="reverse(coalesce(text, ''))")} AS back, doc_id % 4 AS quotes FROM documents),
blend AS (SELECT * FROM ({G.SQL['genre_blend']})), mods AS (SELECT * FROM ({G.SQL['modifier_pick']})),
variant AS (SELECT * FROM (VALUES (0, 18.0::DOUBLE, 0.42::DOUBLE, 0.22::DOUBLE, 'Fraunces', 'Karla', 'italic_label'), (1, 78.0, 0.4, 0.2, 'Space Grotesk', 'Inter', 'tracked_upper'), (2, 130.0, 0.38, 0.18, 'Lora', 'Source Sans 3', 'small_caps'),
  (3, 195.0, 0.5, 0.3, 'IBM Plex Sans', 'IBM Plex Sans', 'tracked_upper')) AS v(k, hue, sat, energy, heading_font, body_font, label_style)),
base AS (SELECT d.doc_id, seed, quotes, b.label AS genre, hue, sat, energy, 'Cinzel' AS heading_font, body_font, 'italic_label' AS label_style FROM docs d JOIN blend b ON b.doc_id = d.doc_id
  UNION ALL SELECT d.doc_id, seed, quotes, 'neutral', v.hue, v.sat, v.energy, v.heading_font, v.body_font, v.label_style FROM docs d JOIN variant v ON v.k = floor(back * 4)::INT % 4 WHERE d.doc_id NOT IN (SELECT doc_id FROM blend)),
modi AS (SELECT b.* REPLACE (CASE WHEN f.key IS NULL THEN hue ELSE (hue + shift + 360) % 360 END AS hue, CASE WHEN f.key IS NULL THEN sat ELSE greatest(0.12, least(0.85, sat * sm)) END AS sat, CASE WHEN f.key IS NULL THEN energy ELSE greatest(0.05, least(0.85, energy * em)) END AS energy), f.key AS modifier
  FROM base b LEFT JOIN (SELECT m.doc_id, m.key, shift, sm, em FROM mods m JOIN (VALUES ('bright', 10.0::DOUBLE, 1.2::DOUBLE, 0.8::DOUBLE), ('stark', -20.0, 0.6, 1.3), ('warm', 15.0, 1.1, 0.9)) AS t(key, shift, sm, em) ON t.key = m.key) f
  ON f.doc_id = b.doc_id AND b.genre <> 'neutral' AND NOT contains(lower(regexp_extract(b.genre, '([^/]*)$', 1)), f.key)),
pre AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN hue / 2 END AS hue2, (hue + (seed - 0.5) * 30 + 360) % 360 AS h, greatest(0.15, least(0.8, sat * (0.82 + seed * 0.4))) AS s,
  CASE WHEN energy >= 0.6 THEN true WHEN energy <= 0.28 THEN false ELSE seed < (energy - 0.28) / 0.32 END AS dark_bg FROM modi),
cor AS (SELECT *, CASE WHEN h BETWEEN 50 AND 160 THEN -0.05 WHEN h BETWEEN 220 AND 280 THEN 0.03 ELSE 0.0 END::DOUBLE AS c, coalesce(hue2, h + 195) % 360 AS t FROM pre),
designs AS (SELECT *, {_both(('h', 'least(s * 0.55, 0.42)', '0.07 + c * 0.3 + seed * 0.03'), ('h', 'least(s * 0.4, 0.32)', '0.955 + c * 0.15 - seed * 0.02'))} AS color_bg,
  {_both(('h', 'least(s * 0.18, 0.14)', '0.90 + c'), ('h', 'least(s * 0.25, 0.2)', '0.15 - c * 0.3'))} AS color_text, {_both(('h', 'least(s * 0.4, 0.32)', '0.24::DOUBLE'), ('h', 'least(s * 0.35, 0.26)', '0.82::DOUBLE'))} AS color_border,
  {_both(('h', '0.12::DOUBLE', '0.58::DOUBLE'), ('h', '0.15::DOUBLE', '0.44::DOUBLE'))} AS color_muted, {_both(('h', 'least(s + 0.2, 0.92)', '0.60 + c'), ('h', 'least(s + 0.12, 0.85)', '0.40 + c * 0.5'))} AS color_accent,
  {_both(('(h + 42) % 360', 'least(s + 0.15, 0.85)', '0.62::DOUBLE'), ('(h + 42) % 360', 'least(s + 0.08, 0.75)', '0.36::DOUBLE'))} AS color_entity,
  {_both(('(h + 108) % 360', 'least(s + 0.1, 0.7)', '0.48::DOUBLE'), ('(h + 108) % 360', 'least(s + 0.05, 0.6)', '0.30::DOUBLE'))} AS color_callout,
  {_both(('8.0::DOUBLE', '0.68::DOUBLE', '0.58::DOUBLE'), ('8.0::DOUBLE', '0.62::DOUBLE', '0.44::DOUBLE'))} AS color_warning, {_both(('t', 'least(s + 0.1, 0.75)', '0.58::DOUBLE'), ('t', 'least(s + 0.08, 0.7)', '0.38::DOUBLE'))} AS color_tertiary,
  list_transform(string_split(genre, ' + '), lambda p: CASE WHEN contains(p, '/') THEN regexp_extract(p, '^[^/]*/(.*)$', 1) || ' (' || split_part(p, '/', 1) || ')' ELSE p END) AS parts FROM cor)"""


def _light(color: str, share: float) -> str:
    return "'#' || " + " || ".join(f"printf('%02X', floor(concat('0x', substr(color_{color}, {2 + 2 * k}, 2))::INT + (255 - concat('0x', substr(color_{color}, {2 + 2 * k}, 2))::INT) * {share}::DOUBLE)::INT)" for k in range(3))


_ELEMENTS = f"""(SELECT doc_id, unnest([{{'element': 'h1', 'fg': color_accent, 'bg': NULL::VARCHAR}}, {{'element': 'h2', 'fg': color_accent, 'bg': NULL}}, {{'element': 'h3', 'fg': color_text, 'bg': NULL}}, {{'element': 'body', 'fg': color_text, 'bg': NULL}},
  {{'element': 'entity', 'fg': color_entity, 'bg': {_light('entity', 0.92)}}}, {{'element': 'callout', 'fg': color_callout, 'bg': {_light('callout', 0.92)}}}, {{'element': 'warning', 'fg': color_warning, 'bg': {_light('warning', 0.93)}}},
  {{'element': 'timeline', 'fg': color_accent, 'bg': NULL}}, {{'element': 'quote', 'fg': color_entity, 'bg': NULL}}, {{'element': 'th', 'fg': color_bg, 'bg': color_accent}}, {{'element': 'code', 'fg': color_text, 'bg': {_light('accent', 0.92)}}}], recursive := true) FROM designs)"""
_FONT = "CASE WHEN regexp_matches(lower({x}), 'mono|courier|consolas') THEN 'mono' WHEN regexp_matches(lower({x}), 'serif|fraunces|cinzel|playfair|lora|crimson|georgia|garamond|baskerville|merriweather|times') THEN 'serif' ELSE 'sans' END"
_ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
SQL = {
    "design_assembly": _DESIGNS + """ SELECT doc_id, array_to_string(parts, ' + ') || coalesce(' [' || modifier || ']', '') AS label, modifier, dark_bg, color_bg, color_text, color_border, color_muted, color_accent, color_entity, color_callout, color_warning, color_tertiary,
    heading_font, body_font, CASE WHEN dark_bg THEN '1.75' ELSE '1.7' END AS line_height, CASE WHEN label_style IN ('tracked_upper', 'small_caps') THEN '3px' ELSE '8px' END AS border_radius, CASE WHEN quotes > 2 THEN '760px' ELSE '820px' END AS max_width, quotes >= 2 AS big_quotes FROM designs""",
    "element_colors": _DESIGNS + f" SELECT doc_id, element, fg, bg FROM {_ELEMENTS}",
    "slide_palettes": _DESIGNS + """ SELECT doc_id, color_bg[2:] AS bg, CASE WHEN dark_bg THEN color_text[2:] ELSE '1A1A2E' END AS dark, color_accent[2:] AS "primary", color_entity[2:] AS secondary, color_callout[2:] AS accent, color_border[2:] AS muted, CASE WHEN dark_bg THEN 'FFFFFF' ELSE color_text[2:] END AS text_dark,
    CASE WHEN dark_bg THEN '1A1A2E' ELSE color_text[2:] END AS text_light, color_bg[2:] AS card, color_border[2:] AS card2, color_warning[2:] AS warn, color_callout[2:] AS success, heading_font AS font_h, body_font AS font_b FROM designs""",
    "page_palettes": _DESIGNS + f" SELECT doc_id, color_bg AS bg, color_accent AS accent, color_text AS text, color_entity AS entity, color_callout AS callout, color_warning AS warning, color_border AS border, {_FONT.format(x='heading_font')} AS heading_class, {_FONT.format(x='body_font')} AS body_class FROM designs",
    "style_sheets": _DESIGNS + f""", r AS (SELECT doc_id, string_agg(element || ' {{ color: ' || fg || ';' || coalesce(' background: ' || bg || ';', '') || ' }}', chr(10) ORDER BY element) AS rules FROM {_ELEMENTS} GROUP BY doc_id)
    SELECT d.doc_id, ':root {{ --bg: ' || color_bg || '; --text: ' || color_text || '; --accent: ' || color_accent || '; --entity: ' || color_entity || '; --callout: ' || color_callout || '; --warning: ' || color_warning || '; --border: ' || color_border || '; --tertiary: ' || color_tertiary || '; }}' || chr(10)
    || 'body {{ font-family: ''' || body_font || '''; line-height: ' || CASE WHEN dark_bg THEN '1.75' ELSE '1.7' END || '; max-width: ' || CASE WHEN quotes > 2 THEN '760px' ELSE '820px' END || '; }}' || chr(10) || rules AS css FROM designs d JOIN r ON r.doc_id = d.doc_id""",
    "theme_requests": """WITH q AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'noir' WHEN 1 THEN 'auto' WHEN 2 THEN lower(n_name) WHEN 3 THEN 'nowhere' WHEN 4 THEN lower(c_mktsegment) END AS theme, c_custkey % 7 = 0 AS given FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT c_custkey, theme, CASE WHEN given THEN 'given' WHEN theme = 'auto' THEN 'auto' WHEN theme IN ('academic', 'codex', 'corporate', 'detective', 'magazine', 'manuscript', 'minimalist', 'museum', 'newspaper', 'noir', 'research', 'scientific', 'startup') THEN 'builtin'
      WHEN theme IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 2 = 0) THEN 'custom' ELSE 'default' END AS origin FROM q)
    SELECT c_custkey, origin, CASE origin WHEN 'custom' THEN 'custom:' WHEN 'default' THEN 'academic' ELSE theme END AS used FROM o""",
    "ornaments": """WITH p AS (SELECT p_partkey, (['royal', 'auto', 'nothing', 'dots', 'music'])[p_partkey % 5 + 1] AS a, ([3, 4, 0, 2, 2, 2, 0])[p_partkey % 7 + 1] AS density FROM part),
    s AS (SELECT p_partkey, CASE WHEN a IN ('royal', 'dots', 'music') THEN a WHEN p_partkey % 3 = 0 THEN 'leaf' ELSE 'sparkle' END AS style, density FROM p)
    SELECT *, '───  ' || CASE style WHEN 'royal' THEN '♛' WHEN 'dots' THEN '⁘' WHEN 'music' THEN '♪' WHEN 'leaf' THEN '☘' ELSE '✦' END || chr(65038) || '  ───' AS motif FROM s""",
    "image_fields": f"""WITH p AS (SELECT p_partkey AS k, p_name, CASE p_partkey % 9 WHEN 1 THEN '' WHEN 2 THEN 'Image 12' WHEN 3 THEN 'img' WHEN 4 THEN p_name WHEN 5 THEN 'photo-7.PNG' WHEN 6 THEN ' abc ' WHEN 7 THEN ' <b> ' || p_brand || ' Chart' WHEN 8 THEN 'screenshot' END AS a,
      CASE p_partkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'A **map** of ' || p_type WHEN 3 THEN 'Company Logo & more' END AS c, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'data:image/gif;base64,' || to_base64(p_name::BLOB) WHEN 2 THEN ' data:image/webp;base64,!! ' ELSE 'img/x.png' END AS s,
      CASE p_partkey % 3 WHEN 0 THEN 'img/x.png' WHEN 1 THEN p_name END AS t FROM part),
    e AS (SELECT *, k % 9 IN (4, 7) AS says, coalesce(nullif(trim(a), ''), 'Image ' || k) AS label, k % 5 IN (1, 2) AS embedded, CASE WHEN k % 5 = 1 THEN p_name END AS data, CASE WHEN k % 5 = 1 THEN '.gif' END AS ending, coalesce(s, t, '') AS src2 FROM p),
    f AS (SELECT *, CASE WHEN coalesce(c, '') = '' AND t <> src2 THEN t ELSE coalesce(c, '') END AS c2 FROM e), g AS (SELECT *, CASE WHEN coalesce(a, '') <> '' THEN a WHEN c2 <> '' THEN c2 ELSE 'Image' END AS a2 FROM f),
    h AS (SELECT *, CASE WHEN regexp_matches(lower(c2 || ' ' || a2), 'icon|logo|thumbnail') THEN 'small' WHEN regexp_matches(lower(c2 || ' ' || a2), 'diagram|chart|screenshot|panorama|map') THEN 'wide' ELSE '' END AS size_class FROM g)
    SELECT k AS p_partkey, src2 AS src, a2 AS alt, c2 AS caption, says, label, embedded, data, ending, size_class, CASE WHEN src2 = '' THEN '' ELSE '<figure class="figure' || CASE WHEN size_class <> '' THEN ' figure-' || size_class ELSE '' END || '"><img src="' || src2 || '" alt="' || {_ESC.format(x='a2')}
      || '" loading="lazy">' || CASE WHEN c2 <> '' THEN '<figcaption>' || replace({_ESC.format(x='c2')}, '**map**', '<strong>map</strong>') || '</figcaption>' ELSE '' END || '</figure>' END AS figure FROM h""",
    "font_classes": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'sans' ELSE (['mono', 'serif', 'sans', 'serif', 'mono', 'sans'])[p_partkey % 6 + 1] END AS font FROM part",
    "hex_forms": """WITH d AS (SELECT p_partkey, upper(substr(md5(p_name), 1, 6)) AS h FROM part) SELECT p_partkey, '#' || CASE p_partkey % 4 WHEN 1 THEN repeat(h[1], 2) || repeat(h[2], 2) || repeat(h[3], 2) WHEN 3 THEN h[1:4] ELSE h END AS hex,
    'rgba(' || concat('0x', h[1:2])::INT || ', ' || concat('0x', h[3:4])::INT || ', ' || concat('0x', h[5:6])::INT || ', 0.4)' AS rgba FROM d""",
    "mark_repairs": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '- ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE ' y' END AS clean FROM part",
    "html_labels": """WITH s AS (SELECT p_partkey AS k, p_name, upper(p_brand) AS b, '<span class="auto-label">' AS o, '</span>' AS c FROM part)
    SELECT k AS doc_id, '<p class="a">' || CASE WHEN k % 4 = 0 THEN 'CORE RULE' WHEN k % 2 = 0 THEN o || 'CORE RULE' || c ELSE o || 'CORE' || c || ' RULE' END || ' of ' || p_name || '</p><div class="entity-name">CORE held</div><p>not CORE</p><p>'
    || b || '</p><p>' || CASE WHEN k % 2 = 1 THEN o || 'FATAL-FLAW' || c ELSE 'FATAL-FLAW' END || ' now</p>' AS html FROM s""",
    "missing_icons": "SELECT DISTINCT w AS icon FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS w FROM part) EXCEPT SELECT unnest(string_split(lower(p_name), ' ')) FROM part",
    "dictionary_union": "SELECT n_nationkey::BIGINT AS key, n_name AS value FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 7 FROM region) UNION ALL SELECT r_regionkey * 7, r_name FROM region",
}
