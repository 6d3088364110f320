"""Decoration: moods of a document's opening blocks, ornaments and their glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Moods and their words, our own; the first mood wins among equals.
MOODS = (("royal", "crown king queen iron keep"), ("nature", "north garden leaf sea"), ("study", "analysis results research evidence data"), ("magic", "magic quest world mira"))
FALLBACKS = ("dots", "lines", "waves")


# fixed values: the styles of ornaments and the glyph of each
STYLES = {
    "sparkle": "✦", "botanical": "❦", "star": "✺", "diamond": "◆", "flourish": "⚜", "celebration": "✹", "elegant": "❃", "vintage": "☙", "celestial": "☆", "moonlit": "☾", "nature": "❀", "leaf": "☘", "snow": "❆", "holiday": "❄",
    "spooky": "☾", "gothic": "†", "nautical": "⚓", "adventure": "⚔", "royal": "♛", "hearts": "♥", "academic": "❧", "minimal": "•", "geometric": "◆", "cosmic": "✷", "music": "♪", "crown": "♔", "lightning": "⚡", "infinity": "∞",
    "clover": "❁", "gem": "♢", "scroll": "❊", "dots": "⁘", "asterism": "⁂", "target": "◎", "cross": "✚",
}
DEFAULT_STYLE = "sparkle"


def resolved_style(requested: Column, found: Column) -> Column:
    """A known style that is asked for; else the one found for the document; else the default."""
    return F.when(requested.isin(*STYLES), requested).otherwise(F.coalesce(found, F.lit(DEFAULT_STYLE)))


def glyph(style: Column) -> Column:
    mark: Column = F.lit(STYLES[DEFAULT_STYLE])
    for name, own in STYLES.items():
        mark = F.when(style == name, own).otherwise(mark)
    return mark


def mood(blocks: DataFrame, opening: int = 40) -> DataFrame:
    """(doc_id, mood): the mood with most words in the first blocks, or none of score 0."""
    words = blocks.where(F.col("seq") < opening).select("doc_id", F.explode(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+")).alias("w"))
    place, order = F.lit(None), F.lit(None)
    for k, (name, ws) in enumerate(MOODS):
        place = F.when(F.col("w").isin(*ws.split()), name).otherwise(place)
        order = F.when(F.col("w").isin(*ws.split()), k).otherwise(order)
    by = words.select("doc_id", place.alias("mood"), order.alias("k")).where("mood IS NOT NULL").groupBy("doc_id", "mood", "k").agg(F.count("*").alias("n"))
    return by.groupBy("doc_id").agg(F.max_by("mood", F.struct("n", -F.col("k"))).alias("mood"))


def fallback(docs: DataFrame) -> DataFrame:
    """(doc_id, style): a style from the checksum of a document's name."""
    return docs.select("doc_id", F.element_at(F.array(*map(F.lit, FALLBACKS)), (F.crc32(F.col("name").cast("binary")) % len(FALLBACKS)).cast("int") + 1).alias("style"))
