"""Fields of images: sources, alternative texts, captions, size classes and data URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import html_escaped, inline_html, strip

# fixed values: file endings and their media types, the first ending of a type stands for it
MEDIA_TYPES = ((".png", "image/png"), (".jpeg", "image/jpeg"), (".jpg", "image/jpeg"), (".gif", "image/gif"), (".webp", "image/webp"), (".bmp", "image/bmp"))
GENERIC_ALT = r"(?i)^(?:image|picture|photo|img|graphic|untitled|screenshot)\s*\d*$"
FILE_ALT = r"(?i)^[\p{L}\p{N}_-]+\.(?:png|jpe?g|gif|webp|bmp)$"
DATA_URI = r"(?s)^data:([\p{L}\p{N}_/+.-]+);base64,(.+)$"
SMALL, WIDE = "icon|logo|thumbnail", "diagram|chart|screenshot|panorama|map"


def alt_says_something(alt: Column) -> Column:
    """Whether a text was written for an image: four characters at least, no placeholder, no file name."""
    own = strip(F.coalesce(alt, F.lit("")))
    return (F.length(own) >= 4) & ~own.rlike(GENERIC_ALT) & ~own.rlike(FILE_ALT)


def caption_or_number(alt: Column, number: Column) -> Column:
    own = strip(F.coalesce(alt, F.lit("")))
    return F.when(own != "", own).otherwise(F.concat(F.lit("Image "), number.cast("string")))


def is_data_uri(x: Column) -> Column:
    return F.startswith(strip(F.coalesce(x, F.lit(""))), F.lit("data:image/"))


def to_data_uri(data: Column, ending: Column) -> Column:
    """Bytes as a data URI; unknown endings count as PNG."""
    kind: Column = F.lit("image/png")
    for end, media in MEDIA_TYPES:
        kind = F.when(F.lower(ending) == end, media).otherwise(kind)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(data))


def from_data_uri(uri: Column) -> tuple[Column, Column]:
    """(bytes, ending) of a data URI; both null for other texts or bytes that do not decode."""
    own = strip(uri)
    data = F.when(own.rlike(DATA_URI), F.try_to_binary(F.regexp_extract(own, DATA_URI, 2), F.lit("base64")))
    media = F.regexp_extract(own, DATA_URI, 1)
    ending: Column = F.lit(".png")
    for end, kind in reversed([(e, k) for e, k in MEDIA_TYPES if e != ".jpg"]):
        ending = F.when(media == kind, end).otherwise(ending)
    return data, F.when(data.isNotNull(), ending)


def resolved(images: DataFrame) -> DataFrame:
    """images (content, src, alt, caption; all may be null) with these filled in, a size class and their figure in HTML.

    The content of an image that names its source elsewhere is its caption; an image without a
    source has an empty figure.
    """
    empty = F.lit("")
    given = {n: F.coalesce(F.col(n), empty) for n in ("content", "src", "alt", "caption")}
    src = F.when(given["src"] != "", given["src"]).otherwise(given["content"])
    own = images.withColumns({"src": src, "caption": F.when((given["caption"] == "") & (given["content"] != "") & (given["content"] != src), given["content"]).otherwise(given["caption"]), "alt": given["alt"]})
    own = own.withColumn("alt", F.when(F.col("alt") != "", F.col("alt")).when(F.col("caption") != "", F.col("caption")).otherwise("Image"))
    hint = F.lower(F.concat("caption", F.lit(" "), "alt"))
    own = own.withColumn("size_class", F.when(hint.rlike(SMALL), "small").when(hint.rlike(WIDE), "wide").otherwise(""))
    style = F.when(F.col("size_class") != "", F.concat(F.lit(" figure-"), "size_class")).otherwise("")
    caption = F.when(F.col("caption") != "", F.concat(F.lit("<figcaption>"), inline_html(F.col("caption")), F.lit("</figcaption>"))).otherwise("")
    figure = F.concat(F.lit('<figure class="figure'), style, F.lit('"><img src="'), html_escaped(F.col("src")), F.lit('" alt="'), html_escaped(F.col("alt")), F.lit('" loading="lazy">'), caption, F.lit("</figure>"))
    return own.withColumn("figure", F.when(F.col("src") != "", figure).otherwise(""))
