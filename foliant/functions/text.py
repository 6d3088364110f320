"""Column functions on text; each has a twin expression in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\x0B\f\r]"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")


def named(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), where x is computed once however often ``of`` reads it; inside of lambdas Spark computes an expression again for each of its uses."""
    return F.get(F.transform(F.array(x), of), 0)


def title_case(x: Column) -> Column:
    """Every run of letters with a capital first and small letters behind it."""
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def words(x: Column) -> Column:
    """Array of the runs of non-space characters."""
    return F.filter(F.split(strip(x), rf"{WHITE}+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def tokens(x: Column, least: int) -> Column:
    """Array of lower-case ASCII words of at least so many letters, whole words only."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(rf"^[a-z]{{{least},}}$"))


def count_of(x: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a substring."""
    return F.floor((F.length(x) - F.length(F.replace(x, part, F.lit("")))) / F.length(part)).cast("long")


def html_escaped(x: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(code))
    return x


def inline_html(x: Column) -> Column:
    """Inline marks of Markdown as HTML, after escaping."""
    x = F.regexp_replace(html_escaped(x), r"(?s)\*\*(.+?)\*\*", "<strong>$1</strong>")
    x = F.regexp_replace(x, r"(?s)\*(.+?)\*", "<em>$1</em>")
    return F.regexp_replace(x, r"(?s)`(.+?)`", "<code>$1</code>")


def safe_name(x: Column) -> Column:
    """A theme or file name with every other character replaced."""
    return F.regexp_replace(x, r"[^a-zA-Z0-9_\-]", "_")


def plain_page_text(x: Column) -> Column:
    """The five repairs of plainly extracted page text."""
    x = F.replace(x, F.lit("\t"), F.lit(" "))
    x = F.regexp_replace(x, r"([0-9A-Za-z_])-\n([0-9A-Za-z_])", "$1$2")
    x = F.regexp_replace(x, r"([a-z,;])\n([a-z])", "$1 $2")
    x = F.regexp_replace(x, r"\n[ ]*\d+[ ]*\n", "\n")
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def normal_hex(x: Column) -> Column:
    """A colour with a leading # in upper case; three digits are doubled, other lengths stay as they are."""
    own = F.trim(x, F.lit(" \t\n\x0b\f\r"))
    own = F.when(F.startswith(own, F.lit("#")), own).otherwise(F.concat(F.lit("#"), own))
    doubled = F.concat(F.lit("#"), *[F.repeat(F.substring(own, k, 1), 2) for k in (2, 3, 4)])
    return F.upper(F.when(F.length(own) == 4, doubled).otherwise(own))


def channel(hex_color: Column, k: int) -> Column:
    """Red, green or blue (0, 1, 2) of #RRGGBB."""
    return F.conv(F.substring(hex_color, 2 + 2 * k, 2), 16, 10).cast("int")


def without_private_marks(x: Column) -> Column:
    """A private-use character at the start, as bullets of some fonts are, becomes "- "; others go."""
    return F.regexp_replace(F.regexp_replace(x, r"^[\x{E000}-\x{F8FF}]\s*", "- "), r"[\x{E000}-\x{F8FF}]", "")


def pretty_label(key: Column) -> Column:
    """"parent/leaf + other" as "leaf (parent) + other"; only the first slash of a part counts."""

    def one(part: Column) -> Column:
        own = strip(part)
        at = F.instr(own, "/")
        return F.when(at > 0, F.concat(F.substr(own, at + 1), F.lit(" ("), F.substring_index(own, "/", 1), F.lit(")"))).otherwise(own)

    return F.array_join(F.transform(F.split(key, r" \+ "), one), " + ")


# fixed values: parts of font names
MONO_FONTS = "mono|courier|consolas"
SERIF_FONTS = "serif|fraunces|cinzel|playfair|lora|crimson|georgia|garamond|baskerville|merriweather|times"


def font_class(name: Column) -> Column:
    """mono, serif or sans, by parts of the family's name; null counts as sans."""
    own = F.lower(F.coalesce(name, F.lit("")))
    return F.when(own.rlike(MONO_FONTS), "mono").when(own.rlike(SERIF_FONTS), "serif").otherwise("sans")


def margin_motif(glyph: Column) -> Column:
    """The ornament of page margins: three dashes, the glyph shown as text, three dashes."""
    rule = F.lit("\u2500" * 3)
    return F.concat(rule, F.lit("  "), glyph, F.lit("\ufe0e  "), rule)


def density(x: Column) -> Column:
    """An ornament density given as text, as a whole number of 0..4; 2 where it is none."""
    number = F.when(strip(x).rlike(r"^[+-]?\d{1,18}$"), strip(x).cast("long"))
    return F.when(number.isNull(), 2).otherwise(F.least(F.greatest(number, F.lit(0)), F.lit(4))).cast("int")
