"""Seeds, colours and palettes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import channel


def seed_unit(text: Column) -> Column:
    """0..1 from the first 2000 characters: leading 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.substring(text, 1, 2000)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits by its binary value: 0.25125, which is stored as a little less, gives 0.2512 (Spark's round goes by the digits shown)."""
    return F.round(x * float(10**digits)) / float(10**digits)


def seed_int(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hsl_channel(h: Column, s: Column, light: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 8, 4) of hue 0..360, saturation and lightness 0..1, as 0..255."""
    a = s * F.least(light, 1 - light)
    at = F.pmod(F.lit(float(k)) + h / 30, F.lit(12.0))
    return F.floor((light - a * F.greatest(F.lit(-1.0), F.least(at - 3, 9 - at, F.lit(1.0)))) * 255 + 0.5).cast("int")


def hsl_hex(h: Column, s: Column, light: Column) -> Column:
    return F.concat(F.lit("#"), *[F.format_string("%02X", hsl_channel(h, s, light, k)) for k in (0, 8, 4)])


def hue_mean(a: Column, b: Column, weight_b: Column) -> Column:
    """Circular mean of two hues in degrees."""
    x = F.cos(F.radians(a)) * (1 - weight_b) + F.cos(F.radians(b)) * weight_b
    y = F.sin(F.radians(a)) * (1 - weight_b) + F.sin(F.radians(b)) * weight_b
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def is_dark(energy: Column, seed: Column) -> Column:
    """Whether a background is dark: by energy, and between its limits by the seed."""
    return F.when(energy >= 0.6, True).when(energy <= 0.28, False).otherwise(seed < (energy - 0.28) / 0.32)


def is_gray(hex_color: Column) -> Column:
    rgb = [channel(hex_color, k) for k in range(3)]
    return F.greatest(*rgb) - F.least(*rgb) < 18


def mixed(hex_color: Column, toward: int, share: float) -> Column:
    """A colour moved towards 0 or 255 by a share, channels cut to whole numbers."""
    return F.concat(F.lit("#"), *[F.format_string("%02X", F.floor(channel(hex_color, k) + (F.lit(toward) - channel(hex_color, k)) * share).cast("int")) for k in range(3)])


def rgba(hex_color: Column, alpha: Column) -> Column:
    """rgba(r, g, b, alpha) of #RRGGBB."""
    return F.concat(F.lit("rgba("), F.concat_ws(", ", *[channel(hex_color, k).cast("string") for k in range(3)], alpha.cast("string")), F.lit(")"))


def perceptual_shift(hue: Column) -> Column:
    """What is added to a lightness so that hues look balanced: less for yellow and green, more for blue and violet."""
    return F.when(hue.between(50, 160), F.lit(-0.05)).when(hue.between(220, 280), F.lit(0.03)).otherwise(F.lit(0.0))


#: Fixed values of generated palettes, for dark and for light backgrounds: hue turn (a fixed hue for "warning",
#: the second hue for "tertiary"), saturation factor, summand and limit, lightness, share of the perceptual
#: shift and of the seed in it.
DARK = {
    "bg": (0, 0.55, 0.0, 0.42, 0.07, 0.3, 0.03), "text": (0, 0.18, 0.0, 0.14, 0.90, 1.0, 0.0), "border": (0, 0.4, 0.0, 0.32, 0.24, 0.0, 0.0), "muted": (0, 0.0, 0.12, 0.12, 0.58, 0.0, 0.0),
    "accent": (0, 1.0, 0.2, 0.92, 0.60, 1.0, 0.0), "entity": (42, 1.0, 0.15, 0.85, 0.62, 0.0, 0.0), "callout": (108, 1.0, 0.1, 0.7, 0.48, 0.0, 0.0), "warning": (8, 0.0, 0.68, 0.68, 0.58, 0.0, 0.0),
    "tertiary": (0, 1.0, 0.1, 0.75, 0.58, 0.0, 0.0),
}
LIGHT = {
    "bg": (0, 0.4, 0.0, 0.32, 0.955, 0.15, -0.02), "text": (0, 0.25, 0.0, 0.2, 0.15, -0.3, 0.0), "border": (0, 0.35, 0.0, 0.26, 0.82, 0.0, 0.0), "muted": (0, 0.0, 0.15, 0.15, 0.44, 0.0, 0.0),
    "accent": (0, 1.0, 0.12, 0.85, 0.40, 0.5, 0.0), "entity": (42, 1.0, 0.08, 0.75, 0.36, 0.0, 0.0), "callout": (108, 1.0, 0.05, 0.6, 0.30, 0.0, 0.0), "warning": (8, 0.0, 0.62, 0.62, 0.44, 0.0, 0.0),
    "tertiary": (0, 1.0, 0.08, 0.7, 0.38, 0.0, 0.0),
}
COLORS = tuple(DARK)


def with_palette(rows: DataFrame) -> DataFrame:
    """rows of hue, sat, energy, seed and second_hue (or null) with dark_bg and color_<name> for each of COLORS."""
    own = rows.withColumns({
        "_h": F.pmod(F.col("hue") + (F.col("seed") - 0.5) * 30 + 360, F.lit(360.0)),
        "_s": F.greatest(F.lit(0.15), F.least(F.lit(0.8), F.col("sat") * (0.82 + F.col("seed") * 0.4))),
        "dark_bg": is_dark(F.col("energy"), F.col("seed")),
    })
    own = own.withColumns({"_shift": perceptual_shift(F.col("_h")), "_t": F.pmod(F.coalesce("second_hue", F.col("_h") + 195), F.lit(360.0))})

    def color(name: str, spec: tuple[float, ...]) -> Column:
        turn, factor, plus, most, light, of_shift, of_seed = spec
        hue = F.lit(float(turn)) if name == "warning" else F.col("_t") if name == "tertiary" else F.pmod(F.col("_h") + turn, F.lit(360.0))
        sat = F.least(F.col("_s") * factor + plus, F.lit(most))
        return hsl_hex(hue, sat, F.lit(light) + F.col("_shift") * of_shift + F.col("seed") * of_seed)

    own = own.withColumns({f"color_{n}": F.when(F.col("dark_bg"), color(n, DARK[n])).otherwise(color(n, LIGHT[n])) for n in COLORS})
    return own.drop("_h", "_s", "_shift", "_t")
