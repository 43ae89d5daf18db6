"""Colour and coverage of single pixels. All arguments are Columns; channels are 0 to 255, coverage 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest distance of two RGB colours.
DIAGONAL = 255.0 * 3.0**0.5


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(x: Column) -> Column:
    """To the nearest integer, halves up."""
    return F.floor(x + F.lit(0.5)).cast("int")


def byte(x: Column) -> Column:
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)))


def hex_rgb(text: Column) -> Column:
    """struct(r, g, b) of six hex digits with or without #; null if it is none."""
    digits = F.regexp_extract(text, "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rgb_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y)).cast("double") for x, y in zip(a[1:], b[1:], strict=True)) + ((a[0] - b[0]) * (a[0] - b[0])).cast("double"))


def key_distance(rgb: list[Column], key: list[Column], tolerance: Column, softness: Column) -> Column:
    """How far, 0 to 1, a colour is on the way from tolerance to tolerance + softness percent of the largest distance from the garment's."""
    return unit((rgb_distance(rgb, key) / F.lit(DIAGONAL) - tolerance / 100.0) / (softness / 100.0))


def knockout_opacity(a: Column, t: Column) -> Column:
    """Opacity, less where the colour is near the garment's: a smooth step over key_distance()."""
    return a / 255.0 * (t * t * (3.0 - 2.0 * t))


def knockout_coverage(rgb: list[Column], a: Column, key: list[Column], tolerance: Column, softness: Column) -> Column:
    """Both steps in one."""
    return knockout_opacity(a, key_distance(rgb, key, tolerance, softness))


def matte(rgb: list[Column], key: list[Column]) -> Column:
    """The smallest share of ink over the key colour that can give the pixel's colour."""

    def channel(c: Column, k: Column) -> Column:
        up = (c - k) / F.when(k == 255, 1).otherwise(255 - k)
        down = (k - c) / F.when(k == 0, 1).otherwise(k)
        return F.when(c >= k, up).otherwise(down)

    return unit(F.greatest(*(channel(c, k) for c, k in zip(rgb, key, strict=True))))


def raw_coverage(opacity: Column, gamma: Column, strength: Column) -> Column:
    return F.pow(opacity, 1.0 / gamma) * (strength / 100.0)


def adjust_levels(v: Column, in_black: Column, midtone: Column, in_white: Column, out_black: Column, out_white: Column) -> Column:
    """Input and output levels with a midtone exponent; what is zero stays zero."""
    t = unit((v * 255.0 - in_black) / (in_white - in_black))
    return F.when(v <= 0, F.lit(0.0)).otherwise((out_black + F.pow(t, 1.0 / midtone) * (out_white - out_black)) / 255.0)


def solid_above(v: Column, percent: Column) -> Column:
    return F.when((percent < 100) & (v >= percent / 100.0), F.lit(1.0)).otherwise(v)


def ink_color(c: Column, key: Column, m: Column) -> Column:
    """The colour of ink that gives c at share m over the key."""
    return byte((c - (1.0 - m) * key) / m)


def boost_lift(rgb: list[Column], shadow: Column) -> Column:
    """The share of the way to white by which a colour is lifted: more for dark ones."""
    r, g, b = rgb
    dark = 1.0 - (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0
    return shadow / 100.0 * (dark * dark)


def lifted(c: Column, lift: Column) -> Column:
    return c + (255.0 - c) * lift


def spread(rgb: list[Column], color: Column) -> list[Column]:
    """Channels spread about their mean, as bytes."""
    mean = (rgb[0] + rgb[1] + rgb[2]) / 3.0
    return [byte(mean + (c - mean) * (1.0 + color / 100.0)) for c in rgb]


def boost_color(rgb: list[Column], shadow: Column, color: Column) -> list[Column]:
    """Lifts dark colours towards white, then spreads the channels about their mean. For large tables take the three steps in columns of their own: in one, each channel has dozens of copies of all three."""
    lift = boost_lift(rgb, shadow)
    return spread([lifted(c, lift) for c in rgb], color)


def checker(x: Column, y: Column) -> Column:
    """The grey of a board of 12-pixel squares."""
    return F.when((F.floor(x / 12) + F.floor(y / 12)) % 2 == 0, 190).otherwise(230)


def over(c: Column, a: Column, background: Column) -> Column:
    alpha = a / 255.0
    return rounded(c * alpha + background * (1.0 - alpha))


def white_format(ink: Column, kind: str) -> list[Column]:
    """(r, g, b, a) of a mask pixel: blackOnWhite, alpha (white ink on nothing) or whiteOnBlack."""
    on = lambda yes, no: F.when(ink, F.lit(yes)).otherwise(F.lit(no))
    if kind == "alpha":
        return [on(255, 0)] * 4
    grey = on(0, 255) if kind == "blackOnWhite" else on(255, 0)
    return [grey, grey, grey, F.lit(255)]
