"""Operators on pixel tables (a row for each pixel).

For checking, previews and small art; at scale, the same steps run on tiles (operators.process). Only joins with tables of a fixed size and
aggregations by image shuffle or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import color, options, screens
from inkgrid.functions.gain import compensate_gain

RGB = ("r", "g", "b")


def with_recipe(pixels: DataFrame, artworks: DataFrame, recipes: DataFrame) -> DataFrame:
    """Pixels with their image's size and recipe, defaults filled in. Images without a recipe are left out. The images are what is hashed, whatever sizes Spark expects: it doesn't know how many pixels an image becomes."""
    full = options.with_defaults(recipes)
    sized = pixels.join(artworks.select("image_id", "width", "height", "recipe_id").hint("shuffle_hash"), "image_id")
    return sized.join(F.broadcast(full), "recipe_id")  # some dozens


def coverage(df: DataFrame) -> DataFrame:
    """Adds raw (before levels), m (share of ink that recovery finds, null without) and value (coverage to print)."""
    rgb, key = [F.col(c) for c in RGB], [F.col(f"key_{c}") for c in RGB]
    m = F.when(F.col("recover") & F.col("knockout"), color.matte(rgb, key))
    df = df.withColumns({"m": m, "t": F.when(F.col("knockout"), color.key_distance(rgb, key, F.col("tolerance"), F.col("softness")))})  # columns, as both are used again and again
    opacity = F.when(F.col("knockout"), color.knockout_opacity(F.col("a"), F.col("t"))).otherwise(F.col("a") / 255.0)
    raw = color.raw_coverage(opacity * F.coalesce("m", F.lit(1.0)), F.col("gamma"), F.col("strength"))
    df = df.withColumn("raw", F.when(F.col("a") > 0, raw).otherwise(0.0)).drop("t")
    v = color.adjust_levels(F.col("raw"), *(F.col(c) for c in ("input_black", "input_midtone", "input_white", "output_black", "output_white")))
    df = df.withColumn("value", v).withColumn("value", F.when(F.col("value") <= 0, 0.0).otherwise(compensate_gain(F.col("value"), F.col("gain"))))
    return df.withColumn("value", F.when(F.col("value") <= 0, 0.0).otherwise(color.solid_above(F.col("value"), F.col("solid_above"))))


def threshold(df: DataFrame, dpi: float = 300.0) -> DataFrame:
    """Adds threshold, the coverage from which the screen prints there."""
    return _in_cell(_cells(df, dpi))


def _cells(df: DataFrame, dpi: float) -> DataFrame:
    """Adds a pixel's place in its cell, and what is looked up for it."""
    u, v = screens.cell_places(F.col("x"), F.col("y"), F.col("lpi"), F.col("angle"), dpi, F.col("origin_x"), F.col("origin_y"))
    df = df.withColumns({"u": u, "v": v}).withColumns({c: screens.off_centre(F.col(c)) for c in "uv"})
    df = df.withColumn("bin", F.when(F.col("shape").isin(*screens.LOOKED_UP), screens.spot_bin(F.col("u"), F.col("v"), F.col("shape"))))
    return df.join(F.broadcast(screens.spot_cdf(df.sparkSession)), ["shape", "bin"], "left")  # 16,384 rows


def _in_cell(df: DataFrame) -> DataFrame:
    """Adds threshold, from the place in the cell."""
    df = df.withColumn("radius", screens.radius(F.col("u"), F.col("v")))  # a column, as a threshold has it a dozen times
    return df.withColumn("threshold", screens.threshold(F.col("u"), F.col("v"), F.col("shape"), F.col("line_trim"), F.col("cdf"), F.col("radius"))).drop("u", "v", "bin", "cdf", "radius")


def screened(df: DataFrame) -> Column:
    """Whether a pixel with value and threshold gets ink before cleanup; protected ones (protect >= 128, opaque enough) do."""
    protected = _protected(df)
    enough = (F.col("a") > 0) & (F.col("value") >= F.col("alpha_floor")) & (F.col("value") > 0)
    dot = F.when(F.col("halftone"), (F.col("value") >= 1) | (F.col("value") > F.col("threshold"))).otherwise(F.col("value") * 255.0 >= F.col("alpha_threshold"))
    return protected | (enough & dot)


def _protected(df: DataFrame) -> Column:
    if "protect" not in df.columns:
        return F.lit(False)
    return (F.col("protection") == "selection") & (F.coalesce("protect", F.lit(0)) >= 128) & (F.col("a") >= 128)


def screen(df: DataFrame, dpi: float = 300.0) -> DataFrame:
    """The screen step for pixels with a recipe: adds value, ink (before cleanup), protected, solid (art that would print solid) and the
    printed colour out_r, out_g, out_b, zero without ink."""
    df = _in_cell(coverage(_cells(df, dpi)))  # in this order the steps fall into compiled stages of a size that the JVM compiles too
    df = df.withColumn("protected", _protected(df)).withColumn("ink", screened(df)).withColumn("solid", (F.col("raw") >= 0.5) & (F.col("a") > 0))
    rgb, key = [F.col(c) for c in RGB], [F.col(f"key_{c}") for c in RGB]
    # each step is columns of their own: in one expression, a channel would have dozens of copies of the step before, too much code to compile
    df = df.withColumns({f"own_{n}": F.when(F.col("m") > 0, color.ink_color(c, k, F.col("m"))).otherwise(c) for n, c, k in zip(RGB, rgb, key, strict=True)})
    own = [F.col(f"own_{n}") for n in RGB]
    df = df.withColumn("lift", color.boost_lift(own, F.col("shadow_boost")))
    df = df.withColumns({f"lifted_{n}": color.lifted(c, F.col("lift")) for n, c in zip(RGB, own, strict=True)})
    boosted = color.spread([F.col(f"lifted_{n}") for n in RGB], F.col("color_boost"))
    plain = F.col("protected") | ((F.col("shadow_boost") == 0) & (F.col("color_boost") == 0))
    out = [F.when(~F.col("ink"), 0).when(F.col("protected"), c).when(plain, r).otherwise(b) for c, r, b in zip(rgb, own, boosted, strict=True)]
    df = df.withColumns({f"out_{n}": c.cast("int") for n, c in zip(RGB, out, strict=True)})
    return df.drop("lift", *(f"{step}_{n}" for step in ("own", "lifted") for n in RGB))


def raster_stats(df: DataFrame) -> DataFrame:
    """Counts for each image, of pixels with ink, protected and solid, and the coverage in percent of width x height."""
    counts = df.groupBy("image_id").agg(
        F.count_if("ink").alias("ink_pixels"), F.count_if("protected").alias("protected_pixels"), F.count_if("solid").alias("solid_pixels"), F.first("width").alias("width"), F.first("height").alias("height")
    )
    return counts.withColumn("coverage_percent", F.col("ink_pixels") / (F.col("width").cast("long") * F.col("height")) * 100.0)


def trim_bounds(pixels: DataFrame) -> DataFrame:
    """(image_id, left, top, width, height, error): the box of pixels that aren't transparent; an image without any has an error."""
    on = lambda c: F.when(F.col("a") > 0, F.col(c))
    box = pixels.groupBy("image_id").agg(F.min(on("x")).alias("left"), F.min(on("y")).alias("top"), F.max(on("x")).alias("right"), F.max(on("y")).alias("bottom"))
    return box.select("image_id", "left", "top", (F.col("right") - F.col("left") + 1).alias("width"), (F.col("bottom") - F.col("top") + 1).alias("height"), F.when(F.col("left").isNull(), "empty").alias("error"))


def composite(df: DataFrame, background: list[Column] | None = None) -> DataFrame:
    """(image_id, x, y, r, g, b): pixels over a background colour, or over the checker board."""
    board = color.checker(F.col("x"), F.col("y"))
    back = background or [board] * 3
    return df.select("image_id", "x", "y", *(color.over(F.col(c), F.col("a"), k).alias(c) for c, k in zip(RGB, back, strict=True)))


MODES = ("original", "garment", "beforeGarment", "compare", "transparent", "removed", "protection", "mask")


def view_rgb(columns: list[str], mode: str, position: float = 50.0) -> list[Column]:
    """The colour of a screened pixel in a preview: original, garment, beforeGarment, compare (before left of `position` percent, a white line, then after), transparent, removed, protection or mask. columns: those at
    hand; without `removed` nothing was; before_r, before_g and before_b are taken for the art over the garment's colour, board for the checker board."""
    key, board = [F.col(f"key_{c}") for c in RGB], [F.col("board") if "board" in columns else color.checker(F.col("x"), F.col("y"))] * 3
    before = lambda back: [F.col(f"before_{c}") if back is key and f"before_{c}" in columns else color.over(F.col(c), F.col("a"), k) for c, k in zip(RGB, back, strict=True)]
    after = lambda back: [F.when(F.col("ink"), F.col(f"out_{c}")).otherwise(k) for c, k in zip(RGB, back, strict=True)]  # noqa: E731  ink is opaque
    flat = lambda on, rgb: [F.when(on, v).otherwise(0) for v in rgb]
    split = F.floor(F.col("width") * position / 100.0 + 0.5)
    line = (F.col("x") == split) & (split > 0) & (split < F.col("width"))
    rgb = {
        "original": lambda: before(board), "garment": lambda: after(key), "beforeGarment": lambda: before(key), "transparent": lambda: after(board),
        "compare": lambda: [F.when(F.col("x") < split, b).when(line, 255).otherwise(a) for b, a in zip(before(key), after(key), strict=True)],
        "removed": lambda: flat(F.col("removed") if "removed" in columns else F.lit(False), (255, 110, 70)), "protection": lambda: flat(F.col("protected"), (240, 240, 240)),
        "mask": lambda: flat(F.col("ink"), (255, 255, 255)),
    }[mode]()
    return [c.cast("int") for c in rgb]


def view(df: DataFrame, mode: str, position: float = 50.0) -> DataFrame:
    """(image_id, x, y, r, g, b) of screened pixels as a preview of view_rgb()."""
    return df.select("image_id", "x", "y", *(c.alias(n) for n, c in zip(RGB, view_rgb(df.columns, mode, position), strict=True)))


def view_sums(df: DataFrame, position: float = 50.0) -> DataFrame:
    """(image_id, mode, r, g, b): sums of all previews of each image, in one pass over its pixels."""
    df = df.withColumns({"board": color.checker(F.col("x"), F.col("y")), **{f"before_{c}": color.over(F.col(c), F.col("a"), F.col(f"key_{c}")) for c in RGB}})  # two previews need each
    sums = [F.struct(F.lit(m).alias("mode"), *(F.sum(c).alias(n) for n, c in zip(RGB, view_rgb(df.columns, m, position), strict=True))).alias(m) for m in MODES]
    return df.groupBy("image_id").agg(*sums).select("image_id", F.explode(F.array(*MODES)).alias("v")).select("image_id", "v.*")


def mockup(df: DataFrame, sizes: DataFrame, chest_cm: float = 52.0, height_cm: float = 72.0, at_x: float = 50.0, at_y: float = 18.0) -> DataFrame:
    """(image_id, x, y, r, g, b): a garment of 420 x 540 pixels with the screened art on it. sizes: (image_id, width_cm, height_cm). Each pixel of the canvas
    takes the nearest pixel of the art; the canvas is made per image and joined by the source place."""
    width, height, top = 420, 540, 30
    scale = min(260 / chest_cm, 450 / height_cm)
    body_w, body_h = chest_cm * scale, height_cm * scale
    left = (width - body_w) / 2
    x, y = F.col("x"), F.col("y")
    sleeve = F.when(y < top + body_h * 0.24, F.lit(body_w * 0.25) * (1.0 - (y - top) / (body_h * 0.24))).otherwise(0.0)
    inside = (y >= top) & (y <= top + body_h) & (x >= left - sleeve) & (x <= left + body_w + sleeve)
    art = df.groupBy("image_id").agg(F.first("width").alias("w"), F.first("height").alias("h"), *(F.first(f"key_{c}").alias(f"key_{c}") for c in RGB)).join(sizes, "image_id")
    canvas = art.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("inside", inside)
    art_w, art_h = F.col("width_cm") * scale, F.col("height_cm") * scale
    art_left, art_top = F.lit(left + body_w * (at_x / 100)) - art_w / 2.0, F.lit(top + body_h * at_y / 100)
    place = lambda c, start, size, n: F.least(n - 1, F.greatest(F.lit(0), F.floor((c - start) / size * n))).cast("int")
    covered = F.col("inside") & (x >= F.floor(art_left)) & (x < F.ceil(art_left + art_w)) & (y >= F.floor(art_top)) & (y < F.ceil(art_top + art_h))
    canvas = canvas.withColumn("sx", F.when(covered, place(x, art_left, art_w, F.col("w")))).withColumn("sy", F.when(covered, place(y, art_top, art_h, F.col("h"))))
    source = df.where("ink").select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *(f"out_{c}" for c in RGB))
    joined = canvas.join(source.hint("merge"), ["image_id", "sx", "sy"], "left")
    shirt = {"r": 24, "g": 27, "b": 26}
    return joined.select("image_id", "x", "y", *(F.when(F.col(f"out_{c}").isNotNull(), F.col(f"out_{c}")).when(F.col("inside"), F.col(f"key_{c}")).otherwise(shirt[c]).alias(c) for c in RGB))


def rotate_cw(df: DataFrame) -> DataFrame:
    """A quarter turn to the right: (x, y) of w x h goes to (h - 1 - y, x). Needs the image's height."""
    return df.withColumns({"x": (F.col("height") - 1 - F.col("y")).cast("int"), "y": F.col("x"), "width": F.col("height"), "height": F.col("width")})


def protect_edges(df: DataFrame) -> DataFrame:
    """(image_id, x, y) of opaque pixels (a >= 250, value > 0) with a neighbour, in the square of the recipe's edge_radius, that is inside the image and
    transparent (a < 128), or opaque with a colour at least edge_contrast away. A missing pixel is transparent. Needs coverage()."""
    place = df.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(c).alias(f"n_{c}") for c in (*RGB, "a")))
    opaque = df.where("a >= 250").select("image_id", "x", "y", "width", "height", "edge_radius", "edge_contrast", "value", *RGB)
    step = F.sequence(-F.col("edge_radius"), F.col("edge_radius"))
    around = opaque.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where("dx <> 0 or dy <> 0").withColumn("nx", F.col("x") + F.col("dx")).withColumn("ny", F.col("y") + F.col("dy"))
    around = around.where("nx >= 0 and ny >= 0 and nx < width and ny < height").join(place.hint("merge"), ["image_id", "nx", "ny"], "left")
    far = color.rgb_distance([F.col(c) for c in RGB], [F.col(f"n_{c}") for c in RGB]) >= F.col("edge_contrast")
    edges = around.where((F.coalesce("n_a", F.lit(0)) < 128) | ((F.col("n_a") >= 250) & far)).groupBy("image_id", "x", "y").agg(F.max("value").alias("value"))
    return edges.where("value > 0").select("image_id", "x", "y")  # sooner, the filter would be pushed down with all that a value is made of, again and again


def removed_mask(screened_: DataFrame, final: DataFrame) -> DataFrame:
    """(image_id, x, y) of pixels that the screen printed and that have no ink in the end."""
    place = ["image_id", "x", "y"]
    return screened_.select(*place).join(final.select(*place).hint("merge"), place, "left_anti")


def final_mask(screened_: DataFrame, removed: DataFrame, filled: DataFrame) -> DataFrame:
    """(image_id, x, y): the screened pixels without the removed ones, and the filled ones."""
    place, parts = ["image_id", "x", "y"], {"screened": screened_, "removed": removed, "filled": filled}
    tagged = [df.select(*place, *(F.lit(int(n == m)).alias(m) for m in parts)) for n, df in parts.items()]
    counts = tagged[0].union(tagged[1]).union(tagged[2]).groupBy(*place).agg(*(F.sum(n).alias(n) for n in parts))  # one shuffle for both operations
    return counts.where("filled > 0 or screened > removed").select(*place)


def isolated_mask(mask: DataFrame) -> DataFrame:
    """(image_id, x, y) of the pixels of a mask without any of their eight neighbours. 32 pixels of a line are the bits of a word, and a word tells the words around it where they have a neighbour: a few rows for each
    word, not eight for each pixel."""
    words = mask.groupBy("image_id", "y", F.shiftright("x", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 31 AS int)))").alias("bits"))
    own, beside, most = F.col("bits"), F.shiftleft("bits", 1).bitwiseOR(F.shiftright("bits", 1)), F.lit((1 << 32) - 1)
    none = F.lit(0).cast("long")
    told = [F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dw"), own.alias("own"), beside.bitwiseAND(most).alias("near"))]
    for dy in (-1, 0, 1):
        if dy:
            told.append(F.struct(F.lit(dy).alias("dy"), F.lit(0).alias("dw"), none.alias("own"), own.bitwiseOR(beside).bitwiseAND(most).alias("near")))
        for dw, bit, to in ((-1, 0, 31), (1, 31, 0)):
            told.append(F.struct(F.lit(dy).alias("dy"), F.lit(dw).alias("dw"), none.alias("own"), F.shiftleft(F.shiftright("bits", bit).bitwiseAND(F.lit(1)), to).alias("near")))
    told = F.filter(F.array(*told), lambda t: (t["own"] != 0) | (t["near"] != 0))
    all_ = words.select("image_id", "y", "word", F.explode(told).alias("t")).groupBy("image_id", (F.col("y") + F.col("t.dy")).alias("y"), (F.col("word") + F.col("t.dw")).alias("word")).agg(F.bit_or("t.own").alias("own"), F.bit_or("t.near").alias("near"))
    alone = all_.withColumn("alone", F.col("own").bitwiseAND(F.bitwise_not("near"))).where("alone <> 0")
    return alone.select("image_id", "y", "word", F.explode(F.expr("filter(sequence(0, 31), i -> getbit(alone, i) = 1)")).alias("i")).select("image_id", (F.col("word") * 32 + F.col("i")).cast("int").alias("x"), "y")


def resample(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: (image_id, width, height, out_width, out_height). (image_id, x, y, r, g, b, a) at the output size: the area that shrinks, straight lines that
    grow, with colours weighted by opacity. Each axis has its weights; a source pixel is added where both axes need it."""
    from inkgrid.functions.sizing import axis_weights

    def axis(out: str, source: str, at: str, to: str, weight: str) -> DataFrame:
        n = sizes.select("image_id", out, source).withColumn(to, F.explode(F.sequence(F.lit(0), F.col(out).cast("int") - 1)))
        n = n.withColumn("w", F.explode(axis_weights(F.col(to), F.col(source) / F.col(out), F.col(source))))
        return n.select("image_id", to, F.col("w.p").alias(at), F.col("w.w").alias(weight))

    wide = pixels.where("a > 0").join(axis("out_width", "width", "x", "ox", "wx").hint("merge"), ["image_id", "x"])
    weight = F.col("a") / 255.0 * F.col("wx")
    rows = wide.groupBy("image_id", "y", "ox").agg(F.sum(weight).alias("sa"), *(F.sum(F.col(c) * weight).alias(f"s_{c}") for c in RGB))
    tall = rows.join(axis("out_height", "height", "y", "oy", "wy").hint("merge"), ["image_id", "y"]).groupBy("image_id", "ox", "oy").agg(F.sum(F.col("sa") * F.col("wy")).alias("sa"), *(F.sum(F.col(f"s_{c}") * F.col("wy")).alias(f"s_{c}") for c in RGB))
    out = tall.where("sa > 0")
    near = lambda x: color.rounded(F.round(x, 9))  # noqa: E731  sums come in any order; halves must not depend on it
    return out.select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), *(near(F.col(f"s_{c}") / F.col("sa")).alias(c) for c in RGB), near(F.col("sa") * 255.0).alias("a"))
