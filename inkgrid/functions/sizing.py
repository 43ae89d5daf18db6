"""Print sizes: units, print areas by garment, output plans, resampling weights, halos and resources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT_DPI, MOST_PIXELS, MOST_SIDE = 300.0, 128_000_000, 300_000
#: Sizes, positions and print areas in cm (width, height) by adult size.
SIZES = ("XS", "S", "M", "L", "XL", "2XL", "3XL")
CHILD_SIZES = ("2", "4", "6", "8", "10", "12")
AREAS = {
    "front": ((22.0, 28.0), (24.0, 30.0), (27.0, 33.0), (29.0, 35.0), (30.0, 35.5), (31.0, 38.0), (31.5, 40.0)),
    "back": ((24.0, 30.0), (26.0, 32.0), (28.0, 34.0), (30.0, 35.5), (30.0, 35.5), (31.0, 38.0), (31.5, 40.0)),
    "chest": ((10.0, 10.0),) * 7,
    "sleeve": ((8.0, 10.0),) * 7,
    "neck": ((8.0, 5.0),) * 7,
}


def nearest(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def mm_to_px(mm: Column) -> Column:
    return nearest(mm / 25.4 * OUTPUT_DPI)


def cm_to_px(cm: Column) -> Column:
    return nearest(cm / 2.54 * OUTPUT_DPI)


def px_to_cm(px: Column) -> Column:
    return px / OUTPUT_DPI * 2.54


def min_area(mm: Column, dpi: Column | float = OUTPUT_DPI) -> Column:
    """Pixels of a disc of that diameter, 1 at least."""
    d = mm / 25.4 * dpi
    return F.greatest(F.lit(1), F.ceil(F.lit(math.pi) * (d / 2.0) * (d / 2.0))).cast("long")


def cell_px(lpi: Column, dpi: Column | float = OUTPUT_DPI) -> Column:
    return (F.lit(dpi) if isinstance(dpi, float) else dpi) / lpi


def tones_per_cell(lpi: Column, dpi: Column | float = OUTPUT_DPI) -> Column:
    c = cell_px(lpi, dpi)
    return F.greatest(F.lit(1), nearest(c * c))


def garment_areas(spark: SparkSession) -> DataFrame:
    """(garment, placement, size, width_cm, height_cm): the preset areas, 65 rows. A child's front and back grow by size, its other positions
    are three quarters of an adult's."""
    rows = [("adult", p, s, w, h) for p, areas in AREAS.items() for s, (w, h) in zip(SIZES, areas, strict=True)]
    for p, areas in AREAS.items():
        for i, s in enumerate(CHILD_SIZES):
            rows.append(("child", p, s, *((16 + i * 1.5, 20.0 + i * 2) if p in ("front", "back") else (areas[0][0] * 0.75, areas[0][1] * 0.75))))
    return spark.createDataFrame(rows, "garment string, placement string, size string, width_cm double, height_cm double")


def print_area(variants: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """variants: (garment, placement, size, ...), custom: (placement, size, width_cm, height_cm). Adds area_w and area_h: the custom area of the
    position and size if there is one, else the preset of the garment, else null."""
    preset = garment_areas(variants.sparkSession).withColumnsRenamed({"width_cm": "preset_w", "height_cm": "preset_h"})
    out = variants.join(F.broadcast(preset), ["garment", "placement", "size"], "left")  # 65 rows
    if custom is None:
        return out.withColumnsRenamed({"preset_w": "area_w", "preset_h": "area_h"})
    out = out.join(custom.withColumnsRenamed({"width_cm": "custom_w", "height_cm": "custom_h"}), ["placement", "size"], "left")
    areas = {"area_w": F.coalesce("custom_w", "preset_w"), "area_h": F.coalesce("custom_h", "preset_h")}
    return out.withColumns(areas).drop("custom_w", "custom_h", "preset_w", "preset_h")


def fit_width_cm(w: Column, h: Column, area_w: Column, area_h: Column) -> Column:
    """The width in cm of art of w x h pixels at the largest size inside the area."""
    return w * F.least(area_w / w, area_h / h)


def print_plan(w: Column, h: Column, dpi: Column, axis: Column | str = "width", cm: Column | None = None) -> Column:
    """struct(width, height, width_cm, height_cm, upscaled, error): output pixels at 300 ppi. The driving axis is rounded first, the other follows from
    the source's ratio. cm: wanted size of that axis, else its size at the source's dpi."""
    axis = F.lit(axis) if isinstance(axis, str) else axis
    tall = axis == "height"
    natural = F.when(tall, h).otherwise(w) / dpi * 2.54
    cm = natural if cm is None else F.coalesce(cm, natural)
    drive = cm / 2.54 * OUTPUT_DPI
    width = F.greatest(F.lit(1), nearest(F.when(tall, nearest(drive) * w / h).otherwise(drive)))
    height = F.greatest(F.lit(1), F.when(tall, nearest(drive)).otherwise(nearest(width * h / w)))
    error = (
        F.when(~((w > 0) & (h > 0)), "source size").when(~(dpi > 0), "source dpi").when(~((cm > 0) & (cm <= 100)), "size out of range")
        .when((width > MOST_SIDE) | (height > MOST_SIDE), "side too long").when(width * height > MOST_PIXELS, "too many pixels")
    )
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(ok(width).alias("width"), ok(height).alias("height"), ok(px_to_cm(width)).alias("width_cm"), ok(px_to_cm(height)).alias("height_cm"), ok((width > w) | (height > h)).alias("upscaled"), error.alias("error"))


def axis_weights(position: Column, scale: Column, limit: Column) -> Column:
    """array<struct(p, w)>: source positions of an output position along one axis, and their weights. scale: source over output. Above 1 the area that
    the output covers, else a straight line between the two nearest centres."""
    start, end = position * scale, F.least(limit.cast("double"), (position + 1) * scale)
    covered = F.transform(F.sequence(F.floor(start), F.ceil(end) - 1), lambda p: F.struct(p.cast("int").alias("p"), ((F.least(end, p + 1.0) - F.greatest(start, p.cast("double"))) / scale).alias("w")))
    f = F.greatest(F.lit(0.0), F.least(limit - 1.0, (position + 0.5) * scale - 0.5))
    low = F.floor(f).cast("int")
    pair = F.array(F.struct(low.alias("p"), (1.0 - (f - low)).alias("w")), F.struct(F.least(limit - 1, low + 1).cast("int").alias("p"), (f - low).alias("w")))
    return F.when(scale > 1, covered).otherwise(pair)


def source_window(start: Column, length: Column, scale: Column, limit: Column) -> Column:
    """struct(lo, hi): the source positions that a run of output positions can need along one axis, with a margin."""
    lo = F.when(scale > 1, start * scale).otherwise((start + 0.5) * scale - 0.5)
    hi = F.when(scale > 1, (start + length) * scale).otherwise((start + length - 0.5) * scale - 0.5)
    return F.struct(F.greatest(F.lit(0), F.floor(lo) - 1).cast("long").alias("lo"), F.least(limit, F.ceil(hi) + 2).cast("long").alias("hi"))


def opening_params(lpi: Column, level: Column) -> Column:
    """struct(radius, feather, blur) of the cleanup by opening; null if the level is none."""
    base = F.when(lpi >= 40, F.lit(1.0)).otherwise(1.0 + 0.1 * (40.0 - lpi))
    feather = F.floor((base + F.when(level == "high", 0.5).otherwise(0.0)) * 100.0 + 0.5) / 100.0
    feather = F.when(level == "low", F.lit(0.0)).otherwise(feather)
    blur = F.when(feather > 0, F.greatest(F.lit(1), F.floor(feather / 2.0 + 0.5))).otherwise(0).cast("int")
    return F.when(level != "none", F.struct(F.when(level == "high", 2).otherwise(1).alias("radius"), feather.alias("feather"), blur.alias("blur")))


def halo_px(options: dict[str, Column]) -> Column:
    """Pixels around a tile that its result depends on."""
    o = options
    area, holes = min_area(o["min_diameter_mm"]), min_area(o["fill_holes_mm"])
    opening = opening_params(o["lpi"], o["cleanup"])
    clean = F.when(o["cleanup_mode"] == "opening", F.coalesce(opening["blur"] + 2 * opening["radius"], F.lit(0))).otherwise(area - 1)
    edges = F.greatest(F.when(o["protection"] == "edges", o["edge_radius"]).otherwise(0), F.when(o["defringe"], o["defringe_radius"]).otherwise(0))
    smooth = F.when(o["presmooth"] == 1, 5).when(o["presmooth"] == 2, 57).otherwise(0)
    return (clean + F.when(holes > 1, holes - 1).otherwise(0) + edges + smooth).cast("long")


def resources(width: Column, height: Column, forced_disk: Column, selection: Column) -> Column:
    """struct(pixels, disk, cache_bytes, working_bytes, recommended_bytes)."""
    pixels = (width * height).cast("long")
    disk = forced_disk | (pixels > 16_000_000)
    cache = F.when(disk, pixels * F.when(selection, 9).otherwise(8)).otherwise(0).cast("long")
    working = F.when(disk, F.lit(32_000_000)).otherwise(pixels * 14).cast("long")
    return F.struct(pixels.alias("pixels"), disk.alias("disk"), cache.alias("cache_bytes"), working.alias("working_bytes"), F.ceil(cache * 1.25 + pixels * 4).cast("long").alias("recommended_bytes"))


def ink_estimate(coverage_percent: Column, solid_pixels: Column, width: Column, height: Column, width_cm: Column, height_cm: Column, prices: dict[str, Column]) -> Column:
    """struct of ink in ml, costs and savings against printing all of the art solid. prices: color_ml_m2, white_ml_m2, color_price_l, white_price_l,
    film_price_m2."""
    p, area = prices, width_cm * height_cm
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage_percent / 100.0))
    solid = F.greatest(fraction, F.least(F.lit(1.0), solid_pixels / (width * height)))
    m2 = area * fraction / 10000.0
    color, white = m2 * p["color_ml_m2"], m2 * p["white_ml_m2"]
    ink = color * p["color_price_l"] / 1000.0 + white * p["white_price_l"] / 1000.0
    film = area / 10000.0 * p["film_price_m2"]
    savings = F.when(solid > 0, (1.0 - fraction / solid) * 100.0)
    return F.struct(area.alias("area_cm2"), color.alias("color_ml"), white.alias("white_ml"), ink.alias("ink_cost"), film.alias("film_cost"), (ink + film).alias("total_cost"), savings.alias("savings_percent"))


#: Use of ink in ml for a square metre; nothing has a price by default.
DEFAULT_PRICES = {"color_ml_m2": 8.0, "white_ml_m2": 12.0, "color_price_l": 0.0, "white_price_l": 0.0, "film_price_m2": 0.0}


def normalize_price(value: Column, name: str) -> Column:
    """The value as a number, or the default if it is none or negative."""
    x = value.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x), x).otherwise(F.lit(DEFAULT_PRICES[name]))


def ink_text(e: Column, printed_percent: Column) -> Column:
    """A summary sentence of an estimate."""
    ml = lambda v: F.when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    parts = [
        F.concat(F.lit("Ink per piece: colour "), ml(e["color_ml"]), F.lit(" ml, white "), ml(e["white_ml"]), F.lit(" ml, covers "), F.format_string("%.0f", printed_percent), F.lit(" % of the area")),
        F.when(e["savings_percent"] >= 1, F.concat(F.format_string("%.0f", e["savings_percent"]), F.lit(" % less ink than without a screen"))),
        F.when(e["total_cost"] > 0, F.concat(F.lit("cost "), F.format_string("%.2f", e["total_cost"]), F.when(e["film_cost"] > 0, " (with film)").otherwise(""))),
    ]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."))


def quality_warnings(o: dict[str, Column], ink: Column | None = None, removed: Column | None = None) -> Column:
    """array of codes: few_tones, cleanup_risk, cleanup_loss, empty, edges, selection, no_screen."""
    area = min_area(o["min_diameter_mm"])
    cell = cell_px(o["lpi"])
    codes = [
        F.when(o["halftone"] & (tones_per_cell(o["lpi"]) < 50), "few_tones"),
        F.when(o["halftone"] & (o["cleanup"] != "none") & (o["cleanup_mode"] == "area") & (area / (cell * cell) > 0.2), "cleanup_risk"),
    ]
    if ink is not None:
        codes += [F.when((ink + removed > 0) & (removed / (ink + removed) * 100.0 >= 5), "cleanup_loss"), F.when(ink == 0, "empty")]
    codes += [F.when(o["protection"] == "edges", "edges"), F.when(o["protection"] == "selection", "selection"), F.when(~o["halftone"], "no_screen")]
    return F.array_compact(F.array(*codes))
