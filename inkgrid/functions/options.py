"""Options of a recipe: defaults, rules, presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions.color import hex_rgb
from inkgrid.functions.gain import parse_gain

#: Fixed values: (name, type, default) of the options that decide pixels.
DEFAULTS = (
    ("lpi", "double", 35.0), ("angle", "double", 45.0), ("shape", "string", "round"), ("cleanup", "string", "standard"), ("cleanup_mode", "string", "area"), ("knockout", "boolean", True),
    ("key", "string", "#000000"), ("tolerance", "double", 2.0), ("softness", "double", 35.0), ("recover", "boolean", False), ("strength", "double", 100.0), ("gamma", "double", 1.0),
    ("input_black", "double", 0.0), ("input_midtone", "double", 1.0), ("input_white", "double", 255.0), ("output_black", "double", 0.0), ("output_white", "double", 255.0),
    ("min_diameter_mm", "double", None), ("origin_x", "double", 0.0), ("origin_y", "double", 0.0), ("halftone", "boolean", True), ("alpha_threshold", "double", 128.0), ("shadow_boost", "double", 0.0),
    ("color_boost", "double", 0.0), ("defringe", "boolean", False), ("defringe_radius", "int", 2), ("defringe_strength", "double", 100.0), ("edge_contrast", "double", 96.0), ("edge_radius", "int", 1),
    ("fill_holes_mm", "double", 0.0), ("solid_above", "double", 100.0), ("gain_points", "string", ""), ("line_trim", "double", 0.0), ("presmooth", "int", 0), ("protection", "string", "off"),
)
#: Cleanup level -> (least coverage that prints, smallest diameter in mm).
LEVELS = {"none": (0.0, 0.0), "low": (0.01, 0.12), "standard": (0.03, 0.2), "high": (0.06, 0.3)}
#: Fixed values: (name, least, most).
RANGES = (
    ("lpi", 5, 150), ("angle", -180, 180), ("tolerance", 0, 99), ("softness", 0.1, 100), ("strength", 1, 100), ("gamma", 0.25, 4), ("input_black", 0, 254), ("input_midtone", 0.1, 9.99),
    ("input_white", 1, 255), ("output_black", 0, 255), ("output_white", 0, 255), ("alpha_threshold", 1, 255), ("shadow_boost", 0, 100), ("color_boost", 0, 100), ("defringe_radius", 1, 4),
    ("defringe_strength", 0, 100), ("edge_contrast", 16, 255), ("edge_radius", 1, 4), ("fill_holes_mm", 0, 1), ("solid_above", 50, 100), ("line_trim", 0, 10), ("min_diameter_mm", 0, 2),
)
#: Allowed words.
WORDS = {
    "shape": ("round", "euclidean", "ellipse", "square", "diamond", "line"), "cleanup": tuple(LEVELS), "cleanup_mode": ("area", "opening"), "protection": ("off", "edges", "selection"),
}
#: Presets (what they have in common, then what each changes). They never set a size, the calibration curve or prices.
PRESET_BASE = {
    "shape": "round", "lpi": 30.0, "angle": 33.0, "cleanup": "standard", "min_diameter_mm": 0.2, "input_black": 7.0, "input_midtone": 2.0, "input_white": 100.0, "output_black": 0.0,
    "output_white": 255.0, "shadow_boost": 0.0, "color_boost": 0.0, "knockout": True, "key": "#000000", "tolerance": 2.0, "softness": 35.0, "recover": False, "defringe": False, "halftone": True,
    "fill_holes_mm": 0.0, "solid_above": 100.0, "protection": "off", "line_trim": 0.0, "cleanup_mode": "area", "presmooth": 0,
}
PRESETS = {
    "dark-photo": {"fill_holes_mm": 0.25, "solid_above": 95.0},
    "dark-fine": {"lpi": 40.0, "angle": 22.5, "cleanup": "low", "min_diameter_mm": 0.12, "fill_holes_mm": 0.2, "solid_above": 97.0},
    "light-logo": {"key": "#ffffff", "lpi": 35.0, "angle": 45.0, "cleanup": "low", "min_diameter_mm": 0.12, "softness": 25.0, "input_black": 0.0, "input_midtone": 1.0, "input_white": 255.0},
    "vintage": {"lpi": 25.0, "angle": 45.0, "cleanup": "low", "min_diameter_mm": 0.12, "input_black": 20.0, "input_midtone": 1.4, "input_white": 190.0},
    "engraving": {"shape": "line", "lpi": 30.0, "angle": 45.0, "fill_holes_mm": 0.2, "line_trim": 3.0},
    "dark-euclid": {"shape": "euclidean", "presmooth": 2, "cleanup_mode": "opening", "fill_holes_mm": 0.25, "solid_above": 95.0},
    "knockout-only": {"halftone": False, "cleanup": "none", "min_diameter_mm": 0.0, "input_black": 0.0, "input_midtone": 1.0, "input_white": 255.0},
}

SCHEMA = "recipe_id long, " + ", ".join(f"{n} {t}" for n, t, _ in DEFAULTS)
NAMES = [n for n, _, _ in DEFAULTS]


def recipes(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A recipe table from dicts; options that are left out are null until with_defaults()."""
    return spark.createDataFrame([(r["recipe_id"], *(r.get(n) for n in NAMES)) for r in rows], SCHEMA)


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls become defaults; a missing diameter is that of the cleanup level, and zero without cleanup. Adds alpha_floor, the key's
    key_r, key_g, key_b, and gain, the points of the gain curve (null without)."""
    filled = {n: F.coalesce(F.col(n), F.lit(d).cast(t)) for n, t, d in DEFAULTS if d is not None}
    out = df.withColumns(filled)
    level = lambda i: _case("cleanup", {k: v[i] for k, v in LEVELS.items()})
    key = hex_rgb(F.col("key"))
    return out.withColumns(
        {"min_diameter_mm": F.when(F.col("cleanup") == "none", 0.0).otherwise(F.coalesce("min_diameter_mm", level(1))), "alpha_floor": level(0), "key_r": key["r"], "key_g": key["g"], "key_b": key["b"], "gain": parse_gain(F.col("gain_points"))["points"]}
    )


def _case(name: str, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = (F.when if out is None else out.when)(F.col(name) == k, F.lit(v))
    return out


def violations(dpi: float = 300.0) -> Column:
    """array of the rules that a row with defaults breaks."""
    rules = [F.when(~((F.col(n) >= lo) & (F.col(n) <= hi)) | F.isnan(n), n) for n, lo, hi in RANGES]
    rules += [F.when(~F.col(n).isin(*words), n) for n, words in WORDS.items()]
    rules += [
        F.when(F.col("input_black") >= F.col("input_white"), "input black and white"), F.when(F.col("output_black") > F.col("output_white"), "output black and white"),
        F.when(~F.col("presmooth").isin(0, 1, 2), "presmooth"), F.when(F.col("halftone") & (F.lit(dpi) / F.col("lpi") < 4), "resolution"), F.when(hex_rgb(F.col("key")).isNull(), "key"),
        F.when(parse_gain(F.col("gain_points"))["error"].isNotNull(), "gain_points"),
    ]
    return F.array_compact(F.array(*rules))


def presets(spark: SparkSession) -> DataFrame:
    """(preset_id, all options that presets set): 7 rows."""
    schema = "preset_id string, " + ", ".join(f"{n} {t}" for n, t, _ in DEFAULTS if n in PRESET_BASE)
    names = [n for n in NAMES if n in PRESET_BASE]
    return spark.createDataFrame([(k, *((PRESET_BASE | v)[n] for n in names)) for k, v in PRESETS.items()], schema)


def apply_preset(df: DataFrame, preset_id: str = "preset_id") -> DataFrame:
    """Rows with a known preset get its options; all others stay."""
    p = presets(df.sparkSession)
    own = [c for c in p.columns if c != "preset_id"]
    p = p.select(F.col("preset_id").alias("__preset"), *(F.col(c).alias(f"__{c}") for c in own))
    out = df.join(F.broadcast(p), df[preset_id] == p["__preset"], "left")  # 7 rows
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in own if c in df.columns}).select(*df.columns)
