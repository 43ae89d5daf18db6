"""Recipes as JSON values: what may stand in one, key by key. A recipe with anything else is rejected whole, with the reason; keys that aren't known are dropped."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid import schema
from inkgrid.functions.color import hex_rgb
from inkgrid.functions.options import DEFAULTS, NAMES, violations, with_defaults

#: Kinds of the known keys, by the data model, in the order in which they are looked at.
KINDS = [(kind, k) for kind in ("double", "boolean", "string") for k, t in re.findall(r"(\w+):(\w+)", schema.OPTIONS) if t == kind]
_TYPES = {"double": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "string": "^STRING"}
_SAYS = {"double": "number", "boolean": "boolean", "string": "text"}
#: Words of options that don't decide pixels.
WORDS = {
    "memoryMode": ("auto", "disk"), "protection": ("off", "edges", "selection"), "units": ("cm", "in"), "garment": ("adult", "child"), "sizeAxis": ("width", "height"), "placement": ("front", "back", "chest", "sleeve", "neck"),
    "previewScope": ("detail", "overview", "mockup"), "whiteFormat": ("blackOnWhite", "alpha", "whiteOnBlack"), "viewMode": ("original", "garment", "beforeGarment", "compare", "transparent", "mask", "removed", "protection"),
}
#: Positions and sizes of print areas.
POSITIONS, SIZES = WORDS["placement"], ("XS", "S", "M", "L", "XL", "2XL", "3XL", "2", "4", "6", "8", "10", "12")
#: Above which these are at least, or from which on, and their most.
MEASURES, PERCENTS = ("widthCM", "heightCM"), ("focusX", "focusY", "comparePosition", "mockupX", "mockupY")


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def kind(v: Column) -> Column:
    """The type of a variant's value in words; VOID for JSON's null, null for none."""
    return F.schema_of_variant(v)


def mistyped(v: Column) -> Column:
    """Why a variant can't be a recipe's options: not an object, or the first known key whose value is of another type, or a text of over 80 characters. Null if it can. JSON's null is like no key."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    place, type_, says = (_map({k: x(i, t) for i, (t, k) in enumerate(KINDS)}) for x in (lambda i, t: i, lambda i, t: _TYPES[t], lambda i, t: _SAYS[t]))
    long = lambda x: F.coalesce(F.length(F.try_variant_get(x, "$", "string")) > 80, F.lit(False))
    wrong = lambda e: type_[e["key"]].isNotNull() & (kind(e["value"]) != "VOID") & (~F.regexp_like(kind(e["value"]), type_[e["key"]]) | (kind(e["value"]).startswith("STRING") & long(e["value"])))
    first = F.array_min(F.transform(F.filter(entries, wrong), lambda e: F.struct(place[e["key"]].alias("place"), F.concat(says[e["key"]], F.lit(": "), e["key"]).alias("says"))))
    return F.when(v.isNull(), None).when(~F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False)), "options").otherwise(first["says"])


def odd_areas(v: Column) -> Column:
    """`areas` if a variant can't be print areas by position and size: pairs of numbers above 0, 100 at most. Null if it can, or if there is none."""
    cells = F.flatten(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda p: F.coalesce(
        F.transform(F.map_entries(F.try_variant_get(p["value"], "$", "map<string,variant>")), lambda s: F.struct(p["key"].alias("position"), s["key"].alias("size"), F.try_variant_get(s["value"], "$", "array<variant>").alias("sides"))),
        F.array(F.struct(F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("size"), F.lit(None).cast("array<variant>").alias("sides"))),
    )))
    side = lambda x: F.regexp_like(kind(x), F.lit(_TYPES["double"])) & (F.try_variant_get(x, "$", "double") > 0) & (F.try_variant_get(x, "$", "double") <= 100)
    good = lambda c: F.coalesce(c["position"].isin(*POSITIONS) & c["size"].isin(*SIZES) & (F.size(c["sides"]) == 2) & F.forall(c["sides"], lambda x: F.coalesce(side(x), F.lit(False))), F.lit(False))
    named = F.forall(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda k: k.isin(*POSITIONS))
    return F.when(v.isNotNull() & ~F.coalesce(named & F.forall(cells, good), F.lit(False)), "areas")


def out_of_range(df: DataFrame, o: str) -> DataFrame:
    """Adds `broken`: the first rule that the typed options in column o break, null if none."""
    snake = {re.sub("(?<=[a-z])(?=[A-Z])", "_", k).lower(): k for _, k in KINDS}
    own = df.withColumn("__row", F.struct("*")).select("__row", *(F.col(f"{o}.{snake[n]}").cast(t).alias(n) if n in snake else F.lit(None).cast(t).alias(n) for n, t, _ in DEFAULTS))
    broken = with_defaults(own).select("__row", violations().alias("rules"), *NAMES).select("__row.*", F.get("rules", F.lit(0)).alias("rule"))
    c = lambda k: F.col(f"{o}.{k}")
    whole = [F.when(c(snake[n]) != F.floor(c(snake[n])), n) for n, t, _ in DEFAULTS if t == "int" and n in snake]
    words = [F.when(~c(k).isin(*w), k) for k, w in WORDS.items()]
    rest = [F.when(c("previewColor").isNotNull() & (c("previewColor") != "") & hex_rgb(c("previewColor")).isNull(), "previewColor")]
    rest += [F.when((c(k) <= 0) | (c(k) > 1000), k) for k in MEASURES] + [F.when((c(k) < 0) | (c(k) > 100), k) for k in PERCENTS]
    return broken.withColumn("broken", F.coalesce("rule", *whole, *words, *rest)).drop("rule")
