"""Dot gain: measured curves and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_POINTS = 10
_PAIR = r"^([0-9]+(?:\.[0-9]+)?):([0-9]+(?:\.[0-9]+)?)$"


def parse_gain(text: Column) -> Column:
    """struct(points, error) of pairs nominal:measured, in percent, divided by blanks, commas or semicolons. points, by nominal: null without a
    curve or with an error; error: the first rule that fails, or null."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,;]+"), lambda p: p != "")
    ok = F.forall(parts, lambda p: p.rlike(_PAIR))
    point = lambda p: F.struct(F.regexp_extract(p, _PAIR, 1).try_cast("double").alias("nominal"), F.regexp_extract(p, _PAIR, 2).try_cast("double").alias("measured"))
    points = F.array_sort(F.transform(F.filter(parts, lambda p: p.rlike(_PAIR)), point))
    before = lambda i, field: F.when(i == 0, F.lit(0.0)).otherwise(F.get(points, i - 1)[field])
    any_ = lambda f: F.exists(F.transform(points, f), lambda b: b)
    error = (
        F.when(F.size(parts) == 0, F.lit(None))
        .when(F.size(parts) > MOST_POINTS, "too many pairs")
        .when(~ok, "not a pair")
        .when(any_(lambda p, i: ~((p["nominal"] > 0) & (p["nominal"] < 100))), "nominal out of range")
        .when(any_(lambda p, i: ~((p["measured"] >= 0) & (p["measured"] <= 100))), "measured out of range")
        .when(any_(lambda p, i: p["nominal"] <= before(i, "nominal")), "nominal repeats")
        .when(any_(lambda p, i: p["measured"] <= before(i, "measured")), "measured does not grow")
        .when(F.element_at(points, -1)["measured"] >= 100, "last measured is full")
    )
    return F.struct(F.when(error.isNull() & (F.size(parts) > 0), points).alias("points"), error.alias("error"))


def compensate_gain(v: Column, points: Column) -> Column:
    """The coverage to ask for so that v prints: the inverse of the curve, in straight lines between its points. No curve: v."""
    d, full = v * 100.0, F.struct(F.lit(100.0).alias("nominal"), F.lit(100.0).alias("measured"))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), none.alias("out"))

    def step(s: Column, k: Column) -> Column:
        between = (s["n"] + (k["nominal"] - s["n"]) * (d - s["m"]) / (k["measured"] - s["m"])) / 100.0
        return F.struct(k["nominal"].alias("n"), k["measured"].alias("m"), F.coalesce(s["out"], F.when(k["measured"] >= d, between)).alias("out"))

    line = F.aggregate(F.concat(points, F.array(full)), start, step, lambda s: s["out"])
    return F.when(points.isNull(), v).when(d <= 0, F.lit(0.0)).when(d >= 100, F.lit(1.0)).otherwise(line)


def gain_summary(points: Column, tones: tuple[int, ...] = (10, 30, 50, 70, 90)) -> Column:
    """The tone to ask for, in whole percent, for each wanted tone."""
    return F.transform(F.array(*(F.lit(t / 100.0) for t in tones)), lambda t: F.round(compensate_gain(t, points) * 100.0).cast("int"))


def gain_segments(curves: DataFrame) -> DataFrame:
    """curves: (curve_id, nominal, measured). (curve_id, lo, hi, nominal_lo, nominal_hi): pieces of the inverse, from 0 to 100."""
    ends = curves.select("curve_id").distinct().select("curve_id", F.explode(F.array(F.lit(0.0), F.lit(100.0))).alias("nominal")).withColumn("measured", F.col("nominal"))
    w = Window.partitionBy("curve_id").orderBy("measured")
    k = curves.select("curve_id", "nominal", "measured").unionByName(ends)
    k = k.withColumn("lo", F.lag("measured").over(w)).withColumn("nominal_lo", F.lag("nominal").over(w))
    return k.where("lo is not null").select("curve_id", "lo", F.col("measured").alias("hi"), "nominal_lo", F.col("nominal").alias("nominal_hi"))


def gain_errors(curves: DataFrame) -> DataFrame:
    """curves: (curve_id, nominal, measured). Rows whose measured value or nominal tone doesn't grow from the row before."""
    w = Window.partitionBy("curve_id").orderBy("nominal", "measured")
    k = curves.withColumn("before_n", F.coalesce(F.lag("nominal").over(w), F.lit(0.0))).withColumn("before_m", F.coalesce(F.lag("measured").over(w), F.lit(0.0)))
    return k.where("nominal <= before_n or measured <= before_m").select("curve_id", "nominal", "measured")


def compensate_by_segments(values: DataFrame, segments: DataFrame, value: str = "value") -> DataFrame:
    """values: (curve_id, value, ...). Adds `requested`, by a range join on the segments of the row's curve: lo < 100 value <= hi."""
    d = F.col(value) * 100.0
    joined = values.join(segments, (values["curve_id"] == segments["curve_id"]) & (d > segments["lo"]) & (d <= segments["hi"]), "left").drop(segments["curve_id"])
    between = (F.col("nominal_lo") + (F.col("nominal_hi") - F.col("nominal_lo")) * (d - F.col("lo")) / (F.col("hi") - F.col("lo"))) / 100.0
    requested = F.when(d <= 0, F.lit(0.0)).when(d >= 100, F.lit(1.0)).otherwise(F.coalesce(between, F.col(value)))
    return joined.withColumn("requested", requested).drop("lo", "hi", "nominal_lo", "nominal_hi")
