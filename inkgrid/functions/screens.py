"""Halftone screens: the threshold at a place, and tables that equalise spot functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHAPES = ("round", "euclidean", "ellipse", "square", "diamond", "line")
#: Shapes whose threshold is looked up, bins of their tables, and samples of a cell per axis.
LOOKED_UP, BINS, SAMPLES = ("ellipse", "euclidean"), 8192, 512


def cell_places(x: Column, y: Column, lpi: Column, angle: Column, dpi: float | Column = 300.0, origin_x: float | Column = 0.0, origin_y: float | Column = 0.0) -> tuple[Column, Column]:
    """A pixel's centre along the axes of the cells, in cells."""
    gx, gy, theta = x + origin_x + 0.5, y + origin_y + 0.5, angle * F.lit(math.pi) / 180.0
    cell = dpi / lpi if isinstance(dpi, Column) else F.lit(float(dpi)) / lpi
    return (gx * F.cos(theta) + gy * F.sin(theta)) / cell, (-gx * F.sin(theta) + gy * F.cos(theta)) / cell


def off_centre(place: Column) -> Column:
    """The distance, 0 to 1/2, from the centre of the cell."""
    return F.abs(place - F.floor(place) - 0.5)


def cell_offsets(x: Column, y: Column, lpi: Column, angle: Column, dpi: float | Column = 300.0, origin_x: float | Column = 0.0, origin_y: float | Column = 0.0) -> tuple[Column, Column]:
    """Distances (u, v) of a pixel's centre from the centre of its cell, along the cell's axes."""
    u, v = cell_places(x, y, lpi, angle, dpi, origin_x, origin_y)
    return off_centre(u), off_centre(v)


def spot_bin(u: Column, v: Column, shape: Column | str) -> Column:
    """The bin of a shape that is looked up."""
    shape = F.lit(shape) if isinstance(shape, str) else shape
    ellipse = (u * u + 4.0 * v * v) / 1.25
    a, b = 2.0 * u, 2.0 * v
    euclidean = F.when(a + b <= 1, a * a + b * b).otherwise(2.0 - ((a - 1.0) * (a - 1.0) + (b - 1.0) * (b - 1.0))) / 2.0
    return F.least(F.lit(BINS - 1), F.floor(F.when(shape == "ellipse", ellipse).otherwise(euclidean) * float(BINS))).cast("int")


def radius(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def threshold(u: Column, v: Column, shape: Column, trim: Column, looked_up: Column | None = None, r: Column | None = None) -> Column:
    """The coverage from which ink is printed there. trim: percent of a line's profile cut at both ends; looked_up: the table's value for
    shapes that have one; r: radius(u, v), if it is at hand."""
    r = radius(u, v) if r is None else r
    disc = F.lit(math.pi) * r * r
    outside = disc - 4.0 * (r * r * F.acos(F.least(F.lit(1.0), 0.5 / r)) - 0.5 * F.sqrt(F.greatest(F.lit(0.0), r * r - 0.25)))
    round_ = F.when(r <= 0.5, disc).when(r >= math.sqrt(0.5), F.lit(1.0)).otherwise(outside)
    s, side, t = u + v, F.greatest(u, v), trim / 100.0
    diamond = F.when(s <= 0.5, 2.0 * s * s).otherwise(1.0 - 2.0 * (1.0 - s) * (1.0 - s))
    line = F.when(trim > 0, t + (1.0 - 2.0 * t) * 2.0 * v).otherwise(2.0 * v)
    chosen = F.when(shape == "square", 4.0 * (side * side)).when(shape == "diamond", diamond).when(shape == "line", line)
    if looked_up is not None:
        chosen = chosen.when(shape.isin(*LOOKED_UP), looked_up)
    return chosen.otherwise(round_)


def spot_cdf(spark: SparkSession, shapes: tuple[str, ...] = LOOKED_UP) -> DataFrame:
    """(shape, bin, cdf): the share of a cell's 512 x 512 sample points up to each bin, as a 32-bit float. 8192 rows a shape."""
    at = F.expr(f"(i + 0.5D) / {SAMPLES}D - 0.5D")
    axis = spark.range(SAMPLES).withColumnRenamed("id", "i")
    points = axis.select(F.abs(at).alias("u")).withColumn("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.abs((i + 0.5) / float(SAMPLES) - 0.5))))
    points = points.withColumn("shape", F.explode(F.array(*map(F.lit, shapes))))
    counts = points.groupBy("shape", spot_bin(F.col("u"), F.col("v"), F.col("shape")).alias("bin")).count()
    bins = spark.range(BINS).select(F.col("id").cast("int").alias("bin")).withColumn("shape", F.explode(F.array(*map(F.lit, shapes))))
    full = bins.join(counts, ["shape", "bin"], "left")
    running = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy("shape").orderBy("bin"))
    return full.select("shape", "bin", (running / float(SAMPLES * SAMPLES)).cast("float").cast("double").alias("cdf"))


def tone_response(grid: DataFrame, side: int = 320, angle: float = 45.0) -> DataFrame:
    """grid: (shape, lpi, tone), tone in percent. (shape, lpi, tone, printed): the share of a patch of side x side pixels that prints."""
    spark = grid.sparkSession
    p = grid.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    u, v = cell_offsets(F.col("x"), F.col("y"), F.col("lpi"), F.lit(angle))
    p = p.withColumn("u", u).withColumn("v", v).withColumn("bin", F.when(F.col("shape").isin(*LOOKED_UP), spot_bin(F.col("u"), F.col("v"), F.col("shape"))))
    p = p.join(F.broadcast(spot_cdf(spark)), ["shape", "bin"], "left")  # 16,384 rows
    ink = F.col("tone") / 100.0 > threshold(F.col("u"), F.col("v"), F.col("shape"), F.lit(0.0), F.col("cdf"))
    return p.groupBy("shape", "lpi", "tone").agg(F.avg(ink.cast("double")).alias("printed"))
