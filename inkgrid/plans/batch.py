"""Batch jobs: images x sizes x positions, their checks, their run and what is left of them after a stop.

Errors are values of a row; a bad source or variant never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import names, sizing
from inkgrid.functions.options import with_defaults
from inkgrid.sources.workspace import stage, workspace


def make_variants(files: DataFrame, sizes: list[str], placements: list[str], garment: str = "adult", assignments: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """A row for each image, size and position, in that order, with dense ids from 0.

    files: (image_idx, name, recipe_id). assignments: (image_idx, sizes, placements, garment, recipe_id), nulls keep the job's; an empty list gives the image no
    variant. Sizes and positions that repeat count once. areas: custom print areas by position and size.
    """
    f = files.select("image_idx", "name", "recipe_id")
    if assignments is None:
        f = f.withColumns({"sizes": F.lit(None).cast("array<string>"), "placements": F.lit(None).cast("array<string>"), "garment": F.lit(None).cast("string")})
    else:
        a = assignments.select("image_idx", "sizes", "placements", "garment", F.col("recipe_id").alias("own_recipe"))
        f = f.join(a.hint("merge"), "image_idx", "left").withColumn("recipe_id", F.coalesce("own_recipe", "recipe_id")).drop("own_recipe")
    listed = lambda c, d: F.array_distinct(F.coalesce(F.col(c), F.array(*map(F.lit, d)).cast("array<string>")))
    f = f.withColumns({"sizes": listed("sizes", sizes), "placements": listed("placements", placements), "garment": F.coalesce("garment", F.lit(garment))})
    v = f.select("image_idx", "name", "recipe_id", "garment", "placements", F.posexplode("sizes").alias("size_pos", "size"))
    v = v.select("image_idx", "name", "recipe_id", "garment", "size_pos", "size", F.posexplode("placements").alias("place_pos", "placement"))
    v = sizing.print_area(v, areas)
    v = dense_ids(v, "image_idx", ["size_pos", "place_pos"])
    output = F.concat_ws("/", "size", names.output_name(F.col("image_idx"), F.col("name"), F.col("size"), F.col("placement")))
    problem = F.when(F.col("area_w").isNull(), "size or position").when(~(F.col("area_w").between(0.0001, 100) & F.col("area_h").between(0.0001, 100)), "area")
    return v.select("id", "image_idx", F.col("name").alias("image"), "size", "placement", "garment", "recipe_id", "area_w", "area_h", F.when(problem.isNull(), "pending").otherwise("error").alias("status"), output.alias("output"), F.lit(300.0).alias("dpi"), problem.alias("error"))


def dense_ids(df: DataFrame, major: str, minor: list[str], block: int = 4096) -> DataFrame:
    """Adds id: 0, 1, ... in the order of major (an integer), then minor. Counts are added up within blocks of major values, and blocks (a row for each) in one task."""
    counts = df.groupBy(major).count().withColumn("__b", F.floor(F.col(major) / block))
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("__b").agg(F.sum("count").alias("count")).select("__b", before(Window.orderBy("__b")).alias("__base"))
    first = counts.withColumn("__in", before(Window.partitionBy("__b").orderBy(major))).join(blocks, "__b").select(F.col(major).alias("__m"), (F.col("__base") + F.col("__in")).alias("__first"))
    own = F.row_number().over(Window.partitionBy(major).orderBy(*minor)) - 1
    return df.withColumn("__own", own).join(first, F.col(major) == F.col("__m")).withColumn("id", F.col("__first") + F.col("__own")).drop("__m", "__first", "__own")


def places_within(df: DataFrame, group: str, by: str, block: int = 4096) -> DataFrame:
    """Adds place: 0, 1, ... within each group in the order of `by` (an integer). Places are counted within blocks of `by`, and a group's blocks (a row for each) are added up, so a group with most of the rows is many tasks' work."""
    dealt = df.withColumn("__b", F.floor(F.col(by) / block))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = dealt.groupBy(group, "__b").agg(F.count("*").alias("__n")).select(F.col(group).alias("__g"), F.col("__b").alias("__k"), before.alias("__base"))
    own = F.row_number().over(Window.partitionBy(group, "__b").orderBy(by)) - 1
    joined = dealt.withColumn("__own", own).join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__k")))
    return joined.withColumn("place", F.col("__base") + F.col("__own")).drop("__b", "__own", "__g", "__k", "__base")


def preflight(variants: DataFrame, artworks: DataFrame, recipes: DataFrame, disk_budget_gb: float = 0.0) -> DataFrame:
    """Ready rows with plan, resources and warnings, and error rows. artworks: (image_idx, width, height, error): size of the (trimmed) art, or why a source can't be read."""
    v = variants.drop("error").join(artworks.select("image_idx", "width", "height", F.col("error").alias("source_error")).hint("merge"), "image_idx", "left").join(with_defaults(recipes), "recipe_id", "left")
    cm = sizing.fit_width_cm(F.col("width"), F.col("height"), F.col("area_w"), F.col("area_h"))
    v = v.withColumn("plan", sizing.print_plan(F.col("width"), F.col("height"), F.lit(300.0), "width", cm))
    v = v.withColumn("res", sizing.resources(F.col("plan.width"), F.col("plan.height"), F.lit(False), F.col("protection") == "selection"))
    o = {c: F.col(c) for c in ("min_diameter_mm", "lpi", "halftone", "cleanup", "cleanup_mode", "protection")}
    warnings = F.array_compact(F.concat(sizing.quality_warnings(o), F.array(F.when(F.col("plan.upscaled"), "upscaled"))))
    error = (
        F.when(F.col("status") == "error", "area").when(F.col("width").isNull() & F.col("source_error").isNull(), "no source").when(F.col("source_error").isNotNull(), F.col("source_error"))
        .when(F.col("lpi").isNull(), "no recipe").when(F.col("plan.error").isNotNull(), F.col("plan.error"))
        .when(F.lit(disk_budget_gb > 0) & (F.col("res.recommended_bytes") > disk_budget_gb * 1e9), "disk budget")
    )
    v = v.withColumn("problem", error)
    ready = v.where("problem is null").select("id", "image", "size", "placement", F.lit("ready").alias("status"), F.col("plan.width").alias("width_px"), F.col("plan.height").alias("height_px"), F.col("res.recommended_bytes").alias("recommended_bytes"), F.concat_ws(",", warnings).alias("warnings"), F.lit(None).cast("string").alias("error"))
    bad = v.where("problem is not null").select("id", "image", "size", "placement", F.lit("error").alias("status"), F.col("problem").alias("error"))
    return ready.unionByName(bad, allowMissingColumns=True)


def same_identity(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(name, same): whether a source is as the job recorded it: same name, and same size and date where these were recorded. Both: (name, size_bytes, modified)."""
    n = now.select("name", F.col("size_bytes").alias("now_size"), F.col("modified").alias("now_modified"), F.lit(True).alias("there"))
    joined = recorded.select("name", "size_bytes", "modified").join(n, "name", "left")
    agrees = lambda a, b: F.col(a).isNull() | F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return joined.select("name", (F.coalesce("there", F.lit(False)) & agrees("size_bytes", "now_size") & agrees("modified", "now_modified")).alias("same"))


def export_check(stats: DataFrame, expected: DataFrame) -> DataFrame:
    """(output, ok, problem): whether an output may be kept. stats: (output, width, height, dpi, odd_alpha, ink_pixels); expected: (output, width_px, height_px)."""
    j = expected.join(stats, "output", "left")
    problem = (
        F.when(F.col("width").isNull(), "missing").when(F.col("odd_alpha") > 0, "alpha").when(F.col("ink_pixels") <= 0, "empty")
        .when((F.col("width") != F.col("width_px")) | (F.col("height") != F.col("height_px")), "size").when(F.col("width").cast("long") * F.col("height") > sizing.MOST_PIXELS, "too many pixels")
        .when(F.abs(F.col("dpi") - sizing.OUTPUT_DPI) > 0.5, "resolution")
    )
    return j.select("output", problem.isNull().alias("ok"), problem.alias("problem"))


def pending(variants: DataFrame, verified: DataFrame, white: Column | None = None) -> DataFrame:
    """Variants without a verified output. verified: (output). With `white` (whether a variant wants a white twin), the twin must be verified too."""
    white = F.lit(False) if white is None else white
    have = verified.select("output").distinct()
    needs = variants.withColumn("needs", F.when(white, F.array(F.col("output"), names.white_name(F.col("output")))).otherwise(F.array("output")))
    lacking = needs.select("id", F.explode("needs").alias("output")).join(have, "output", "left_anti").select("id").distinct()
    return variants.join(lacking, "id", "left_semi")


def free_names(wanted: DataFrame, taken: DataFrame, white: bool = False) -> DataFrame:
    """Adds free: the wanted output, or the first of base_r2, base_r3, ... that isn't taken (with `white`, whose twin isn't either). wanted, taken: (output)."""
    pattern = r"^(.*?)(?:_r([0-9]+))?(_blanco)?\.png$"
    t = taken.select(F.concat(F.regexp_extract("output", pattern, 1), F.lit(".png")).alias("output"), F.coalesce(F.regexp_extract("output", pattern, 2).try_cast("int"), F.lit(1)).alias("n"), (F.regexp_extract("output", pattern, 3) != "").alias("twin"))
    if not white:
        t = t.where("not twin")
    used = t.groupBy("output").agg(F.collect_set("n").alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), F.col("used")))
    out = wanted.join(used, "output", "left").withColumn("n", F.coalesce(free, F.lit(1)))
    return out.withColumn("free", F.when(F.col("n") == 1, F.col("output")).otherwise(F.regexp_replace("output", r"\.png$", F.concat(F.lit("_r"), F.col("n").cast("string"), F.lit(".png"))))).drop("used", "n")


def batch_summary(variants: DataFrame) -> DataFrame:
    """One row: done, errors, cancelled and all."""
    n = lambda s: F.count_if(F.col("status") == s)
    return variants.agg(n("done").alias("done"), n("error").alias("errors"), n("cancelled").alias("cancelled"), F.count("*").alias("all"))


def report_lines(rows: DataFrame) -> DataFrame:
    """(id, line) of the CSV report: the fixed fields, all quoted. Fields that rows lacks are empty."""
    text = {"image", "size", "placement", "status", "output", "whiteOutput", "error"}
    return rows.select("id", names.csv_line([(F.col(f) if f in rows.columns else F.lit(None).cast("string"), f in text) for f in names.REPORT_FIELDS]).alias("line"))


#: (name, type, default) of what a job may say beside a recipe's options: whether art is trimmed to what isn't transparent, and whether a white twin is made and how.
SETTINGS = (("trim_art", "boolean", False), ("batch_white", "boolean", False), ("white_choke_mm", "double", 0.15), ("white_format", "string", "blackOnWhite"), *((k, "double", v) for k, v in sizing.DEFAULT_PRICES.items()))
WHITE_FORMATS = ("blackOnWhite", "alpha", "whiteOnBlack")


def settings_of(recipes: DataFrame, settings: DataFrame | None) -> DataFrame:
    """(recipe_id, SETTINGS) for each recipe; settings: (recipe_id, some of them), nulls and missing rows are defaults."""
    s = recipes.select("recipe_id")
    s = s.join(settings, "recipe_id", "left") if settings is not None else s
    return s.select("recipe_id", *(F.coalesce(F.col(n), F.lit(d).cast(t)).alias(n) if n in s.columns else F.lit(d).cast(t).alias(n) for n, t, d in SETTINGS))


def run_batch(
    variants: DataFrame, tiles: DataFrame, artworks: DataFrame, recipes: DataFrame, core: int = 512, settings: DataFrame | None = None, taken: DataFrame | None = None, path: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(output tiles, white twins' tiles, report): each variant's art, trimmed if its recipe says so, at its print size, screened and cleaned by tiles.

    artworks: (image_idx, image_id, width, height); settings: of settings_of(); taken: (output), files that are there already and aren't written over. The source is resampled
    for each variant before its own screen. The report has a row for each variant: done with sizes, counts, ink, cost (where anything has a price) and free names, or
    error; an error of one leaves the others as they are. If a white twin can't be made, neither file of the pair is.

    The run has four stages, each a table below `path` (a new one without): plan, tiles, white, report. White twins and report are made of the written tiles, so nothing is resampled or screened twice; the same job run again with
    the same path goes on behind the last finished stage.
    """
    from inkgrid.operators.process import process_tiles, white_tiles
    from inkgrid.operators.resample import resample_tiles

    spark = variants.sparkSession
    path = path or workspace(spark, "batch")
    full, extra = with_defaults(recipes), settings_of(recipes, settings)
    v = stage(spark, f"{path}/plan", lambda: _planned(variants, tiles, artworks, extra))
    good = v.where("problem is null")
    art = good.select(F.col("id").alias("image_id"), F.col("plan.width").cast("int").alias("width"), F.col("plan.height").cast("int").alias("height"), "recipe_id", "batch_white", F.col("white_choke_mm").alias("choke_mm"))

    def printed() -> DataFrame:
        jobs = good.select(F.col("id").alias("variant_id"), "image_id", "width", "height", F.col("plan.width").cast("int").alias("out_width"), F.col("plan.height").cast("int").alias("out_height"), "from_x", "from_y", "recipe_id")  # with its recipe a print is screened where it was resampled
        return process_tiles(resample_tiles(tiles, jobs, core).withColumnRenamed("variant_id", "image_id"), art, full, core)

    out = stage(spark, f"{path}/tiles", printed)
    white = stage(spark, f"{path}/white", lambda: white_tiles(out, art.where("batch_white"), core=core))
    return out, white, stage(spark, f"{path}/report", lambda: _reported(v, out, taken))


def _planned(variants: DataFrame, tiles: DataFrame, artworks: DataFrame, extra: DataFrame) -> DataFrame:
    """The variants with settings, the part of the art that they print (from_x, from_y, width, height), their plan, and why they can't be made (problem)."""
    from inkgrid.operators.tiles import tile_bounds

    v = variants.join(artworks.select("image_idx", "image_id", F.col("width").alias("art_width"), F.col("height").alias("art_height")).hint("merge"), "image_idx", "left").join(extra, "recipe_id", "left")
    if extra.where("trim_art").isEmpty():  # a question to the recipes
        v = v.withColumns({"from_x": F.lit(0), "from_y": F.lit(0), "width": F.col("art_width"), "height": F.col("art_height"), "bare": F.lit(False)})
    else:
        box = tile_bounds(tiles)  # of a tile four numbers are moved, and not its pixels to leave some art out
        v = v.join(box.select("image_id", *(F.col(c).alias(f"box_{c}") for c in ("left", "top", "width", "height"))), "image_id", "left")
        cut = lambda c, whole: F.when(F.col("trim_art"), F.col(c)).otherwise(whole)
        v = v.withColumns({"from_x": cut("box_left", F.lit(0)), "from_y": cut("box_top", F.lit(0)), "width": cut("box_width", F.col("art_width")), "height": cut("box_height", F.col("art_height")), "bare": F.col("trim_art") & F.col("box_left").isNull()})
    cm = sizing.fit_width_cm(F.col("width"), F.col("height"), F.col("area_w"), F.col("area_h"))
    v = v.withColumn("plan", F.when(F.col("width").isNotNull(), sizing.print_plan(F.col("width"), F.col("height"), F.lit(300.0), "width", cm)))
    problem = (
        F.when(F.col("status") == "error", F.coalesce("error", F.lit("area"))).when(F.col("art_width").isNull(), "no source").when(F.col("bare"), "empty").when(F.col("trim_art").isNull(), "no recipe")
        .when(F.col("batch_white") & ~F.col("white_format").isin(*WHITE_FORMATS), "white format").otherwise(F.col("plan.error"))
    )
    return v.withColumn("problem", problem)


def _reported(v: DataFrame, out: DataFrame, taken: DataFrame | None) -> DataFrame:
    """The report of planned variants by the counts of their tiles; of the tiles only these are read."""
    stats = out.groupBy(F.col("image_id").alias("id")).agg(F.sum("ink_pixels").alias("ink_pixels"), F.sum("removed_pixels").alias("removed_pixels"), F.sum("solid_pixels").alias("solid_pixels"))
    r = v.join(stats, "id", "left")
    coverage = F.coalesce("ink_pixels", F.lit(0)) / (F.col("plan.width") * F.col("plan.height")) * 100.0
    e = sizing.ink_estimate(coverage, F.coalesce("solid_pixels", F.lit(0)), F.col("plan.width"), F.col("plan.height"), F.col("plan.width_cm"), F.col("plan.height_cm"), {k: F.col(k) for k in sizing.DEFAULT_PRICES})
    r = r.withColumn("e", e).withColumn("problem", F.coalesce("problem", F.when(F.coalesce("ink_pixels", F.lit(0)) == 0, "empty")))
    taken = r.select("output").limit(0) if taken is None else taken
    done = r.where("problem is null").select("id", "output", "batch_white")
    names_ = free_names(done.where("batch_white"), taken, True).unionByName(free_names(done.where("not batch_white"), taken))
    r = r.join(names_.select("id", "free").hint("merge"), "id", "left").withColumn("output", F.coalesce("free", "output"))
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    priced = (F.col("color_price_l") > 0) | (F.col("white_price_l") > 0) | (F.col("film_price_m2") > 0)
    return r.select(
        "id", "image", "size", "placement", F.when(F.col("problem").isNull(), "done").otherwise("error").alias("status"), "output", F.col("plan.width_cm").alias("widthCM"), F.col("plan.height_cm").alias("heightCM"),
        F.col("plan.width").alias("widthPX"), F.col("plan.height").alias("heightPX"), "dpi", ok(F.round(coverage, 2)).alias("coveragePercent"), ok(F.round("e.color_ml", 3)).alias("colorML"),
        ok(F.round("e.white_ml", 3)).alias("whiteML"), ok(F.when(priced, F.round("e.total_cost", 3))).alias("cost"), ok(F.when(F.col("batch_white"), names.white_name(F.col("output")))).alias("whiteOutput"), F.col("problem").alias("error"),
    )
