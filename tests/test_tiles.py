import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions import options
from inkgrid.operators import kernels as K
from inkgrid.operators import process, resample, tiles
from inkgrid.operators import pixels as px
from inkgrid.schema import TILES
from rasters import filled

W, H = 75, 58


def raster(seed, w=W, h=H):
    """Soft blobs, noise and transparent parts."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    rgba = np.zeros((h, w, 4), np.uint8)
    for c in range(3):
        rgba[..., c] = (127 + 100 * np.sin(x / (5 + c) + seed) * np.cos(y / 7) + rng.integers(-20, 20, (h, w))).clip(0, 255)
    rgba[..., 3] = np.where(rng.random((h, w)) < 0.1, 0, np.where((x + y) % 11 < 7, 255, rng.integers(0, 256, (h, w))))
    return rgba


def as_tiles(spark, images, core):
    out = []
    for i, d in images.items():
        for ty in range(-(-d.shape[0] // core)):
            for tx in range(-(-d.shape[1] // core)):
                t = d[ty * core : (ty + 1) * core, tx * core : (tx + 1) * core]
                out.append((i, tx, ty, tx * core, ty * core, t.shape[1], t.shape[0], 4, bytearray(np.ascontiguousarray(t).tobytes())))
    return spark.createDataFrame(out, TILES)


def whole(df, i, shape):
    out = np.zeros(shape, np.uint8)
    for t in df.where(F.col("image_id") == i).collect():
        out[t["top"] : t["top"] + t["height"], t["left"] : t["left"] + t["width"]] = np.frombuffer(t["data"], np.uint8).reshape(t["height"], t["width"], -1)
    return out


CASES = {
    0: {}, 1: {"cleanup": "high", "fill_holes_mm": 0.3, "shape": "euclidean"}, 2: {"cleanup_mode": "opening", "defringe": True, "shape": "line", "line_trim": 3.0}, 3: {"presmooth": 1, "protection": "edges", "edge_radius": 2},
    4: {"presmooth": 2, "cleanup_mode": "opening", "cleanup": "high", "lpi": 25.0}, 5: {"recover": True, "shadow_boost": 30.0, "color_boost": 20.0, "gain_points": "30:41,70:80", "solid_above": 90.0}, 6: {"halftone": False, "defringe": True, "fill_holes_mm": 0.2},
}


@pytest.mark.parametrize(("core", "by_seams"), [(16, False), (33, False), (16, True), (33, True)])
def test_tiles_give_what_the_whole_image_gives(spark, core, by_seams):
    images = {i: raster(i) for i in CASES}
    art = spark.createDataFrame([(i, W, H, i) for i in CASES], "image_id long, width int, height int, recipe_id long")
    recipes = options.with_defaults(options.recipes(spark, [{"recipe_id": i, **o} for i, o in CASES.items()]))
    out = process.process_tiles(as_tiles(spark, images, core), art, recipes, core, by_seams=by_seams).cache()
    stats = {r["image_id"]: r for r in process.tile_stats(out).collect()}
    for i, o in CASES.items():
        opt = filled(**o)
        if o.get("gain_points"):
            opt["gain"] = [[30, 41], [70, 80]]
        r = K.process(images[i], opt)
        assert (whole(out, i, (H, W, 4)) == r.rgba).all(), o
        want = [(r.rgba[..., 3] > 0).sum(), r.screened.sum(), r.removed.sum(), r.protected.sum(), r.solid.sum(), r.filled.sum(), len(r.particles), len(r.pores)]
        assert [stats[i][c] for c in process._COUNTS] == [int(x) for x in want], o


def test_white_tiles_and_totals(spark):
    images = {1: raster(1), 2: np.full((H, W, 4), 255, np.uint8)}
    art = spark.createDataFrame([(i, W, H, 0) for i in images], "image_id long, width int, height int, recipe_id long")
    t = as_tiles(spark, images, 16)
    for mm in (0.0, 0.15, 0.4):
        white = process.white_tiles(t, art, mm, 16)
        choke = int(mm / 25.4 * 300 + 0.5)
        for i, d in images.items():
            assert (whole(white, i, (H, W, 1))[..., 0] > 0).tolist() == K.white_mask(d[..., 3] > 0, choke).tolist()
    color = t.withColumn("ink_pixels", F.lit(1))
    n = {r["image_id"]: r["white_pixels"] for r in process.white_totals(color, process.white_tiles(t, art, 0.15, 16)).collect()}
    assert n[1] == K.white_mask(images[1][..., 3] > 0, 2).sum()


def test_resampled_tiles_are_the_pixel_form(spark):
    images = {1: raster(1), 2: raster(2)}
    t = as_tiles(spark, images, 16)
    sizes = [(1, 30, 91), (2, 120, 20)]
    jobs = spark.createDataFrame([(i, i, W, H, w, h) for i, w, h in sizes], "variant_id long, image_id long, width int, height int, out_width int, out_height int")
    a = tiles.tiles_to_pixels(resample.resample_tiles(t, jobs, 16).withColumnRenamed("variant_id", "image_id"))
    b = px.resample(tiles.tiles_to_pixels(t), jobs.drop("variant_id")).where("a > 0")
    assert a.count() > 3000 and a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


def test_thumbnail_of_one_colour(spark):
    d = np.zeros((32, 64, 4), np.uint8)
    d[:] = (10, 20, 30, 255)
    art = spark.createDataFrame([(1, 64, 32)], "image_id long, width int, height int")
    out = tiles.tiles_to_pixels(resample.thumbnails(as_tiles(spark, {1: d}, 16), art, 16, 16)).collect()
    assert len(out) == 16 * 8 and {tuple(r)[3:] for r in out} == {(10, 20, 30, 255)}


def test_stripes_shrink_to_their_mean(spark):
    p = spark.range(256 * 4).selectExpr("1L AS image_id", "cast(id % 256 AS int) AS x", "cast(id div 256 AS int) AS y", "if(id % 4 = 0, 255, 0) AS r", "0 AS g", "0 AS b", "255 AS a")
    s = spark.createDataFrame([(1, 256, 4, 64, 1)], "image_id long, width int, height int, out_width int, out_height int")
    assert {r["r"] for r in px.resample(p, s).collect()} == {64}


def test_crops(spark):
    d = raster(3)
    t = as_tiles(spark, {1: d}, 16)
    crops = spark.createDataFrame([(1, 1, 10, 5, 40, 30), (2, 1, 0, 0, W, H), (3, 9, 0, 0, 4, 4)], "crop_id long, image_id long, left int, top int, width int, height int")
    got = tiles.read_crop(t, crops, 16).cache()
    assert (whole(got, 1, (30, 40, 4)) == d[5:35, 10:50]).all() and (whole(got, 2, d.shape) == d).all() and got.where("image_id = 3").first()["error"] == "missing tile"
    assert got.where("error is null").groupBy("image_id").count().orderBy("image_id").collect() == [(1, 6), (2, 20)] and got.selectExpr("max(length(data))").first()[0] == 16 * 16 * 4
    short = t.withColumn("data", F.when(F.col("tile_x") == 1, F.substring("data", 1, 9)).otherwise(F.col("data")))
    assert {r["image_id"]: r["error"] for r in tiles.read_crop(short, crops, 16).collect()} == {1: "short tile", 2: "short tile", 3: "missing tile"}


def test_checksums(spark):
    def fnv(data):
        h = 0x811C9DC5
        for b in data:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return f"{h:08x}"

    t = as_tiles(spark, {1: raster(1)}, 16)
    data = {(r["tile_y"], r["tile_x"]): bytes(r["data"]) for r in t.collect()}
    assert {(r["tile_y"], r["tile_x"]): r["fnv"] for r in tiles.tile_checksum(t).collect()} == {k: fnv(v) for k, v in data.items()}


def test_pixels_and_back(spark):
    t = as_tiles(spark, {1: raster(1)}, 16)
    art = spark.createDataFrame([(1, W, H)], "image_id long, width int, height int")
    p = tiles.tiles_to_pixels(t)
    again = tiles.tiles_to_pixels(tiles.pixels_to_tiles(p, art, 16))
    assert p.exceptAll(again).count() == 0 and p.count() == again.count()
