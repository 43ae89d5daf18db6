"""Islands and pores that reach over many tiles, against whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions import options
from inkgrid.operators import kernels as K
from inkgrid.operators import process
from rasters import filled
from test_tiles import as_tiles, raster, whole

LARGE = {"min_diameter_mm": 2.0, "fill_holes_mm": 1.0}


def inked(mask):
    """Opaque where the mask is, of a colour that is printed as it is."""
    rgba = np.zeros((*mask.shape, 4), np.uint8)
    rgba[mask] = (200, 40, 90, 255)
    return rgba


def spiral(n, gap=3):
    """One line, a pixel wide, from the edge to the centre: it crosses every seam again and again."""
    m, x, y, dx, dy, run = np.zeros((n, n), bool), 0, 0, 1, 0, n - 1
    m[0, 0] = True
    while run > 0:
        for _ in range(2):
            for _ in range(run):
                x, y = x + dx, y + dy
                m[y, x] = True
            dx, dy = -dy, dx
        run -= gap
    return m


def images():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:58, :75]
    return {
        0: raster(5), 1: inked(rng.random((58, 75)) < 0.41), 2: inked(rng.random((58, 75)) < 0.6), 3: inked(spiral(66)), 4: inked(~spiral(66, 4)), 5: inked((x + y) % 2 == 0), 6: inked((x % 16 < 15) & (y % 16 < 15)),
        7: inked(np.abs(x - y) % 37 == 0), 8: inked(np.zeros((40, 40), bool)), 9: inked(np.ones((40, 40), bool)),
    }


@pytest.mark.parametrize("core", [16, 7])
@pytest.mark.parametrize("own", [{}, {"protection": "edges", "edge_radius": 2}])
def test_large_areas(spark, core, own):
    some = images()
    o = {**LARGE, "halftone": False, "knockout": False, **own}
    art = spark.createDataFrame([(i, d.shape[1], d.shape[0], i % 2) for i, d in some.items()], "image_id long, width int, height int, recipe_id long")
    recipes = options.with_defaults(options.recipes(spark, [{"recipe_id": 0, **o}, {"recipe_id": 1, **o, "min_diameter_mm": 0.9, "fill_holes_mm": 0.3}]))
    out = process.process_tiles(as_tiles(spark, some, core), art, recipes, core).cache()  # by the seams, as the areas are large
    stats = {r["image_id"]: r for r in process.tile_stats(out).collect()}
    gone = pores = 0
    for i, d in some.items():
        r = K.process(d, filled(**{**o, **({"min_diameter_mm": 0.9, "fill_holes_mm": 0.3} if i % 2 else {})}))
        assert (whole(out, i, d.shape) == r.rgba).all(), i
        want = [(r.rgba[..., 3] > 0).sum(), r.screened.sum(), r.removed.sum(), r.protected.sum(), r.solid.sum(), r.filled.sum(), len(r.particles), len(r.pores)]
        assert [stats[i][c] for c in process._COUNTS] == [int(x) for x in want], i
        gone, pores = gone + len(r.particles), pores + len(r.pores)
    assert own or (gone > 20 and pores > 5)


def test_production_tiles(spark):
    """Tiles of 512 pixels, four and more an image, by both ways."""
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:1100, :1300]
    d = raster(2, 1300, 1100)
    d[..., 3] = np.where((np.sin(x / 31) * np.cos(y / 23) > 0.3) | (rng.random((1100, 1300)) < 0.02), 255, 0)
    art = spark.createDataFrame([(1, 1300, 1100, 0)], "image_id long, width int, height int, recipe_id long")
    tiles = as_tiles(spark, {1: d}, 512)
    for o in ({**LARGE, "knockout": False}, {"cleanup": "high", "fill_holes_mm": 0.3, "presmooth": 2}):
        r = K.process(d, filled(**o))
        for by_seams in (True, False):
            out = process.process_tiles(tiles, art, options.with_defaults(options.recipes(spark, [{"recipe_id": 0, **o}])), 512, by_seams=by_seams).cache()
            assert (whole(out, 1, d.shape) == r.rgba).all()
            s = process.tile_stats(out).first()
            assert (s["removed_components"], s["filled_components"]) == (len(r.particles), len(r.pores))
    white = process.white_tiles(tiles, art, 0.6, 512)
    assert ((whole(white, 1, (1100, 1300, 1))[..., 0] > 0) == K.white_mask(d[..., 3] > 0, 7)).all()


def test_what_is_sent_are_seams(spark):
    """A few bytes for each pixel along a seam, however large the tiles are."""
    from inkgrid.operators import seams

    d = inked(np.random.default_rng(1).random((512, 512)) < 0.41)
    p = K.prepare(d, filled(**LARGE, halftone=False, knockout=False))
    data = np.concatenate([p.source.astype(np.uint8), seams.flags(p)[..., None]], axis=-1)
    rows = [(1, i % 4, i // 4, i % 4 * 128, i // 4 * 128, 128, 128, 4, bytearray(np.ascontiguousarray(data[i // 4 * 128 :, i % 4 * 128 :][:128, :128]).tobytes()), 512, 512, 438, 1, 0) for i in range(16)]
    sent = seams.seams(spark.createDataFrame(rows, seams.PREPARED), False).select(F.sum(F.length("edges") + F.length("ids") + F.length("area") + F.length("held") + F.length("first"))).first()[0]
    assert sent < 16 * 4 * 128 * 30
    assert seams.seams(spark.createDataFrame(rows, seams.PREPARED), True).count() == 0  # no pores are asked for


def test_a_stopped_batch_goes_on(spark, tmp_path, monkeypatch):
    """Tiles that were written aren't made again; the rest is made of them."""
    from inkgrid.operators import resample
    from inkgrid.plans import batch

    some = {7: raster(1), 8: raster(2)}
    art = spark.createDataFrame([(i, i, 75, 58) for i in some], "image_idx int, image_id long, width int, height int")
    files = spark.createDataFrame([(i, f"{i}.png", i % 2) for i in (*some, 9)], "image_idx int, name string, recipe_id long")
    areas = spark.createDataFrame([("front", "S", 0.5, 0.4), ("front", "M", 0.8, 0.7)], "placement string, size string, width_cm double, height_cm double")
    v = batch.make_variants(files, ["S", "M"], ["front"], areas=areas)
    recipes = options.recipes(spark, [{"recipe_id": 0}, {"recipe_id": 1}])
    settings = spark.createDataFrame([(0, True, 0.2), (1, True, 0.4)], "recipe_id long, batch_white boolean, white_choke_mm double")
    run = lambda path: batch.run_batch(v, as_tiles(spark, some, 16), art, recipes, 16, settings, path=path)
    out, white, report = run(f"{tmp_path}/one")
    want = [sorted(map(str, t.collect())) for t in (out, white, report)]
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and report.where("status = 'done'").count() == 4 and white.select("image_id").distinct().count() == 4

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(process, "white_tiles", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            run(f"{tmp_path}/two")
    written = {f: f.stat().st_mtime_ns for f in (tmp_path / "two").rglob("*.parquet")}
    assert {f.parent.name for f in written} == {"plan", "tiles"}
    (tmp_path / "two" / "white").mkdir()
    (tmp_path / "two" / "white" / "part-of-a-stopped-task.parquet").write_bytes(b"odd")
    monkeypatch.setattr(resample, "resample_tiles", stop)
    got = run(f"{tmp_path}/two")
    assert [sorted(map(str, t.collect())) for t in got] == want
    assert all(f.stat().st_mtime_ns == at for f, at in written.items())
