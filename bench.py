"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds, and megapixels a second for raster work.

Raster work runs over art of 13 megapixels in production tiles of 512 pixels, long enough (some 200 megapixels for each kind) that starting costs matter little.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from inkgrid import queries, views
from inkgrid.functions import options
from inkgrid.operators import process

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
#: Side of the images of the tile benchmark, in pixels, and their number.
SIDE, IMAGES = 3584, int(os.environ.get("BENCH_IMAGES", "16"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", str(CPUS * 2)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def timed(f) -> float:
    start = time.time()
    f().write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 2)


def large_tiles(spark: SparkSession):
    """Opaque art by the formula of the published screen benchmark, in production tiles."""
    import numpy as np

    from inkgrid.operators.tiles import batches_of
    from inkgrid.schema import TILES

    def made(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                image, t = divmod(i, (SIDE // 512) ** 2)
                ty, tx = divmod(t, SIDE // 512)
                y, x = np.mgrid[ty * 512 : ty * 512 + 512, tx * 512 : tx * 512 + 512]
                d = np.stack([(17 * x + 3 * y) % 256, (5 * x + 11 * y) % 256, (7 * x + 19 * y) % 256, np.full_like(x, 255)], axis=-1).astype(np.uint8)
                yield image, tx, ty, tx * 512, ty * 512, 512, 512, 4, d.tobytes()

    return spark.range(IMAGES * (SIDE // 512) ** 2).repartition(CPUS * 4).mapInArrow(lambda batches: batches_of(made(batches), TILES), TILES)


def main() -> None:
    spark = session()
    found: dict[str, float] = {}
    rates: dict[str, float] = {}
    pixels = views.art(spark, SF).selectExpr("sum(width * height)").first()[0] / 1e6
    for name in ("ink_cost", "tile_composites", "composites", "variant_sizes", "job_preflight", "latest_state"):
        found[name] = timed(lambda f=queries.QUERIES[name]: f(spark, SF))
        if name in ("ink_cost", "tile_composites", "composites"):
            rates[name] = round(pixels * (1 if name == "ink_cost" else 2) / found[name], 2)
    placed = queries.sheets.pack_sheets(queries._items(spark, SF), queries._jobs(spark, SF))  # all orders
    start = time.time()
    n = placed.groupBy("job_id").count().selectExpr("count(*) AS jobs", "sum(count) AS pieces").first()
    found["packing"] = round(time.time() - start, 2)
    kept = large_tiles(spark).cache()
    kept.count()
    art = spark.range(IMAGES).selectExpr("id AS image_id", f"{SIDE} AS width", f"{SIDE} AS height", "0L AS recipe_id")
    warm = options.with_defaults(options.recipes(spark, [{"recipe_id": 0, "presmooth": 1}]))
    timed(lambda: process.process_tiles(kept.where("image_id < 2"), art, warm))  # Python workers and their imports
    found["tiles_composite"] = timed(lambda: process.composite_tiles(kept))
    rates["tiles_composite"] = round(IMAGES * SIDE * SIDE / 1e6 / found["tiles_composite"], 2)
    for name, o in {
        "tiles_screen": {"input_black": 7.0, "input_midtone": 2.0, "input_white": 100.0, "cleanup": "none"}, "tiles_area": {"input_black": 7.0, "input_midtone": 2.0, "input_white": 100.0},
        "tiles_opening": {"cleanup_mode": "opening"}, "tiles_presmooth": {"cleanup_mode": "opening", "presmooth": 2},
    }.items():
        r = options.with_defaults(options.recipes(spark, [{"recipe_id": 0, **o}]))
        found[name] = timed(lambda r=r: process.process_tiles(kept, art, r))
        rates[name] = round(IMAGES * SIDE * SIDE / 1e6 / found[name], 2)
    packing = {"jobs_per_sec": round(n["jobs"] / found["packing"]), "pieces_per_sec": round(n["pieces"] / found["packing"])}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 2), "unit": "sec", "queries": found, "megapixels_per_sec": rates, "packing": packing, "cpus": CPUS, "sf": SF.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
