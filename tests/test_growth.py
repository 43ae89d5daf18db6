"""What must not grow with the input: tables that go through the driver, tasks, searches and calls of the state store."""

import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgrid import queries, views
from inkgrid.operators import kernels, pixels as px, process, sheets, tiles
from inkgrid.schema import TILES
from inkgrid.sources import tables
from inkgrid.streaming.progress import _Waiting

DATA = "/root/testdata/sf0.001"


def _broadcast(plan: str) -> list[str]:
    """The parts of a plan that are broadcast, are made of the input, larger than it, and are of no size that was measured after a shuffle."""
    lines, found = plan.split("\n"), []
    deep = lambda line: re.match(r"[\s:+\-*|]*", line).end()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line and "+-" in line:
            below = [line]
            for x in lines[i + 1 :]:
                if not x.strip() or deep(x) <= deep(line):
                    break
                below.append(x)
            text = "\n".join(below)
            if "Scan parquet" in text and re.search("Generate|MapInArrow", text) and not re.search(r"ShuffleQueryStage|[+-] Exchange", text):
                found.append(text)
    return found


def _plans(spark, run) -> list[str]:
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = store.executionsList()
    return [every.apply(i).physicalPlanDescription() for i in range(before, every.size())]


@pytest.mark.parametrize(
    "name",
    ["ink_by_recipe", "ink_cost_pixels", "masks", "previews", "shapes_by_image", "tile_roundtrip", "boosted_colors", "batch_run", "brand_mockups", "brand_sheets", "crops", "edge_protection", "ink_cost", "openings", "pores", "resampled", "smoothed", "thumbnail_sums", "tile_cleanup", "sheet_copies"],
)
def test_pixels_and_tiles_are_never_broadcast(spark, name):
    plans = _plans(spark, lambda: queries.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save())
    assert plans
    assert [b for p in plans for b in _broadcast(p)] == []


@pytest.mark.parametrize("name", ["previews", "ink_cost_pixels", "ink_by_recipe", "boosted_colors"])
def test_the_code_of_pixel_queries_is_small_enough_to_compile(spark, name):
    one = spark.newSession()
    one.conf.set("spark.sql.adaptive.enabled", "false")
    text = spark._jvm.PythonSQLUtils.explainString(queries.QUERIES[name](one, DATA)._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?[0-9]+)", text)]
    assert sizes and all(0 < n < 9000 for n in sizes)  # -1: over the JVM's 64 KB, so the driver logs all of it and tasks interpret it


def test_order_lines_are_not_sorted_to_find_their_art(spark):
    plans = _plans(spark, lambda: queries.QUERIES["sheet_copies"](spark, DATA).write.format("noop").mode("overwrite").save())
    assert any("ShuffledHashJoin" in p for p in plans)
    assert not any(re.search(r"SortMergeJoin|[+-] Sort ", p) for p in plans)


@pytest.mark.parametrize("made", [views.tiles, views.pixels])
def test_art_is_made_in_many_tasks(spark, made):
    assert made(views.art(spark, DATA)).select(F.spark_partition_id().alias("p")).distinct().count() == 4  # the session's shuffle partitions; the file is one split


def test_a_report_is_cut_once_for_each_part(spark, tmp_path):
    rows = spark.range(300).select("id", F.concat(F.lit("a\nb"), F.col("id").cast("string")).alias("image"))
    tables.write_report_csv(rows, str(tmp_path / "r"), 100)
    got = tables.read_report(spark, str(tmp_path / "r"))
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]  # not once for each line
    assert [r.line for r in got.orderBy("line").collect()] == list(range(301))


def test_copies_are_placed_side_by_side_in_one_search(monkeypatch):
    searches, best = [], sheets.Skyline.best
    monkeypatch.setattr(sheets.Skyline, "best", lambda self, *a: searches.append(1) or best(self, *a))
    got = sheets.pack_job((1, 1000, 2, 5, 10**6, False), [(7, "a", c, 31, 20) for c in range(1, 901)])
    assert [(r[5], r[6]) for r in got] == [(5 + i % 30 * 33, 5 + i // 30 * 22) for i in range(900)]
    assert len(searches) <= 31


def test_a_batch_asks_the_state_store_few_times(monkeypatch):
    calls, held = [], []
    value = SimpleNamespace(get=lambda: calls.append(1) or (held[-1] if held else None), update=lambda v: calls.append(1) or held.append(v), clear=lambda: calls.append(1) or held.clear())
    timers = []
    w = _Waiting()
    w.init(SimpleNamespace(getValueState=lambda *a: value, registerTimer=lambda t: calls.append(1) or timers.append(t)))
    at = np.arange(500) * 2_000_000
    rows = pd.DataFrame({"at": at, "id": np.arange(500), "fires": at + 1_000_000, "real": True})
    list(w.handleInputRows(("k",), iter([rows[:200], rows[100:]]), None))
    out = list(w.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])))
    assert list(out[0]["id"]) == list(range(500)) and timers == [1000] and not held
    assert len(calls) < 10


def test_tiles_of_one_shape_are_worked_on_together(monkeypatch):
    calls, composite = [], kernels.composite
    monkeypatch.setattr(kernels, "composite", lambda *a: calls.append(1) or composite(*a))
    shapes, rng = [(16, 16), (16, 5), (1, 1)], np.random.default_rng(1)
    rows = [(i, i % 3, i % 2, i % 3 * 16, i % 2 * 16, w, h, 4, rng.integers(0, 256, w * h * 4, np.uint8).tobytes()) for i in range(300) for h, w in (shapes[i % 3],)]
    source = SimpleNamespace(select=lambda *a: SimpleNamespace(mapInArrow=lambda f, _: list(f(iter([tiles.batch_of(rows, TILES)])))))
    for background in (None, (18, 52, 86)):
        calls.clear()
        got = [r for b in process.composite_tiles(source, background) for r in b.to_pylist()]
        assert len(calls) == 3
        for r in got:
            d = np.frombuffer(rows[r["image_id"]][-1], np.uint8).reshape(r["height"], r["width"], 4)
            back = background or kernels.checker(r["height"], r["width"], r["left"], r["top"])
            assert r["data"] == composite(d, back).tobytes()
        assert sorted(r["image_id"] for r in got) == list(range(300))


def test_a_damaged_tile_is_an_error():
    rows = [(1, 0, 0, 0, 0, 2, 2, 4, bytes(15)), (2, 0, 0, 0, 0, 2, 2, 4, bytes(17))]
    with pytest.raises(ValueError, match="other than 16 bytes"):
        list(tiles.stacks([tiles.batch_of(rows, TILES)]))


def test_values_of_one_length_are_hashed_together(monkeypatch):
    one, calls, rng = tiles._fnv1a_one, [], np.random.default_rng(2)
    monkeypatch.setattr(tiles, "_fnv1a_one", lambda b: calls.append(1) or one(b))
    for n, length in ((500, 37), (64, 1), (3, 200), (70, 0)):
        calls.clear()
        d = rng.integers(0, 256, (n, length), np.uint8)
        got = tiles.fnv1a_rows(d).tolist()
        assert len(calls) == (n if n < tiles.SIDE_BY_SIDE else 0)
        for row, h in zip(d.tolist(), got, strict=True):
            want = 0x811C9DC5
            for x in row:
                want = (want ^ x) * 0x01000193 % 2**32
            assert h == want


def test_images_of_one_size_are_made_together(monkeypatch):
    made, binary = [], tiles.binary_rows
    monkeypatch.setattr(tiles, "binary_rows", lambda d: made.append(len(d)) or binary(d))
    art = pa.RecordBatch.from_pydict({"image_id": pa.array(range(1, 301)), "width": pa.array([20, 5] * 150, pa.int32()), "height": pa.array([18, 3] * 150, pa.int32()), "p_size": pa.array([i % 50 for i in range(300)], pa.int32())})
    monkeypatch.setattr(views, "_spread", lambda a: SimpleNamespace(mapInArrow=lambda f, _: list(f(iter([art])))))
    got = [r for b in views.tiles(SimpleNamespace(select=lambda *a: None), 16) for r in b.to_pylist()]
    assert made == [150] * 5  # one tile of the small images, four of the others
    for r in got:
        y, x = np.mgrid[r["top"] : r["top"] + r["height"], r["left"] : r["left"] + r["width"]]
        w, size = (20, 5)[(r["image_id"] - 1) % 2], (r["image_id"] - 1) % 50
        p = y * w + x
        alpha = np.where(p % 7 == 0, 0, np.where(p % 5 == 0, 255, 13 * x + 23 * y))
        want = np.stack([17 * x + 3 * y + 7 * size, 5 * x + 11 * y + 13 * r["image_id"], 7 * x + 19 * y, alpha], axis=-1) % 256
        assert r["data"] == want.astype(np.uint8).tobytes()


def test_isolated_pixels_are_found_by_words(spark):
    rng = np.random.default_rng(3)
    at = {(int(i), int(x), int(y)) for i, x, y in rng.integers((0, -40, -3), (3, 110, 40), (1500, 3))}
    mask = spark.createDataFrame(sorted(at), "image_id long, x int, y int")
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    want = {(i, x, y) for i, x, y in at if not any((i, x + dx, y + dy) in at for dx, dy in around)}
    got = px.isolated_mask(mask)
    assert len(want) > 50
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_final_mask_takes_one_shuffle(spark):
    table = lambda rows: spark.createDataFrame(rows, "image_id long, x int, y int")
    screened, removed, filled = table([(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 0, 0)]), table([(1, 1, 0), (2, 0, 0), (3, 3, 3)]), table([(1, 5, 5), (1, 0, 0), (1, 5, 5)])
    got = px.final_mask(screened, removed, filled)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (1, 5, 5), (2, 0, 0)]
    assert len(re.findall(r"\bExchange\b", got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])) == 1


def test_groups_of_tiles_share_a_call(spark):
    rows = spark.range(0, 3000, 1, 3).select((F.col("id") % 700).alias("image_id"), F.lit(0).alias("tile_y"), (F.col("id") % 2).cast("int").alias("tile_x"), "id")
    step = lambda g: [(g[0].image_id, g[0].tile_y, g[0].tile_x, sum(r.id for r in g))]
    got = tiles.grouped(rows, tiles.KEY, step, "image_id long, tile_y int, tile_x int, total long")
    assert "MapInArrow" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan
    want = rows.groupBy(*tiles.KEY).agg(F.sum("id").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["masks", "edge_protection"])
def test_filters_are_not_pushed_down_with_all_that_ink_is_made_of(spark, name):
    plans = _plans(spark, lambda: queries.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save())
    assert max(len(x) for p in plans for x in p.split("\n") if x.startswith("Condition")) < 2000
