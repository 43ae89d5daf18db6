import datetime
import hashlib
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgrid import schema
from inkgrid.functions import gain, names, sizing
from inkgrid.operators import sheets
from inkgrid.plans import batch, journal
from inkgrid.sources import tables
from inkgrid.streaming import progress


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_gain_texts(spark):
    bad = ["30", "30:41:2", "30:41 30:50", "0:5", "100:99", "30:41 40:41", "50:100", " ".join(f"{i + 1}:{i + 1}" for i in range(11))]
    rows = spark.createDataFrame([(t,) for t in ["90:94,10:14;30:41 50:63 70:80", "", None, *bad]], "t string").select(gain.parse_gain(F.col("t")).alias("g")).collect()
    assert [p["nominal"] for p in rows[0]["g"]["points"]] == [10, 30, 50, 70, 90] and rows[0]["g"]["error"] is None
    assert rows[1]["g"]["points"] is None and rows[2]["g"]["error"] is None and all(r["g"]["error"] for r in rows[3:])
    points = gain.parse_gain(F.lit("90:94,10:14,30:41,50:63,70:80"))["points"]
    r = one(spark, a=gain.compensate_gain(F.lit(0.41), points), b=gain.gain_summary(points))
    assert r["a"] == pytest.approx(0.3) and r["b"] == [7, 22, 38, 58, 84]


def test_sizes(spark):
    plan = lambda w, h, dpi, axis, cm: sizing.print_plan(F.lit(w), F.lit(h), F.lit(float(dpi)), axis, F.lit(cm))
    r = one(spark, a=plan(1181, 1181, 300, "width", 20.0), b=plan(100, 150, 72, "width", 20.0), c=plan(100, 150, 72, "height", 30.0), d=plan(10, 10, 300, "width", 101.0), e=plan(1, 400, 300, "width", 90.0))
    assert [(r[k]["width"], r[k]["height"]) for k in "abc"] == [(2362, 2362), (2362, 3543), (2362, 3543)]
    assert r["d"]["error"] == "size out of range" and r["e"]["error"]
    tones = one(spark, t=F.array(*(sizing.tones_per_cell(F.lit(float(x))) for x in (20, 30, 40, 50, 60))))["t"]
    assert tones == [225, 100, 56, 36, 25]
    assert one(spark, r=sizing.resources(F.lit(10_000), F.lit(10_000), F.lit(True), F.lit(False)))["r"]["cache_bytes"] == 800_000_000


def test_ink(spark):
    prices = {k: F.lit(v) for k, v in {"color_ml_m2": 8.0, "white_ml_m2": 12.0, "color_price_l": 1000.0, "white_price_l": 0.0, "film_price_m2": 0.0}.items()}
    e = one(spark, e=sizing.ink_estimate(F.lit(50.0), F.lit(800_000), F.lit(1000), F.lit(1000), F.lit(25.4), F.lit(25.4), prices))["e"]
    assert e["savings_percent"] == pytest.approx(37.5) and e["ink_cost"] == pytest.approx(25.4**2 / 1e4 * 4)
    assert one(spark, a=sizing.normalize_price(F.lit("x"), "color_ml_m2"), b=sizing.normalize_price(F.lit("3"), "color_ml_m2"))[:] == (8.0, 3.0)


def test_names(spark):
    r = one(spark, a=names.safe_name(F.lit('a<b>:"c/d.x. .png')), b=names.safe_name(F.lit("..png")), c=names.output_name(F.lit(0), F.lit("x.png"), F.lit("M"), F.lit("front")), d=names.csv_line([(F.lit(41.5), False), (F.lit("=1"), True), (F.lit('a"b'), True), (F.lit(None), True)]))
    assert r["a"] == "a_b___c_d.x" and r["c"] == "001_x_M_front_300ppp.png" and r["d"] == '"41.5","\'=1","a""b",""' and r["b"] in ("imagen", ".")


def test_assignments_and_dense_ids(spark):
    files = spark.createDataFrame([(0, "a.png", 1), (1, "b.png", 1), (2, "c.png", 1)], "image_idx int, name string, recipe_id long")
    a = spark.createDataFrame([(0, ["M", "L"], ["front", "back"], None, None), (1, ["S", "S"], None, None, 7), (2, [], None, None, None)], "image_idx int, sizes array<string>, placements array<string>, garment string, recipe_id long")
    got = batch.make_variants(files, ["XL"], ["neck"], assignments=a).orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4] and {r["image_idx"] for r in got} == {0, 1} and got[4]["recipe_id"] == 7 and got[4]["output"] == "S/002_b_S_neck_300ppp.png"
    fifty = spark.range(50).selectExpr("cast(id AS int) AS image_idx", "concat('i', id, '.png') AS name", "0L AS recipe_id")
    v = batch.make_variants(fifty, ["M", "L"], ["front"])
    assert v.count() == 100
    art = spark.range(50).selectExpr("cast(id AS int) AS image_idx", "1000 AS width", "1500 AS height", "cast(null AS string) AS error")
    from inkgrid.functions import options

    p = {r["size"]: r for r in batch.preflight(v, art, options.recipes(spark, [{"recipe_id": 0}])).where("image = 'i7.png'").collect()}
    assert (p["M"]["width_px"], p["M"]["height_px"], p["L"]["height_px"]) == (2598, 3897, 4134)


def test_free_names(spark):
    s = "output string"
    taken = spark.createDataFrame([("M/a.png",), ("M/a_r2.png",), ("M/b_blanco.png",), ("M/c_r2.png",)], s)
    want = spark.createDataFrame([("M/a.png",), ("M/b.png",), ("M/c.png",), ("M/d.png",)], s)
    assert {r["output"]: r["free"] for r in batch.free_names(want, taken).collect()} == {"M/a.png": "M/a_r3.png", "M/b.png": "M/b.png", "M/c.png": "M/c.png", "M/d.png": "M/d.png"}
    assert {r["output"]: r["free"] for r in batch.free_names(want, taken, white=True).collect()}["M/b.png"] == "M/b_r2.png"


def test_journal(spark):
    v = spark.createDataFrame([(0, "M/001_a_M_front_300ppp.png"), (1, "M/002_b_M_front_300ppp.png")], "id long, output string")
    rows = [
        (1, 0, "pending", None, None, None, 100, None, None, "bad"), (2, 0, "done", "M/001_a_M_front_300ppp_r2.png", None, None, None, 7, None, None), (3, 9, "done", None, None, None, None, None, None, None),
        (4, 1, "odd", None, None, None, None, None, None, None), (5, 1, "done", "L/x.png", None, None, None, None, None, None), (6, 1, "done", None, None, None, 0, None, None, None), (7, 1, "error", None, None, None, 200_000, 200_000, None, None),
    ]
    log = spark.createDataFrame(rows, schema.PROGRESS)
    assert [r["seq"] for r in journal.checked(log, v).where("valid").orderBy("seq").collect()] == [1, 2]
    s = journal.latest_state(log.where("seq < 3")).first()
    assert (s["status"], s["widthPX"], s["heightPX"], s["error"]) == ("done", 100, 7, "bad")


def overlaps(p):
    rects = [(r.x, r.y, r.x + r.width, r.y + r.height) for r in p]
    return any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for i, a in enumerate(rects) for b in rects[i + 1 :])


def test_packing(spark):
    rng = random.Random(4)
    items = [(j, i, f"n{i}", rng.randrange(300, 3500), rng.randrange(300, 3500), rng.randrange(0, 4)) for j in range(5) for i in range(9)]
    items += [(9, 0, "wide", 9000, 9000, 2), (9, 1, "ok", 500, 700, 3), (8, 0, "x", 500, 500, 1)]
    jobs = [(j, 58.0, 0.0) for j in range(5)] + [(9, 58.0, 0.0), (8, 5.0, 0.0)]
    placed = sheets.pack_sheets(spark.createDataFrame(items, "job_id long, id long, name string, width int, height int, copies int"), spark.createDataFrame(jobs, "job_id long, width_cm double, max_length_cm double"))
    got = placed.collect()
    assert len(got) == sum(i[5] for i in items)
    by = {}
    for r in got:
        if r["sheet"] is not None:
            by.setdefault((r["job_id"], r["sheet"]), []).append(r)
    gap = 59
    for rs in by.values():
        grown = [pd.Series({"x": r["x"], "y": r["y"], "width": r["width"] + gap, "height": r["height"] + gap}) for r in rs]
        assert not overlaps(grown) and all(r["x"] >= 59 and r["y"] >= 59 and r["x"] + r["width"] <= r["sheet_width"] - 59 and r["y"] + r["height"] == min(r["y"] + r["height"], r["sheet_height"] - 59) for r in rs)
    assert {r["problem"] for r in got if r["name"] == "wide"} == {"too wide"} and {r["problem"] for r in got if r["job_id"] == 8} == {"width"}
    _, jobs_ = sheets.sheet_summary(placed)
    assert all(r["used_percent"] > 40 for r in jobs_.collect() if r["job_id"] < 5)
    four = spark.createDataFrame([(1, 0, "a", 5906, 3543, 4)], "job_id long, id long, name string, width int, height int, copies int")
    assert sheets.sheet_summary(sheets.pack_sheets(four, spark.createDataFrame([(1, 70.0)], "job_id long, max_length_cm double")))[1].first()["sheets"] == 2
    m = sheets.cut_marks(placed.where("job_id = 1"))
    assert m.count() == 8 * placed.where("job_id = 1 and sheet is not null").count()


def test_composed_sheets_have_turned_designs(spark):
    from inkgrid.operators import tiles

    d = spark.createDataFrame([(1, x, y, x * 9, y * 9, 5, 255) for x in range(20) for y in range(7)], schema.PIXELS)
    art = spark.createDataFrame([(1, 20, 7)], "image_id long, width int, height int")
    t = tiles.pixels_to_tiles(d, art, 8)
    placed = spark.createDataFrame([(1, 0, 1, "a", 1, 30, 12, 20, 7, False, 100, 60, None), (1, 0, 1, "a", 2, 3, 5, 7, 20, True, 100, 60, None)], sheets.PLACED)
    out = {(r["x"], r["y"]): (r["r"], r["g"]) for r in tiles.tiles_to_pixels(sheets.compose_sheets(placed, t, core=16)).collect()}
    want = {(30 + x, 12 + y): (x * 9, y * 9) for x in range(20) for y in range(7)} | {(3 + 6 - y, 5 + x): (x * 9, y * 9) for x in range(20) for y in range(7)}
    assert out == want


def test_files(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"RGBA 2 3 300\n" + bytes(24))
    (tmp_path / "b.raw").write_bytes(b"nothing")
    (tmp_path / "c.raw").write_bytes(b"RGBA 2 3 72.5\n" + bytes(23))
    c = tables.read_catalogue(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {r["name"]: (r["width"], r["dpi"], r["error"]) for r in c.collect()}
    assert got == {"a.raw": (2, 300.0, None), "b.raw": (None, None, "unreadable"), "c.raw": (2, 72.5, "truncated")}
    ready, rejected = tables.filter_print_ready(c)
    assert ready.count() == 1 and {r["reason"] for r in rejected.collect()} == {"unreadable", "truncated"}


def test_report_and_recipes(spark, tmp_path):
    rows = spark.createDataFrame([(0, "=a.png", "M", "done", 41.5), (1, None, "M", "error", None)], "id long, image string, size string, status string, widthCM double")
    tables.write_report_csv(rows, f"{tmp_path}/csv")
    text = b"".join(f.read_bytes() for f in sorted((tmp_path / "csv").glob("part-*"))).decode()
    assert text.startswith("﻿image,size") and '"\'=a.png","M","","done","","41.5"' in text and "\r\n" in text
    tables.write_report_json(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json/summary").first()["done"] == 1
    tables.write_outputs(spark.createDataFrame([(0, 1), (1, 2)], "image_id long, v int"), rows, f"{tmp_path}/out")
    assert (tmp_path / "out" / "size=M").exists()
    good = json.dumps({"schema": "halftone-recipes", "version": 1, "recipes": [{"id": "1", "name": "x", "options": {"lpi": 30, "odd": 1, "knockout": True}}, {"id": "2", "name": " "}]})
    got = tables.read_recipes(spark.createDataFrame([(good,), ("{}",)], "value string"))
    assert sorted(str(r["error"]) for r in got.collect()) == ["None", "format", "no name"]
    again = tables.read_recipes(tables.write_recipes(got.where("error is null")))
    assert again.first()["options"]["lpi"] == 30 and again.first()["error"] is None


def test_stream_state_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"seq": i, "id": rng.randrange(5), "status": rng.choice(journal.STATES), "widthPX": rng.choice([None, i])} for i in range(60)]
    batch_ = {r["id"]: r for r in journal.latest_state(spark.createDataFrame([(r["seq"], r["id"], r["status"], None, None, None, r["widthPX"], None, None, None) for r in rows], schema.PROGRESS)).collect()}
    rng.shuffle(rows)
    for i in range(12):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i:08d}.json").write_text("\n".join(json.dumps(x) for x in rows[i * 5 : i * 5 + 5]))
        os.utime(tmp_path / "in" / f"{i:08d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    log = spark.readStream.schema(schema.PROGRESS).option("maxFilesPerTrigger", 2).json(f"{tmp_path}/in")
    out = f"{tmp_path}/state"
    progress.write_upserts(progress.stream_batch_state(log), out, f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    state = progress.read_upserts(spark, out)
    assert {r["id"]: r.asDict() for r in state.collect()} == {k: r.asDict() for k, r in batch_.items()}
    written = [{r["id"] for r in spark.read.parquet(f"{out}/batch={i}").collect()} for i in range(6)]
    told = [{r["id"] for r in rows[i * 10 : i * 10 + 10]} for i in range(6)]
    assert written == told  # a batch writes what it changed and nothing else
    progress.fold_upserts(spark, out, f"{tmp_path}/folded")
    assert {r["id"]: r.asDict() for r in progress.read_upserts(spark, f"{tmp_path}/folded").collect()} == {k: r.asDict() for k, r in batch_.items()}
    # a batch that is repeated after a stop writes its folder anew
    (tmp_path / "in" / "late.json").write_text(json.dumps({"seq": -1, "id": 0, "status": "error", "widthPX": -5}))
    progress.write_upserts(progress.stream_batch_state(log), out, f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: r.asDict() for r in progress.read_upserts(spark, out).collect()} == {k: r.asDict() for k, r in batch_.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_debounce_in_a_stream(spark, tmp_path, seed):
    """Requests in disorder, of several delays, over many batches and two runs; repeated ones and ones of no key. The last ones fire when the input ends."""
    rng = random.Random(seed)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=s)
    rows = [("a", at(0), 1, 0.4), ("a", at(100), 2, 0.005), ("b", at(0), 3, 5.0), ("b", at(4000), 4, 5.0), ("b", at(20_000), 5, 5.0), ("z", at(90_000), 6, 1.0)]
    rows += [(rng.choice(["a", "b", "c", None]), at(rng.randrange(100_000) * 7 // 3), i, rng.choice([0.001, 0.25, 3.0, 10.0])) for i in range(100, 220)]
    r = spark.createDataFrame(rows, progress.REQUESTS)
    want = {tuple(x) for x in progress.debounce(r).collect()}
    late = sorted(rows, key=lambda x: x[1] + datetime.timedelta(seconds=rng.randrange(30)))  # out of order by less than the watermark
    late.insert(40, late[39])
    own, mark = progress.stateful(spark), f"{tmp_path}/end"
    progress.begin(spark, mark)
    (tmp_path / "in").mkdir()
    s = own.readStream.schema(r.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    for run in range(3):
        if run < 2:
            for i in range(2):
                spark.createDataFrame(late[(run * 2 + i) * 32 : (run * 2 + i + 1) * 32], r.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{run}{i}")
        else:
            progress.end(spark, mark)
        fired = progress.stream_debounce(progress.with_end(s, mark), "1 minute")
        fired.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        got = [tuple(x) for x in spark.read.schema(fired.schema).parquet(f"{tmp_path}/out").collect()]
        if run == 1:
            assert 0 < len(got) < len(want)  # the last ones wait
    assert sorted(got, key=str) == sorted(want, key=str)


def test_what_a_recipe_may_hold(spark):
    """each key's type and range, in the order in which they are looked at; what is rejected has no options."""
    def collection(*entries, **head):
        return json.dumps({"schema": "halftone-recipes", "version": 1, "recipes": list(entries), **head})

    of = lambda **o: {"id": "i", "name": " n ", "options": o}
    cases = [
        (of(lpi=30, knockout=True, key="#102030", odd=[1]), None), (of(lpi="30"), "number: lpi"), (of(knockout=0), "boolean: knockout"), (of(key=["#102030"]), "text: key"), (of(key="#" * 81), "text: key"), (of(knockout="x", angle="y"), "number: angle"),
        (of(lpi=None, key=None), None), (of(lpi=151), "range: lpi"), (of(edgeRadius=1.5), "range: edge_radius"), (of(presmooth=3), "range: presmooth"), (of(viewMode="side"), "range: viewMode"), (of(previewColor="red"), "range: previewColor"),
        (of(widthCM=1001), "range: widthCM"), (of(focusX=-1), "range: focusX"), (of(gainPoints="30"), "range: gain_points"), (of(lpi=100), "range: resolution"), (of(lpi=100, halftone=False), None), ({"id": "i", "name": "n"}, None),
        ({"id": "i", "name": "n", "options": None}, "options"), ({"id": "i", "name": "n", "options": [1]}, "options"), ({"id": "i", "name": "", "options": {}}, "no name"), ({"name": 7, "areas": {"front": {"M": [1, 2.5]}}}, None), ("text", "recipe"),
        ({"name": "n", "areas": {"front": {"M": [1]}}}, "areas"), ({"name": "n", "areas": {"front": {"M": [1, "2"]}}}, "areas"), ({"name": "n", "areas": {"front": {"4XL": [1, 2]}}}, "areas"), ({"name": "n", "areas": {"hat": {}}}, "areas"), ({"name": "n", "areas": [1]}, "areas"),
        ({"name": "n", "areas": {"front": {"M": [0, 5]}}}, "areas"), ({"name": "n", "areas": {"front": 3}}, "areas"), ({"name": "n", "profile": {"brand": "b", "calibrated": 1}}, None),
    ]
    got = tables.read_recipes(spark.createDataFrame([(collection(c[0]),) for c in cases], "value string").coalesce(1)).collect()
    assert [r["error"] for r in got] == [e for _, e in cases]
    assert all((r["options"] is None) == (e not in (None, "no name", "recipe")) for r, (_, e) in zip(got, cases, strict=True))
    assert got[0]["options"]["lpi"] == 30 and got[0]["name"] == "n" and got[21]["areas"] == {"front": {"M": [1.0, 2.5]}} and got[21]["name"] == "7" and got[21]["id"].startswith("recipe-")
    assert got[-1]["profile"]["brand"] == "b" and got[-1]["profile"]["calibrated"] is False
    bad = [collection(version="1"), collection(version=2), collection(schema="x"), collection(*[of()] * 101), "{", "[]", collection(of()) + " " * 2_000_000, None]
    assert [r["error"] for r in tables.read_recipes(spark.createDataFrame([(b,) for b in bad], "value string")).collect()] == ["format"] * len(bad)
    many = tables.read_recipes(tables.write_recipes(spark.range(250).selectExpr("lpad(id, 4, '0') AS id", "'n' AS name", f"cast(null AS {schema.OPTIONS}) AS options", f"cast(null AS {schema.AREAS}) AS areas", f"cast(null AS {schema.PROFILE}) AS profile").repartition(7)))
    assert sorted(r["id"] for r in many.collect()) == [f"{i:04d}" for i in range(250)]


def test_report_in_parts(spark, tmp_path):
    """The parts, one after the other, are the report, byte for byte, in the order of the ids."""
    rows = [(i, f'a "{i}"' if i % 3 else "=1+1", "M", 12.0 if i % 2 else 2.5, None if i % 5 else "é;\n") for i in range(500)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, image string, size string, widthCM double, error string").repartition(9)
    parts = tables.write_report_csv(df, f"{tmp_path}/r", 100).orderBy("part").collect()
    cell = lambda x: '"' + x.replace('"', '""') + '"'
    lines = ["﻿" + ",".join(names.REPORT_FIELDS)]
    for i, image, size, width, error in sorted(rows):
        cells = ["'" + image if image.startswith("=") else image, size, "", "", "", "12" if width == 12.0 else "2.5", *[""] * 9, error or ""]
        lines.append(",".join(map(cell, cells)))
    want = "".join(x + "\r\n" for x in lines).encode()
    assert len(parts) > 1
    got = b""
    for p in parts:
        data = (tmp_path / "r" / p["name"]).read_bytes()
        assert (p["offset"], p["bytes"], p["hash"], p["lines"]) == (len(got), len(data), hashlib.sha256(data).hexdigest(), data.count(b"\r\n"))
        got += data
    assert got == want
    assert [tuple(r) for r in tables.read_report(spark, f"{tmp_path}/r").orderBy("line").collect()] == list(enumerate(lines))
    assert tables.write_report_csv(df.limit(0), f"{tmp_path}/none").select("lines").first()[0] == 1
