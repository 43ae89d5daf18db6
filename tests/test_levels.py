"""Sheets without a row for each copy: what is said of them is what their copies say."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkgrid import queries
from inkgrid.operators import sheets

DATA = "/root/testdata/sf0.001"


def test_marks_of_levels_are_those_of_copies(spark):
    items, jobs = queries._items(spark, DATA), queries._jobs(spark, DATA)
    marks = sheets.cut_marks(sheets.pack_sheets(items, jobs)).groupBy("job_id").agg(F.count("*").alias("marks"), F.min("left").alias("left"), F.max("top").alias("top"))
    got = queries.sheet_marks(spark, DATA)
    assert sorted(map(tuple, got.select(*marks.columns).collect())) == sorted(map(tuple, marks.collect()))
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_checks_count_every_copy_and_write_nothing(spark):
    found = queries.sheet_checks(spark, DATA)
    placed = sheets.pack_sheets(queries._items(spark, DATA), queries._jobs(spark, DATA))
    want = placed.groupBy("job_id").agg(F.count("*").alias("pieces"), F.count("sheet").alias("placed"), F.sum(F.when(F.col("sheet").isNotNull(), F.col("width").cast("long") * F.col("height")).otherwise(0)).alias("area"))
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert found.where("overlaps > 0 or outside > 0 or marks <> 8 * placed").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" in plan and "placed-" not in plan  # made of the tables, and of nothing written in between


def test_overlaps_are_all_that_a_look_at_every_pair_finds():
    rng = np.random.default_rng(5)
    sheet, x, y, w, h = (rng.integers(a, b, 400) for a, b in ((0, 9), (0, 300), (0, 300), (1, 40), (1, 200)))
    x[:9], y[:9], sheet[:9] = 50, 60, 3  # at one place
    order = sorted(range(400), key=lambda i: (sheet[i], y[i], x[i]))
    pairs = [(i, j) for n, i in enumerate(order) for j in order[n + 1 :] if sheet[i] == sheet[j] and x[j] < x[i] + w[i] + 7 and x[i] < x[j] + w[j] + 7 and y[j] < y[i] + h[i] + 7]
    for most in (1, 50, 1 << 22):
        assert sheets.overlaps(sheet, x, y, w, h, 7, most).sum() == len(pairs) > 36


def test_a_bad_level_is_found():
    names = [c.split()[0] for c in sheets.LEVELS.split(", ")]
    rows = [(1, 0, 3, 59, 59, 80, 10, 10, 1000, 1000, None), (1, 0, 1, 150, 59, 80, 10, 10, 1000, 1000, None), (2, 0, 2, 930, 59, 81, 10, 10, 1000, 1000, None), (3, None, 5, 0, 0, 0, 9, 9, 1000, None, "too wide")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 7, pa.string()]
    b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    got = {r["job_id"]: tuple(r.values())[1:] for r in sheets.check_levels(b, 71, 59).to_pylist()}
    assert got == {1: (4, 4, 400, 4, 0), 2: (2, 2, 200, 0, 1), 3: (5, 0, 0, 0, 0)}
