"""Gang sheets: designs packed on film rolls. Jobs are packed side by side, each in one task."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.sizing import MOST_PIXELS, cm_to_px, mm_to_px, px_to_cm
from inkgrid.operators.tiles import CORE, batch_of, rows_of
from inkgrid.schema import TILES
from inkgrid.sources.workspace import keep

PLACED = "job_id long, sheet int, id long, name string, copy int, x int, y int, width int, height int, rotated boolean, sheet_width int, sheet_height int, problem string"
#: Cut marks in mm (distance, length, thickness) and the spacing and margin they need.
MARK_OFFSET, MARK_LENGTH, MARK_WIDTH, MARK_SPACING, MARK_MARGIN = 1.0, 3.0, 0.3, 6.0, 5.0


def sheet_options(jobs: DataFrame) -> DataFrame:
    """jobs: (job_id, width_cm, max_length_cm, spacing_mm, margin_mm, rotate, marks), nulls are 58, 0 (no limit), 5, 5, true and false. Adds sheet_width, gap, margin and
    limit in pixels, and problem, the first rule that fails."""
    for c, d in {"width_cm": 58.0, "max_length_cm": 0.0, "spacing_mm": 5.0, "margin_mm": 5.0, "rotate": True, "marks": False}.items():
        jobs = jobs.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in jobs.columns else F.lit(d))
    c = F.col
    width = cm_to_px(c("width_cm"))
    cap = F.floor(F.lit(MOST_PIXELS) / width)
    limit = F.when(c("max_length_cm") > 0, F.least(cm_to_px(c("max_length_cm")), cap)).otherwise(cap)
    problem = (
        F.when(~c("width_cm").between(10, 200), "width").when(~c("max_length_cm").between(0, 2000) | ((c("max_length_cm") > 0) & (c("max_length_cm") < 10)), "length")
        .when(~c("spacing_mm").between(0, 50) | (c("marks") & (c("spacing_mm") < MARK_SPACING)), "spacing").when(~c("margin_mm").between(0, 50) | (c("marks") & (c("margin_mm") < MARK_MARGIN)), "margin")
        .when(width - 2 * mm_to_px(c("margin_mm")) <= 0, "no room")
    )
    ints = {"sheet_width": width, "gap": mm_to_px(c("spacing_mm")), "margin": mm_to_px(c("margin_mm")), "limit": limit}
    return jobs.withColumns({k: v.cast("int") for k, v in ints.items()} | {"problem": problem})


def expand_copies(items: DataFrame, *more: str) -> DataFrame:
    """items: (job_id, id, name, width, height, copies, further columns). A row for each copy, numbered from 1; 0 to 999 copies, others none."""
    n = F.when(F.col("copies").between(1, 999), F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return items.select("job_id", "id", "name", F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), *more, F.explode(n).alias("copy"))


class Skyline:
    """One sheet: the lower edge of what is free, as (x, y, w) from left to right."""

    def __init__(self, width: int):
        self.width, self.line = width, [(0, 0, width)]

    def best(self, w: int, h: int, limit: int, beat: tuple | None = None) -> tuple[int, int, int, int] | None:
        """(bottom, x, y, place in the line) of the lowest, then leftmost place. beat: another place, of which this one has to be lower, or as low and further left."""
        line, last, found = self.line, self.width - w, None
        under = limit - h + 1  # y has to be less
        bottom, at = beat[:2] if beat else (limit + h, 0)
        under = min(under, bottom - h + 1)
        for i, (x, y, left) in enumerate(line):
            if x > last:
                break
            if x >= at and under > bottom - h:
                under = bottom - h
            if y >= under:
                continue
            left, j = w - left, i
            while left > 0:
                j += 1
                _, over, wide = line[j]
                if over > y:
                    if over >= under:
                        break
                    y = over
                left -= wide
            else:
                under, found = y, (y + h, x, y, i)
        return found

    def put(self, i: int, x: int, w: int, bottom: int) -> None:
        line, end, j = self.line, x + w, i
        while j < len(line) and line[j][0] + line[j][2] <= end:
            j += 1
        rest = []
        if j < len(line):
            sx, sy, sw = line[j]
            j += 1
            if sy == bottom:  # only the new level can be as high as its neighbours
                w = sx + sw - x
            else:
                cut = max(sx, end)
                rest = [(cut, sy, sx + sw - cut)]
        if i and line[i - 1][1] == bottom:
            i -= 1
            x, w = line[i][0], line[i][2] + w
        line[i:j] = [(x, bottom, w), *rest]


def pack_runs(job: tuple, runs: list[tuple]) -> list[tuple]:
    """Packs one job. job: (job_id, sheet_width, gap, margin, limit, rotate); runs: (w, h, number) of pieces of one size that follow each other. Each goes on the first sheet that has room,
    upright unless lying ends lower (or as low and further left). Rows (sheet, number, x, y, step, width, height, rotated, sheet_height, problem) in order: so many pieces side by side, step apart.

    Where a piece lies on a level that is as wide as it or wider, the next one of its size goes beside it as long as the level goes on: nothing else ends as low and further left, as places only get worse.
    So these are placed together.
    """
    _, width, gap, margin, limit, rotate = job
    inner, limit = width - 2 * margin + gap, limit - 2 * margin + gap
    sheets: list[Skyline] = []
    used: list[int] = []
    rows, failed, full = [], {}, {}
    for w0, h0, left in runs:
        ways = [(w0, h0, False)] + ([(h0, w0, True)] if rotate and w0 != h0 else [])
        while left:
            if why := failed.get((w0, h0)):
                rows.append((None, left, 0, 0, 0, w0, h0, False, why))
                break
            # sheets only fill up: where a piece of that size found no room, the next one won't either
            for k in range(full.get((w0, h0), 0), len(sheets) + 1):
                sheet = sheets[k] if k < len(sheets) else Skyline(inner)
                best = None
                for w, h, turned in ways:
                    if b := sheet.best(w + gap, h + gap, limit, best and best[0]):
                        best = (b, w, h, turned)
                if best:
                    (bottom, x, y, i), w, h, turned = best
                    n = max(1, min(left, sheet.line[i][2] // (w + gap)))
                    sheet.put(i, x, n * (w + gap), bottom)
                    if k == len(sheets):
                        sheets.append(sheet)
                        used.append(0)
                    full[w0, h0] = k
                    used[k] = max(used[k], margin + y + h)
                    rows.append((k, n, margin + x, margin + y, w + gap, w, h, turned, None))
                    left -= n
                    break
            else:
                narrow = min(w0, h0) if rotate else w0
                failed[w0, h0] = "too wide" if narrow + 2 * margin > width else "too long"
    return [(k, n, x, y, step, w, h, t, None if k is None else used[k] + margin, why) for k, n, x, y, step, w, h, t, why in rows]


def _runs(sizes: Iterable[tuple]) -> list[tuple]:
    """(w, h, number) of those that follow each other, of (w, h, number)."""
    return [(w, h, sum(n for *_, n in same)) for (w, h), same in itertools.groupby(sizes, lambda s: s[:2])]


def pack_job(job: tuple, pieces: list[tuple]) -> list[tuple]:
    """pack_runs() of pieces (id, name, copy, w, h) in their order. Rows of PLACED."""
    found = pack_runs(job, _runs((w, h, 1) for *_, w, h in pieces))
    places = ((k, x + j * step, y, w, h, t, high, why) for k, n, x, y, step, w, h, t, high, why in found for j in range(n))
    return [(job[0], k, id_, name, copy, x, y, w, h, t, job[1], high, why) for (id_, name, copy, _, _), (k, x, y, w, h, t, high, why) in zip(pieces, places, strict=True)]


def _in_order(items: list[tuple]) -> Iterator[tuple]:
    """(id, name, first copy, number, w, h) of a job's items (id, name, copies, w, h), which are in the order of size and name: copies of an item one after the other, and of items that only differ in their ids by copy first."""
    for _, same in itertools.groupby(items, lambda t: (max(t[3], t[4]), t[3] * t[4], t[1])):
        same = list(same)
        if len(same) == 1:
            id_, name, copies, w, h = same[0]
            yield id_, name, 1, copies, w, h
        else:
            yield from ((i, name, c, 1, w, h) for c, i, name, w, h in sorted(((c, i, name, w, h) for i, name, n, w, h in same for c in range(1, n + 1)), key=lambda t: t[:2]))


def _placed_batch(pieces: list[tuple], places: list[tuple]) -> pa.RecordBatch:
    """PLACED rows of pieces (job_id, sheet_width, id, name, first copy, number) and of their places, rows of pack_runs()."""
    job, wide, id_, name, first, n = zip(*pieces, strict=True)
    of_piece = np.repeat(np.arange(len(n)), n)
    copy = np.arange(len(of_piece)) - np.repeat(np.cumsum(n) - n, n) + np.array(first)[of_piece]
    k, m, x, y, step, w, h, turned, high, why = zip(*places, strict=True)
    of_place = np.repeat(np.arange(len(m)), m)
    x = np.array(x)[of_place] + np.array(step)[of_place] * (np.arange(len(of_place)) - np.repeat(np.cumsum(m) - m, m))
    by_piece, by_place = pa.array(of_piece), pa.array(of_place)
    piece = lambda v, kind: pa.array(v, kind).take(by_piece)
    place = lambda v, kind: pa.array(v, kind).take(by_place)
    i32, i64 = pa.int32(), pa.int64()
    columns = [
        piece(job, i64), place(k, i32), piece(id_, i64), piece(name, pa.string()), pa.array(copy.astype(np.int32)), pa.array(x.astype(np.int32)), place(y, i32), place(w, i32), place(h, i32), place(turned, pa.bool_()),
        piece(wide, i32), place(high, i32), place(why, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACED.split(", ")])


def _jobs_of(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[tuple[list[tuple], list[tuple], list[tuple]]]:
    """Packs jobs whose items come one after the other, in order: (jobs and the number of their places, pieces, places) of whole jobs, about `most` copies at once. pieces and places: as for _placed_batch()."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    jobs, pieces, places, size = [], [], [], 0
    for _, items in itertools.groupby(rows, lambda r: r[0]):
        items = list(items)
        job, own = items[0][:6], list(_in_order([r[6:11] for r in items]))
        found = pack_runs(job, _runs((w, h, n) for *_, n, w, h in own))
        places += found
        jobs.append((job[0], job[1], len(found)))
        pieces += [(*job[:2], id_, name, first, n) for id_, name, first, n, _, _ in own]
        size += sum(p[3] for p in own)
        if size >= most:
            yield jobs, pieces, places
            jobs, pieces, places, size = [], [], [], 0
    if jobs:
        yield jobs, pieces, places


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PLACED rows of packed jobs. Copies become rows at the very end."""
    for _, pieces, places in _jobs_of(batches):
        yield _placed_batch(pieces, places)


#: So many pieces of one size side by side, step apart from x on; those without a sheet have a problem.
LEVELS = "job_id long, sheet int, pieces long, x int, y int, step int, width int, height int, sheet_width int, sheet_height int, problem string"


def _level_batch(jobs: list[tuple], places: list[tuple]) -> pa.RecordBatch:
    """LEVELS rows of whole jobs."""
    id_, wide, n = (np.array(v) for v in zip(*jobs, strict=True))
    k, m, x, y, step, w, h, _, high, why = zip(*places, strict=True) if places else [()] * 10
    i32, i64 = pa.int32(), pa.int64()
    columns = [pa.array(np.repeat(id_, n), i64), pa.array(k, i32), pa.array(m, i64), *(pa.array(v, i32) for v in (x, y, step, w, h)), pa.array(np.repeat(wide, n).astype(np.int32)), pa.array(high, i32), pa.array(why, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LEVELS.split(", ")])


def _ready(items: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of sound jobs in their partitions and order, items of jobs whose options break a rule)."""
    o = sheet_options(jobs).select("job_id", "sheet_width", "gap", "margin", "limit", "rotate", "problem")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = items.join(o.where("problem is null").hint("merge"), "job_id").repartition(parts, "job_id")  # a number, so that small input isn't put into few tasks
    more = ["sheet_width", "gap", "margin", "limit", "rotate"]
    c = F.col
    some = fine.where("copies between 1 and 999").select(c("job_id").cast("long"), *more, c("id").cast("long"), "name", c("copies").cast("int").alias("copies"), c("width").cast("int").alias("w"), c("height").cast("int").alias("h"))
    order = ["job_id", F.desc(F.greatest("w", "h")), F.desc(F.col("w").cast("long") * F.col("h")), "name", "id"]
    return some.sortWithinPartitions(*order), items.join(o.where("problem is not null"), "job_id")


def pack_sheets(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """PLACED rows, one for each copy of each item; a piece that fits nowhere has a problem and no sheet, as have all pieces of a job whose options break a rule.
    A job is packed in one task, piece after piece; items are moved, and become copies when the job is packed."""
    good, bad = _ready(items, jobs)
    none = lambda t: F.lit(None).cast(t)
    bad = expand_copies(bad, "sheet_width", "problem").select(
        F.col("job_id").cast("long"), none("int").alias("sheet"), F.col("id").cast("long"), "name", "copy", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("w").alias("width"), F.col("h").alias("height"), F.lit(False).alias("rotated"), "sheet_width", none("int").alias("sheet_height"), "problem"
    )
    return good.mapInArrow(_pack, PLACED).unionByName(bad)


def pack_levels(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """LEVELS: the places of pack_sheets() before copies become rows, for whoever asks nothing of each copy."""
    good, bad = _ready(items, jobs)
    none, zero = F.lit(None), F.lit(0)
    bad = bad.where("copies between 1 and 999").select(
        F.col("job_id").cast("long"), none.cast("int").alias("sheet"), F.col("copies").cast("long").alias("pieces"), *(zero.alias(c) for c in ("x", "y", "step")), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "sheet_width", none.cast("int").alias("sheet_height"), "problem"
    )
    return good.mapInArrow(lambda batches: (_level_batch(jobs_, places) for jobs_, _, places in _jobs_of(batches) if places), LEVELS).unionByName(bad)


def overlaps(sheet: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, gap: int, most: int = 1 << 22) -> np.ndarray:
    """For each piece, by its place in the order of sheet, y and x, how many later ones of its sheet are nearer than the gap, exactly: a piece is held against all that start above its lower edge, some millions of pairs at a time."""
    order = np.lexsort((x, y, sheet))
    sheet, x, y, w, h = (v[order].astype(np.int64) for v in (sheet, x, y, w, h))
    sheet = np.cumsum(np.r_[0, sheet[1:] != sheet[:-1]]) if len(sheet) else sheet
    key = (sheet << 33) + y
    n = np.searchsorted(key, key + h + gap) - np.arange(len(key)) - 1
    found, done, ends = np.zeros(len(key), np.int64), 0, np.cumsum(n)
    while done < len(key):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most)))
        count = n[done:upto]
        i = np.repeat(np.arange(done, upto), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        meet = (x[j] < x[i] + w[i] + gap) & (x[i] < x[j] + w[j] + gap)
        found += np.bincount(i[meet], minlength=len(key))
        done = upto
    back = np.empty_like(found)
    back[order] = found
    return back


def check_levels(batch: pa.RecordBatch, gap: int, margin: int) -> pa.RecordBatch:
    """CHECKED rows of whole jobs: every copy of their levels is looked at."""
    job, m, x, y, step, w, h, wide = (batch.column(c).to_numpy() for c in ("job_id", "pieces", "x", "y", "step", "width", "height", "sheet_width"))
    at = np.repeat(np.arange(len(m)), m)
    x = x[at] + step[at].astype(np.int64) * (np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m))
    on = batch.column("sheet").is_valid().to_numpy(zero_copy_only=False)[at]
    ids, of = np.unique(job, return_inverse=True)
    of = of[at]
    total = lambda v: np.bincount(of, v, len(ids)).astype(np.int64)
    places, here = np.flatnonzero(on), at[on]
    k, high = (pc.fill_null(batch.column(c), 0).to_numpy()[at] for c in ("sheet", "sheet_height"))
    y, w, h = (v[at].astype(np.int64) for v in (y, w, h))
    out = on & ((x < margin) | (y < margin) | (x + w > wide[at] - margin) | (y + h > high - margin))
    met = np.zeros(len(at), np.int64)
    met[places] = overlaps((of[places].astype(np.int64) << 31) + k[places], x[places], y[places], w[places], h[places], gap)
    found = [total(np.ones(len(at))), total(on), total(np.where(on, w * h, 0)), total(met), total(out)]
    return pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, found)], [c.split()[0] for c in CHECKED.split(", ")])


CHECKED = "job_id long, pieces long, placed long, area long, overlaps long, outside long"


def check_sheets(items: DataFrame, jobs: DataFrame, gap: int, margin: int) -> DataFrame:
    """CHECKED for each job: its pieces, those that are placed and their area, how many pairs of pieces on a sheet are nearer than gap, and how many pieces leave a sheet's margins. Jobs are checked where they are packed, copy by copy, so no copy is moved or
    written."""
    good, bad = _ready(items, jobs)
    bad = bad.where("copies between 1 and 999").groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.sum(F.col("copies").cast("long")).alias("pieces"))
    bad = bad.select("job_id", "pieces", *(F.lit(0).cast("long").alias(c) for c in ("placed", "area", "overlaps", "outside")))
    return good.mapInArrow(lambda batches: (check_levels(_level_batch(jobs_, places), gap, margin) for jobs_, _, places in _jobs_of(batches) if places), CHECKED).unionByName(bad)


def placements(placed: DataFrame) -> DataFrame:
    """Placed pieces with their place in the order of y, then x."""
    from pyspark.sql import Window

    w = Window.partitionBy("job_id", "sheet").orderBy("y", "x")
    return placed.where("sheet is not null").withColumn("position", F.row_number().over(w))


def sheet_summary(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by sheet: pieces, height, used percent; by job: sheets, pieces, square metres, used percent weighted by area)."""
    on = placed.where("sheet is not null")
    area = F.sum(F.col("width").cast("long") * F.col("height"))
    s = on.groupBy("job_id", "sheet").agg(F.count("*").alias("pieces"), F.first("sheet_width").alias("sheet_width"), F.first("sheet_height").alias("sheet_height"), area.alias("used"))
    s = s.withColumn("used_percent", F.col("used") / (F.col("sheet_width").cast("long") * F.col("sheet_height")) * 100.0)
    whole = F.sum(F.col("sheet_width").cast("long") * F.col("sheet_height"))
    m2 = F.sum(px_to_cm(F.col("sheet_width")) * px_to_cm(F.col("sheet_height"))) / 10000.0
    return s, s.groupBy("job_id").agg(F.count("*").alias("sheets"), F.sum("pieces").alias("pieces"), m2.alias("area_m2"), (F.sum("used") / whole * 100.0).alias("used_percent"))


def _mark_px() -> tuple[int, int, int]:
    """Distance, length and thickness of a bar in pixels."""
    px = lambda mm, least: max(least, int(mm / 25.4 * 300 + 0.5))
    return px(MARK_OFFSET, 1), px(MARK_LENGTH, 4), px(MARK_WIDTH, 2)


#: Bars of a piece.
MARKS = 8


def mark_bounds(levels: DataFrame) -> DataFrame:
    """(job_id, marks, left, top): of the bars that cut_marks() makes their number, and the least left and greatest top. Of a level the first piece's bars are furthest to the left, and all are as far down."""
    off, length, thick = _mark_px()
    left, top = F.least(F.col("x") - off - length, F.col("x")), F.greatest(F.col("y") + F.col("height") + off, F.col("y") + F.col("height") - thick)
    return levels.where("sheet is not null").groupBy("job_id").agg((F.sum("pieces") * MARKS).alias("marks"), F.min(left).alias("left"), F.max(top).alias("top"))


def cut_marks(placed: DataFrame) -> DataFrame:
    """(job_id, sheet, left, top, width, height): eight bars beside the corners of each piece."""
    off, length, thick = _mark_px()
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    bar = lambda left, top, bw, bh: F.struct(left.alias("left"), top.alias("top"), F.lit(bw).alias("width"), F.lit(bh).alias("height"))
    flat = [bar(left, top, length, thick) for top in (y, y + h - thick) for left in (x - off - length, x + w + off)]
    tall = [bar(left, top, thick, length) for left in (x, x + w - thick) for top in (y - off - length, y + h + off)]
    return placed.where("sheet is not null").select("job_id", "sheet", F.explode(F.array(*flat, *tall)).alias("m")).select("job_id", "sheet", "m.*")


#: Copies of a design that meet its tiles in one task, about.
SHARE = 4096


def _with_tiles(place: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each copy with its design's tiles. The copies of a design are dealt into shares by their place, and each share gets the tiles once: a design with a million copies is many tasks' work. place: written."""
    shares = place.groupBy("image_id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    copies = place.join(shares, "image_id").withColumn("share", F.pmod(F.xxhash64("job_id", "sheet", "x", "y"), F.col("shares")).cast("int")).drop("shares")
    own = tiles.select("image_id", "left", "top", "width", "height", "data").join(shares.hint("shuffle_hash"), "image_id").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return copies.join(own.hint("merge"), ["image_id", "share"])


def compose_sheets(placed: DataFrame, tiles: DataFrame, marks: DataFrame | None = None, core: int = CORE) -> DataFrame:
    """TILES of the sheets (image_id is a hash of job and sheet; job_id and sheet are added). tiles: of designs, image_id as in placed.id. Each placed copy takes its
    design's tiles, turned where the copy is turned; each then falls into some tiles of the sheet. Black marks lie over all."""
    place = keep(placed.where("sheet is not null").select("job_id", "sheet", F.col("id").alias("image_id"), "x", "y", F.col("width").alias("pw"), "rotated", F.col("sheet_width").alias("gw"), F.col("sheet_height").alias("gh")), "sheet-places")
    j = _with_tiles(place, tiles)
    schema = "job_id long, sheet int, tile_y int, tile_x int, z int, left int, top int, width int, height int, gw int, gh int, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rows_of(batches):
            d, left, top, rows = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 4), t.left, t.top, []
            if t.rotated:  # a quarter turn to the right: pw is the design's height
                d, left, top = np.rot90(d, -1), t.pw - (t.top + t.height), t.left
            left, top = left + t.x, top + t.y
            h, w = d.shape[:2]
            for ty in range(top // core, (top + h - 1) // core + 1):
                for tx in range(left // core, (left + w - 1) // core + 1):
                    x0, x1, y0, y1 = max(left, tx * core), min(left + w, (tx + 1) * core), max(top, ty * core), min(top + h, (ty + 1) * core)
                    rows.append((t.job_id, t.sheet, ty, tx, 0, x0, y0, x1 - x0, y1 - y0, t.gw, t.gh, d[y0 - top : y1 - top, x0 - left : x1 - left].tobytes()))
            yield batch_of(rows, schema)

    pieces = j.mapInArrow(cut, schema)
    if marks is not None:
        size = place.select("job_id", "sheet", "gw", "gh").distinct()
        cell = lambda a, n: F.sequence(F.floor(F.greatest(F.lit(0), F.col(a)) / core), F.floor((F.col(a) + F.col(n) - 1) / core))
        m = marks.where("left + width > 0 and top + height > 0").join(size.hint("shuffle_hash"), ["job_id", "sheet"]).withColumn("ty", F.explode(cell("top", "height"))).withColumn("tx", F.explode(cell("left", "width")))
        m = m.select("job_id", "sheet", F.col("ty").cast("int").alias("tile_y"), F.col("tx").cast("int").alias("tile_x"), F.lit(1).alias("z"), "left", "top", "width", "height", "gw", "gh", F.lit(None).cast("binary").alias("data"))
        pieces = pieces.unionByName(m)

    def build(f: pa.Table) -> pa.Table:
        parts = list(rows_of(f.to_batches()))
        r = parts[0]
        left, top = r.tile_x * core, r.tile_y * core
        w, h = min(core, r.gw - left), min(core, r.gh - top)
        if w <= 0 or h <= 0:
            return pa.Table.from_batches([batch_of([], made)])
        out = np.zeros((h, w, 4), np.uint8)
        for p in sorted(parts, key=lambda p: p.z):
            x0, x1, y0, y1 = max(p.left, left), min(p.left + p.width, left + w), max(p.top, top), min(p.top + p.height, top + h)
            if x0 >= x1 or y0 >= y1:
                continue
            box = out[y0 - top : y1 - top, x0 - left : x1 - left]
            if p.data is None:
                box[:] = (0, 0, 0, 255)
            else:
                d = np.frombuffer(p.data, np.uint8).reshape(p.height, p.width, 4)[y0 - p.top : y1 - p.top, x0 - p.left : x1 - p.left]
                box[d[..., 3] > 0] = d[d[..., 3] > 0]
        return pa.Table.from_batches([batch_of([(r.job_id, r.sheet, 0, r.tile_x, r.tile_y, left, top, w, h, 4, out.tobytes())], made)])

    made = f"job_id long, sheet int, {TILES}"
    sheets = pieces.groupBy("job_id", "sheet", "tile_y", "tile_x").applyInArrow(build, made)
    return sheets.withColumn("image_id", F.xxhash64("job_id", "sheet"))


def film_cost(area_m2: Column, price_m2: Column) -> Column:
    return area_m2 * price_m2
