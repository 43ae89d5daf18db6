"""Kernels and packing against plain versions that look at each pixel, or each place, on its own."""

import math
import random

import numpy as np
import pytest

from inkgrid.operators import kernels as K
from inkgrid.operators import sheets
from rasters import filled

W, H = 23, 17


def raster(seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:H, 0:W]
    rgba = np.stack([(127 + 120 * np.sin(x / 3 + seed + c) * np.cos(y / 4)).clip(0, 255) for c in range(3)] + [np.where(rng.random((H, W)) < 0.15, 0, np.where((x + y) % 9 < 6, 255, rng.integers(0, 256, (H, W))))], axis=-1)
    return rgba.astype(np.uint8)


def around(y, x, r):
    return [(yy, xx) for yy in range(y - r, y + r + 1) for xx in range(x - r, x + r + 1) if (yy, xx) != (y, x)]


def inside(y, x):
    return 0 <= y < H and 0 <= x < W


@pytest.mark.parametrize("seed", [1, 2])
def test_gaussian(seed):
    """Weights of a bell of 11 pixels along both axes; transparent pixels neither count nor get anything."""
    rng = np.random.default_rng(seed)
    alpha = raster(seed)[..., 3]
    cov = np.where(alpha > 0, rng.integers(0, 65536, (H, W)), 0).astype(np.float64)
    bell = [math.exp(-(i * i) / (2 * 1.4 * 1.4)) for i in range(-5, 6)]
    got = K.gaussian(cov, alpha)
    for y in range(H):
        for x in range(W):
            near = [(bell[dy + 5] * bell[dx + 5], cov[y + dy, x + dx]) for dy in range(-5, 6) for dx in range(-5, 6) if inside(y + dy, x + dx) and alpha[y + dy, x + dx] > 0]
            want = sum(w * v for w, v in near) / sum(w for w, _ in near) if alpha[y, x] else 0
            assert abs(got[y, x] - want) <= 0.51


def test_guided():
    """Blocks of 4 x 4 document pixels: a line value = a * value + b from the blocks' means in 11 x 11 blocks, and straight lines between block centres."""
    alpha = raster(3)[..., 3]
    cov = np.where(alpha > 0, np.random.default_rng(3).integers(0, 65536, (H, W)), 0).astype(np.float64)
    o, left, top = filled(origin_x=1.0, origin_y=2.0), 5, 7
    x0, y0 = left + 1, top + 2
    cells = {}
    for y in range(H):
        for x in range(W):
            c = cells.setdefault(((y + y0) // 4, (x + x0) // 4), [])
            if alpha[y, x]:
                c.append(cov[y, x] / 65535)
    near = lambda b: [c for (by, bx), c in cells.items() if abs(by - b[0]) <= 5 and abs(bx - b[1]) <= 5 and c]
    line = {}
    for b in cells:
        own = near(b)
        n = sum(map(len, own))
        m = sum(map(sum, own)) / n
        q = sum(len(c) * (sum(c) / len(c)) ** 2 for c in own) / n
        a = max(0.0, q - m * m) / (max(0.0, q - m * m) + (24 / 255) ** 2)
        line[b] = a, m - a * m
    flat = {}
    for b in cells:
        own = [(len(c), line[k]) for k, c in cells.items() if abs(k[0] - b[0]) <= 5 and abs(k[1] - b[1]) <= 5]
        n = sum(k for k, _ in own)
        flat[b] = tuple(sum(k * v[i] for k, v in own) / n for i in (0, 1))
    ys, xs = sorted({b[0] for b in cells}), sorted({b[1] for b in cells})
    got = K.guided(cov, alpha, left, top, o)
    for y in range(H):
        for x in range(W):
            cy, cx = (y + y0 + 0.5) / 4 - 0.5, (x + x0 + 0.5) / 4 - 0.5
            ty, tx = (0.0 if cy < ys[0] else cy - math.floor(cy)), (0.0 if cx < xs[0] else cx - math.floor(cx))
            pick = lambda v, all_: min(max(v, all_[0]), all_[-1])
            ya, yb, xa, xb = pick(math.floor(cy), ys), pick(math.floor(cy) + 1, ys), pick(math.floor(cx), xs), pick(math.floor(cx) + 1, xs)
            a, b = ((1 - ty) * ((1 - tx) * flat[ya, xa][i] + tx * flat[ya, xb][i]) + ty * ((1 - tx) * flat[yb, xa][i] + tx * flat[yb, xb][i]) for i in (0, 1))
            want = min(65535, max(0, (a * cov[y, x] / 65535 + b) * 65535)) if alpha[y, x] else 0
            assert abs(got[y, x] - want) <= 1.01  # planes are held as 32-bit floats


@pytest.mark.parametrize(("radius", "blur", "seed"), [(1, 0, 1), (1, 1, 2), (2, 1, 3), (2, 2, 4)])
def test_opening(radius, blur, seed):
    rng = np.random.default_rng(seed)
    mask, keep = rng.random((H, W)) < 0.7, rng.random((H, W)) < 0.05
    edge = lambda m, y, x: m[min(max(y, 0), H - 1), min(max(x, 0), W - 1)]
    soft = {(y, x): 2 * sum(int(edge(mask, y + dy, x + dx)) for dy in range(-blur, blur + 1) for dx in range(-blur, blur + 1)) >= (2 * blur + 1) ** 2 for y in range(H) for x in range(W)}
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    thin = {p: all(soft.get((p[0] + dy, p[1] + dx), True) for dy, dx in disc) for p in soft}
    got = K.opened(mask, np.ones((H, W), bool), radius, blur, keep)
    for y, x in soft:
        want = mask[y, x] and (keep[y, x] or any(thin.get((y + dy, x + dx), False) for dy, dx in disc))
        assert got[y, x] == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_defringe_and_edges(radius):
    rgba = raster(5)
    value = np.where(rgba[..., 3] > 0, np.random.default_rng(5).choice([0.0, 0.005, 0.4, 1.0], (H, W)), 0.0)
    all_in = np.ones((H, W), bool)
    moved, edges = K.defringed(rgba, value, radius, 60.0, all_in), K.edge_protected(rgba, value, radius, 96.0, all_in)
    c = rgba[..., :3].astype(float)
    for y in range(H):
        for x in range(W):
            near = [p for p in around(y, x, radius) if inside(*p)]
            beside = any(value[p] < 0.01 for p in near)
            solid = sorted((p for p in near if rgba[p][3] >= 250 and value[p] >= 0.995), key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, p))
            want = c[y, x]
            if beside and solid and value[y, x] < 0.995:
                want = np.floor(c[y, x] + (c[solid[0]] - c[y, x]) * 0.6 + 0.5)
            assert (moved[y, x] == want).all()
            far = any(rgba[p][3] < 128 or (rgba[p][3] >= 250 and math.dist(c[p], c[y, x]) >= 96) for p in near)
            assert edges[y, x] == (rgba[y, x, 3] >= 250 and value[y, x] > 0 and far)


@pytest.mark.parametrize("choke", [2, 5])
def test_white(choke):
    """The highest distance that strictly rising steps reach, by a walk from each pixel."""
    mask = np.random.default_rng(choke).random((H, W)) < 0.97
    empty = [tuple(p) for p in np.argwhere(~mask)]
    cap = K.white_reach(choke)
    d = {(y, x): min(cap, min(max(abs(y - a), abs(x - b)) for a, b in empty)) for y in range(H) for x in range(W)}

    def top(p):
        return max([d[p], *(top(q) for q in around(*p, 1) if inside(*q) and d[q] > d[p])])

    got = K.white_mask(mask, choke)
    for p in d:
        ridge = not any(inside(*q) and d[q] > d[p] for q in around(*p, 1))
        assert got[p] == (bool(mask[p]) and (d[p] > min(choke, math.floor(0.35 * top(p))) or ridge))


def places(job, pieces):
    """A packer that knows how high each pixel column of a sheet is filled: a piece goes where its lower edge comes highest up, then leftmost, among the places where the filling changes."""
    _, width, gap, margin, limit, rotate = job
    room, tall = width - 2 * margin + gap, limit - 2 * margin + gap
    sheets_, out = [], []
    for id_, name, copy, w0, h0 in pieces:
        ways = [(w0, h0)] + ([(h0, w0)] if rotate and w0 != h0 else [])
        for k in range(len(sheets_) + 1):
            filled_ = sheets_[k] if k < len(sheets_) else np.zeros(room, np.int64)
            best = None
            for w, h in ways:
                starts = [0, *(np.flatnonzero(np.diff(filled_)) + 1)]
                fits = [(int(filled_[x : x + w + gap].max()) + h + gap, x) for x in starts if x + w + gap <= room]
                fits = [f for f in fits if f[0] <= tall]
                if fits and (best is None or min(fits) < best[0]):
                    best = (min(fits), w, h)
            if best:
                (bottom, x), w, h = best
                filled_[x : x + w + gap] = bottom
                if k == len(sheets_):
                    sheets_.append(filled_)
                out.append((id_, copy, k, margin + x, margin + bottom - h - gap, w, h))
                break
        else:
            out.append((id_, copy, None, 0, 0, w0, h0))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_packing_against_a_packer_that_looks_at_every_column(seed):
    rng = random.Random(seed)
    pieces = [(i, f"n{i}", 1, rng.randrange(20, 260), rng.randrange(20, 260)) for i in range(40)] + [(99, "wide", 1, 700, 650)]
    pieces.sort(key=lambda p: (-max(p[3:]), -p[3] * p[4], p[1]))
    job = (1, 600, rng.choice([0, 7]), rng.choice([0, 12]), rng.choice([500, 900, 100_000]), seed % 2 == 0)
    got = [(r[2], r[4], r[1], r[5], r[6], r[7], r[8]) for r in sheets.pack_job(job, pieces)]
    assert got == places(job, pieces)


def test_composed_marks_lie_over_designs(spark):
    """U4: where a bar meets a design, the bar is seen."""
    from inkgrid import schema
    from inkgrid.operators import tiles

    d = spark.createDataFrame([(1, x, y, 200, 100, 50, 255) for x in range(12) for y in range(9)], schema.PIXELS)
    t = tiles.pixels_to_tiles(d, spark.createDataFrame([(1, 12, 9)], "image_id long, width int, height int"), 8)
    placed = spark.createDataFrame([(1, 0, 1, "a", 1, 20, 10, 12, 9, False, 60, 40, None)], sheets.PLACED)
    marks = spark.createDataFrame([(1, 0, 18, 12, 6, 2), (1, 0, 0, 0, 3, 3), (1, 0, 58, 38, 9, 9)], "job_id long, sheet int, left int, top int, width int, height int")
    out = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in tiles.tiles_to_pixels(sheets.compose_sheets(placed, t, marks, 16)).collect()}
    want = {(20 + x, 10 + y): (200, 100, 50) for x in range(12) for y in range(9)}
    for left, top, w, h in ((18, 12, 6, 2), (0, 0, 3, 3), (58, 38, 2, 2)):
        want |= {(left + x, top + y): (0, 0, 0) for x in range(w) for y in range(h)}
    assert out == want


def test_selection_on_tiles(spark):
    """Protection by a soft mask gives on tiles what it gives on the whole image; tiles without a mask protect nothing."""
    from inkgrid.functions import options
    from inkgrid.operators import process
    from test_tiles import as_tiles, whole

    big = np.tile(raster(7), (2, 2, 1))
    soft = np.random.default_rng(7).integers(0, 256, (*big.shape[:2], 1)).astype(np.uint8)
    soft[:16, 16:32] = 0
    art = spark.createDataFrame([(1, 2 * W, 2 * H, 0)], "image_id long, width int, height int, recipe_id long")
    masks = as_tiles(spark, {1: soft}, 16).where("not (tile_x = 1 and tile_y = 0)").selectExpr("image_id", "tile_x", "tile_y", "left", "top", "width", "height", "1 AS components", "data")
    for o in ({"protection": "selection", "cleanup": "high"}, {"protection": "selection", "min_diameter_mm": 0.0}):
        recipes = options.with_defaults(options.recipes(spark, [{"recipe_id": 0, **o}]))
        out = process.process_tiles(as_tiles(spark, {1: big}, 16), art, recipes, 16, masks).cache()
        r = K.process(big, filled(**o), selection=soft[..., 0])
        assert (whole(out, 1, big.shape) == r.rgba).all() and r.protected.any()
        assert process.tile_stats(out).first()["protected_pixels"] == r.protected.sum()


def test_operators_leave_the_session_as_it_is(spark):
    from inkgrid import queries

    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    for name in ("tile_audit", "thumbnail_sums", "previews", "stream_requests"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert before == {r["key"]: r["value"] for r in spark.sql("SET").collect()}


def test_folder_where_none_is_set():
    """A local session gets one temporary folder for its application, any other an error; neither gets a setting."""
    from types import SimpleNamespace

    from inkgrid.sources.workspace import shared_dir

    of = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, applicationId="an application"))
    assert shared_dir(of("local[4]")).startswith("file:///") and shared_dir(of("local[4]")) == shared_dir(of("local[2]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(of("spark://host:7077"))


def test_a_design_with_many_copies(spark, monkeypatch):
    """Copies of one design in many shares, some turned, give the sheet that one array gives."""
    from inkgrid import schema
    from inkgrid.operators import tiles

    monkeypatch.setattr(sheets, "SHARE", 7)
    rng = np.random.default_rng(5)
    art = rng.integers(0, 256, (9, 12, 4)).astype(np.uint8)
    art[..., 3] = np.where(rng.random((9, 12)) < 0.3, 0, 255)
    px = [(1, x, y, *map(int, art[y, x])) for y in range(9) for x in range(12) if art[y, x, 3]]
    t = tiles.pixels_to_tiles(spark.createDataFrame(px, schema.PIXELS), spark.createDataFrame([(1, 12, 9)], "image_id long, width int, height int"), 8)
    want, placed = np.zeros((130, 140, 4), np.uint8), []
    for n in range(100):
        x, y, turned = n % 10 * 13 + 2, n // 10 * 13, n % 3 == 0
        d = np.rot90(art, -1) if turned else art
        h, w = d.shape[:2]
        want[y : y + h, x : x + w] = np.where(d[..., 3:] > 0, d, 0)
        placed.append((5, 0, 1, "a", n, x, y, w, h, turned, 140, 130, None))
    out = np.zeros_like(want)
    for r in sheets.compose_sheets(spark.createDataFrame(placed, sheets.PLACED), t, None, 32).collect():
        out[r["top"] : r["top"] + r["height"], r["left"] : r["left"] + r["width"]] = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)
    assert (out == want).all()
