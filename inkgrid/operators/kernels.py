"""NumPy steps on one raster (a tile with its surroundings, or a whole image). No Spark here.

Places are global: `left` and `top` say where the array's first pixel is in its image, so that a tile gives what the whole image gives.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np

BINS, SAMPLES = 8192, 512


def unit(x):
    return np.minimum(1.0, np.maximum(0.0, x))


def rnd(x):
    return np.floor(x + 0.5)


# ---- rasters side by side


class Box(NamedTuple):
    """Where one of several rasters lies in an array that holds them all, and where its first pixel is in its image."""

    rows: slice
    columns: slice
    left: int
    top: int


def side_by_side(rasters: list[tuple[int, int, int, int]], gap: int, width: int = 512) -> tuple[list[Box], tuple[int, int]]:
    """(boxes, shape of the array) of rasters (height, width, left, top), in shelves of about `width` pixels with `gap` empty pixels between any two: steps that look no further than that give each of them what it gives alone, so that
    many small rasters cost one call."""
    boxes, width = [None] * len(rasters), max([width, *(r[1] for r in rasters)])
    x, y, high, wide = 0, 0, 0, 0
    for i in sorted(range(len(rasters)), key=lambda i: rasters[i][:2], reverse=True):
        h, w, left, top = rasters[i]
        if x and x + w > width:
            x, y, high = 0, y + high + gap, 0
        boxes[i] = Box(slice(y, y + h), slice(x, x + w), left, top)
        high, wide, x = max(high, h), max(wide, x + w), x + w + gap
    return boxes, (y + high, wide)


# ---- coverage


def coverage(rgba: np.ndarray, o: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """(raw, m): coverage before levels, and the share of ink that recovery finds (None without)."""
    a = rgba[..., 3].astype(np.float64)
    op, m = a / 255.0, None
    if o["knockout"]:
        r, g, b = (rgba[..., i].astype(np.float64) - o[f"key_{k}"] for i, k in enumerate("rgb"))
        d = np.sqrt(r * r + g * g + b * b) / (255.0 * math.sqrt(3.0))
        t = unit((d - o["tolerance"] / 100.0) / (o["softness"] / 100.0))
        op = op * (t * t * (3.0 - 2.0 * t))
        if o["recover"]:
            c, key = rgba[..., :3].astype(np.float64), np.array([o["key_r"], o["key_g"], o["key_b"]], np.float64)
            up, down = np.where(key == 255, 1.0, 255.0 - key), np.where(key == 0, 1.0, key)
            m = unit(np.where(c >= key, (c - key) / up, (key - c) / down).max(axis=-1))
            op = op * m
    raw = (op if o["gamma"] == 1 else np.power(op, 1.0 / o["gamma"])) * (o["strength"] / 100.0)
    return np.where(a > 0, raw, 0.0), m


def levels(raw: np.ndarray, o: dict) -> np.ndarray:
    """Levels, inverse gain and solid tones."""
    t = unit((raw * 255.0 - o["input_black"]) / (o["input_white"] - o["input_black"]))
    t = t if o["input_midtone"] == 1 else np.power(t, 1.0 / o["input_midtone"])
    v = np.where(raw <= 0, 0.0, (o["output_black"] + t * (o["output_white"] - o["output_black"])) / 255.0)
    if o.get("gain"):
        xs, ys = np.array([0.0, *(p[1] for p in o["gain"]), 100.0]), np.array([0.0, *(p[0] for p in o["gain"]), 100.0])
        d = v * 100.0
        i = np.clip(np.searchsorted(xs, d, side="left"), 1, len(xs) - 1)
        line = (ys[i - 1] + (ys[i] - ys[i - 1]) * (d - xs[i - 1]) / (xs[i] - xs[i - 1])) / 100.0
        v = np.where(d <= 0, 0.0, np.where(d >= 100, 1.0, line))
    if o["solid_above"] < 100:
        v = np.where((v > 0) & (v >= o["solid_above"] / 100.0), 1.0, v)
    return v


# ---- screen


def spot_bins(u: np.ndarray, v: np.ndarray, shape: str) -> np.ndarray:
    if shape == "ellipse":
        key = (u * u + 4.0 * v * v) / 1.25
    else:
        x, y = 2.0 * u, 2.0 * v
        key = np.where(x + y <= 1, x * x + y * y, 2.0 - ((x - 1.0) ** 2 + (y - 1.0) ** 2)) / 2.0
    return np.minimum(BINS - 1, np.floor(key * BINS)).astype(np.int64)


@functools.cache
def spot_table(shape: str) -> np.ndarray:
    at = np.abs((np.arange(SAMPLES) + 0.5) / SAMPLES - 0.5)
    n = np.bincount(spot_bins(at[None, :], at[:, None], shape).ravel(), minlength=BINS)
    return (np.cumsum(n) / SAMPLES**2).astype(np.float32).astype(np.float64)


def thresholds(h: int, w: int, left: int, top: int, o: dict, dpi: float = 300.0) -> np.ndarray:
    gx, gy = np.arange(w) + left + o["origin_x"] + 0.5, (np.arange(h) + top + o["origin_y"] + 0.5)[:, None]
    theta, cell = o["angle"] * math.pi / 180.0, dpi / o["lpi"]
    cos, sin = math.cos(theta), math.sin(theta)
    u, v = (gx * cos + gy * sin) / cell, (-gx * sin + gy * cos) / cell
    u, v = np.abs(u - np.floor(u) - 0.5), np.abs(v - np.floor(v) - 0.5)
    shape = o["shape"]
    if shape in ("ellipse", "euclidean"):
        return spot_table(shape)[spot_bins(u, v, shape)]
    if shape == "line":
        t = o["line_trim"] / 100.0
        return t + (1.0 - 2.0 * t) * 2.0 * v if t else 2.0 * v
    if shape == "square":
        s = np.maximum(u, v)
        return 4.0 * (s * s)
    if shape == "diamond":
        s = u + v
        return np.where(s <= 0.5, 2.0 * s * s, 1.0 - 2.0 * (1.0 - s) * (1.0 - s))
    r = np.sqrt(u * u + v * v)
    disc = math.pi * r * r
    far = r > 0.5
    r = r[far]
    ring = disc[far] - 4.0 * (r * r * np.arccos(0.5 / r) - 0.5 * np.sqrt(np.maximum(0.0, r * r - 0.25)))
    disc[far] = np.where(r >= math.sqrt(0.5), 1.0, ring)
    return disc


def thresholds_of(boxes: list[Box], shape: tuple[int, int], o: dict, dpi: float = 300.0) -> np.ndarray:
    """thresholds() of rasters side by side, made once for all that begin at the same place."""
    out, most = np.zeros(shape), {}
    for b in boxes:
        h, w = most.get((b.left, b.top), (0, 0))
        most[b.left, b.top] = max(h, b.rows.stop - b.rows.start), max(w, b.columns.stop - b.columns.start)
    made = {(left, top): thresholds(h, w, left, top, o, dpi) for (left, top), (h, w) in most.items()}
    for b in boxes:
        out[b.rows, b.columns] = made[b.left, b.top][: b.rows.stop - b.rows.start, : b.columns.stop - b.columns.start]
    return out


# ---- neighbourhoods


def shifted(x: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """out[y, x] = x[y + dy, x + dx], `fill` outside."""
    h, w = x.shape[:2]
    out = np.full_like(x, fill)
    if abs(dy) < h and abs(dx) < w:
        ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
        out[ys, xs] = x[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def edge_protected(rgba: np.ndarray, value: np.ndarray, radius: int, contrast: float, inside: np.ndarray) -> np.ndarray:
    """Opaque pixels near transparent or differently coloured ones. inside: which pixels of the array are of the image."""
    c, a = rgba[..., :3].astype(np.float64), rgba[..., 3]
    found = np.zeros(a.shape, bool)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy or dx:
                there, na = shifted(inside, dy, dx, False), shifted(a, dy, dx)
                far = np.sqrt(((c - shifted(c, dy, dx)) ** 2).sum(axis=-1)) >= contrast
                found |= there & ((na < 128) | ((na >= 250) & far))
    return found & (a >= 250) & (value > 0) & inside


def defringed(rgba: np.ndarray, value: np.ndarray, radius: int, strength: float, inside: np.ndarray) -> np.ndarray:
    """Source colours, moved towards the nearest solid one beside an edge. Distances tie in scan order."""
    c, a = rgba[..., :3].astype(np.float64), rgba[..., 3]
    v = np.where(a > 0, value, 0.0)
    boundary, has, best = np.zeros(a.shape, bool), np.zeros(a.shape, bool), c.copy()
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx]
    for dy, dx in sorted(steps, key=lambda s: s[0] ** 2 + s[1] ** 2):  # stable: scan order among equals
        there, nv = shifted(inside, dy, dx, False), shifted(v, dy, dx)
        boundary |= there & (nv < 0.01)
        new = there & (shifted(a, dy, dx) >= 250) & (nv >= 0.995) & ~has
        best[new] = shifted(c, dy, dx)[new]
        has |= new
    move = boundary & has & (value < 0.995)
    return np.where(move[..., None], rnd(c + (best - c) * strength / 100.0), c)


def boosted(c: np.ndarray, shadow: float, color: float) -> np.ndarray:
    luma = (0.2126 * c[..., 0] + 0.7152 * c[..., 1] + 0.0722 * c[..., 2]) / 255.0
    x = c + (255.0 - c) * (shadow / 100.0 * (1.0 - luma) ** 2)[..., None]
    mean = ((x[..., 0] + x[..., 1] + x[..., 2]) / 3.0)[..., None]
    return rnd(np.minimum(255.0, np.maximum(0.0, mean + (x - mean) * (1.0 + color / 100.0))))


# ---- components


class Runs(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray


def unions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's set, for n members of which each a and b are in one set. Each takes the smallest that it meets, with path halving, until nothing changes."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def components(mask: np.ndarray, diagonal: bool) -> Runs:
    """Horizontal runs of a mask, labelled by connected component: runs of neighbouring rows that touch are joined."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    n, wide, reach = len(row), w + 3, int(diagonal)
    # runs of the next row that end after this one's start and start before its end
    lo = np.searchsorted(row * wide + end, (row + 1) * wide + start - reach, side="right")
    hi = np.searchsorted(row * wide + start, (row + 1) * wide + end + reach, side="left")
    count = np.maximum(0, hi - lo)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if n else np.zeros(0, np.int64)
    label = unions(n, a, b)
    return Runs(row, start, end, label)


def paint(runs: Runs, chosen: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A mask of the chosen runs."""
    change = np.zeros((shape[0], shape[1] + 1), np.int8)
    np.add.at(change, (runs.row[chosen], runs.start[chosen]), 1)
    np.add.at(change, (runs.row[chosen], runs.end[chosen]), -1)
    return np.cumsum(change, axis=1, dtype=np.int8)[:, :-1] > 0


def first_pixels(runs: Runs, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each component's first pixel in scan order: its label is that of its first run."""
    return runs.row[labels], runs.start[labels]


def remove_particles(mask: np.ndarray, least: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pixels to remove, places (y, x) of the first pixels of the components that go): 8-connected islands of fewer than `least` pixels without a pixel in keep."""
    runs = components(mask, True)
    if least <= 1 or not len(runs.row):
        return np.zeros(mask.shape, bool), np.zeros((0, 2), np.int64)
    area = np.bincount(runs.label, runs.end - runs.start, len(runs.row))
    kept = np.cumsum(np.pad(keep & mask, ((0, 0), (1, 0))), axis=1)
    held = np.bincount(runs.label, kept[runs.row, runs.end] - kept[runs.row, runs.start], len(runs.row)) > 0
    bad = (area < least) & ~held
    gone = np.unique(runs.label[bad[runs.label]])
    return paint(runs, bad[runs.label], mask.shape), np.stack(first_pixels(runs, gone), axis=1)


def fill_holes(mask: np.ndarray, candidate: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pixels to fill, first pixels of the filled components): 4-connected empty pores of fewer than `least` pixels, all of them candidates."""
    runs = components(~mask, False)
    if least <= 1 or not len(runs.row):
        return np.zeros(mask.shape, bool), np.zeros((0, 2), np.int64)
    area = np.bincount(runs.label, runs.end - runs.start, len(runs.row))
    never = np.cumsum(np.pad(~candidate, ((0, 0), (1, 0))), axis=1)
    barred = np.bincount(runs.label, never[runs.row, runs.end] - never[runs.row, runs.start], len(runs.row)) > 0
    good = (area < least) & ~barred
    done = np.unique(runs.label[good[runs.label]])
    return paint(runs, good[runs.label], mask.shape), np.stack(first_pixels(runs, done), axis=1)


# ---- morphology


def box_sum(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1) squares, edge pixels repeated."""
    p = np.pad(x.astype(np.int64), r, mode="edge").cumsum(0).cumsum(1)
    p = np.pad(p, ((1, 0), (1, 0)))
    k = 2 * r + 1
    return p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]


def disc(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-math.isqrt(radius * radius - dy * dy), math.isqrt(radius * radius - dy * dy) + 1)]


def opened(mask: np.ndarray, inside: np.ndarray, radius: int, blur: int, keep: np.ndarray) -> np.ndarray:
    """The mask without what an opening takes away: box-blurred at one half, eroded and dilated by a disc, and cut with the mask. Outside the image counts as
    set for erosion and as unset for dilation; for the blur, edge pixels repeat. inside must be a rectangle."""
    ys, xs = np.flatnonzero(inside.any(1)), np.flatnonzero(inside.any(0))
    box = np.s_[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    m = mask[box]
    shape = m
    if blur:
        shape = 2 * box_sum(m, blur) >= (2 * blur + 1) ** 2
    eroded = np.logical_and.reduce([shifted(shape, dy, dx, True) for dy, dx in disc(radius)])
    out = np.zeros_like(mask)
    out[box] = np.logical_or.reduce([shifted(eroded, dy, dx, False) for dy, dx in disc(radius)])
    return mask & (out | keep)


# ---- smoothing


def gaussian(cov: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """16-bit coverage blurred over 11 pixels, transparent ones left out; 32-bit sums in a fixed order."""
    k = np.exp(-(np.arange(-5, 6) ** 2) / (2 * 1.4 * 1.4)).astype(np.float32).astype(np.float64)
    on = (alpha > 0).astype(np.float64)
    num, den = np.zeros(cov.shape), np.zeros(cov.shape)
    c = np.where(alpha > 0, cov, 0).astype(np.float64)
    for i, w in zip(range(-5, 6), k, strict=True):
        num, den = num + w * shifted(c, 0, i), den + w * shifted(on, 0, i)
    num, den = num.astype(np.float32).astype(np.float64), den.astype(np.float32).astype(np.float64)
    n2, d2 = np.zeros(cov.shape), np.zeros(cov.shape)
    for i, w in zip(range(-5, 6), k, strict=True):
        n2, d2 = n2 + w * shifted(num, i, 0), d2 + w * shifted(den, i, 0)
    out = np.clip(rnd(np.divide(n2, d2, out=np.zeros_like(n2), where=d2 > 0)), 0, 65535)
    return np.where(alpha > 0, out, 0)


def _window(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(-5, 6):
        out = out + shifted(x, 0, i)
    tall = np.zeros_like(x)
    for i in range(-5, 6):
        tall = tall + shifted(out, i, 0)
    return tall


def guided(cov: np.ndarray, alpha: np.ndarray, left: int, top: int, o: dict) -> np.ndarray:
    """A guided filter by the plane itself, on blocks of 4 x 4 pixels of the document; straight lines between blocks."""
    h, w = cov.shape
    x0, y0 = left + int(o["origin_x"]), top + int(o["origin_y"])
    bx, by = (np.arange(w) + x0) // 4, (np.arange(h) + y0) // 4
    base_x, base_y, nx, ny = bx[0], by[0], bx[-1] - bx[0] + 1, by[-1] - by[0] + 1
    cell = ((by - base_y)[:, None] * nx + (bx - base_x)[None, :]).ravel()
    on, value = (alpha > 0).ravel(), cov.astype(np.float64).ravel() / 65535.0
    count = np.bincount(cell, on.astype(np.float64), nx * ny).reshape(ny, nx)
    total = np.bincount(cell, np.where(on, value, 0.0), nx * ny).reshape(ny, nx)
    mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
    n, s, q = _window(count), _window(total), _window(total * mean)
    m = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    var = np.maximum(0.0, np.divide(q, n, out=np.zeros_like(q), where=n > 0) - m * m)
    a = var / (var + (24.0 / 255.0) ** 2)
    b = m - a * m
    sa, sb = (np.divide(_window(z * count), n, out=np.zeros_like(n), where=n > 0).astype(np.float32).astype(np.float64) for z in (a, b))

    def axis(size: int, start: int, base: int, blocks: int):
        c = (np.arange(size) + start + 0.5) / 4.0 - 0.5 - base
        low = np.floor(c).astype(np.int64)
        return np.clip(low, 0, blocks - 1), np.clip(low + 1, 0, blocks - 1), np.where(low < 0, 0.0, np.minimum(1.0, c - low))

    (xl, xh, tx), (yl, yh, ty) = axis(w, x0, base_x, nx), axis(h, y0, base_y, ny)
    ty = ty[:, None]

    def between(z: np.ndarray) -> np.ndarray:
        up = z[yl][:, xl] + (z[yl][:, xh] - z[yl][:, xl]) * tx
        down = z[yh][:, xl] + (z[yh][:, xh] - z[yh][:, xl]) * tx
        return up + (down - up) * ty

    out = np.clip(rnd((between(sa) * cov / 65535.0 + between(sb)) * 65535.0), 0, 65535)
    return np.where(alpha > 0, out, 0)


# ---- white layer


def chebyshev(mask: np.ndarray, cap: int = 127, outside_empty: np.ndarray | None = None) -> np.ndarray:
    """Distance of set pixels to the nearest empty one in steps of a king, `cap` at most. What is beyond the array isn't empty; pixels in outside_empty (outside the image)
    aren't either. Two sweeps, from each end: a row takes what its neighbour row says, then what its own pixels say along it."""
    solid = mask if outside_empty is None else mask | outside_empty
    d = np.where(solid, np.int32(cap), np.int32(0))
    ramp = np.arange(d.shape[1], dtype=np.int32)
    for rows in (d, d[::-1, ::-1]):
        before = None
        for row in rows:
            if before is not None:
                near = before.copy()
                np.minimum(near[1:], before[:-1], out=near[1:])
                np.minimum(near[:-1], before[1:], out=near[:-1])
                np.minimum(row, near + 1, out=row)
            np.minimum(row, np.minimum.accumulate(row - ramp) + ramp, out=row)
            before = row
    d[~mask] = 0
    return d.astype(np.int16)


def ridges(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the highest distance that strictly rising steps reach from each pixel, whether any neighbour is higher). Pixels are taken once, from the highest distance down, so those above are known."""
    wide = np.pad(d, 1)
    flat, top, higher = wide.ravel(), wide.ravel().copy(), np.zeros(wide.size, bool)
    on = np.flatnonzero(flat)
    on = on[np.argsort(-flat[on], kind="stable")]
    ends = np.flatnonzero(np.diff(flat[on])) + 1
    steps = [dy * wide.shape[1] + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    for own in np.split(on, ends):
        level, best, up = flat[own], top[own], np.zeros(len(own), bool)
        for s in steps:
            over = flat[own + s] > level
            up |= over
            best = np.where(over, np.maximum(best, top[own + s]), best)
        top[own], higher[own] = best, up
    inner = np.s_[1:-1, 1:-1]
    return top.reshape(wide.shape)[inner], higher.reshape(wide.shape)[inner]


def white_mask(mask: np.ndarray, choke: int, outside: np.ndarray | None = None) -> np.ndarray:
    """The under-layer: the mask drawn in by `choke` pixels, less in thin parts: by 35 % of their half thickness at most; ridges stay."""
    if choke <= 0:
        return mask.copy()
    d = chebyshev(mask, white_reach(choke), outside)
    top, higher = ridges(d)
    return mask & ((d > np.minimum(choke, np.floor(0.35 * top))) | ~higher)


def white_reach(choke: int) -> int:
    """The smallest distance t at which 35 % gives the whole choke (44 at most): distances beyond t make no difference, and a halo of 2 t is enough."""
    want, t = min(choke, 44), 1
    while math.floor(0.35 * t) < want and t < 127:
        t += 1
    return t


# ---- the whole chain


class Prepared(NamedTuple):
    source: np.ndarray
    screened: np.ndarray
    opened: np.ndarray
    protected: np.ndarray
    candidate: np.ndarray
    solid: np.ndarray


class Result(NamedTuple):
    rgba: np.ndarray
    screened: np.ndarray
    removed: np.ndarray
    protected: np.ndarray
    solid: np.ndarray
    filled: np.ndarray
    particles: np.ndarray
    pores: np.ndarray


def areas(o: dict, dpi: float = 300.0) -> tuple[int, int]:
    """Smallest area of an island and of a pore, in pixels."""
    size = lambda mm: max(1, math.ceil(math.pi * (mm / 25.4 * dpi / 2) ** 2))
    return size(o["min_diameter_mm"]), size(o["fill_holes_mm"])


def opening_of(o: dict) -> tuple[int, int] | None:
    """(radius, blur), None without cleanup."""
    if o["cleanup"] == "none":
        return None
    feather = 0.0 if o["cleanup"] == "low" else math.floor(((1.0 if o["lpi"] >= 40 else 1 + 0.1 * (40 - o["lpi"])) + (0.5 if o["cleanup"] == "high" else 0.0)) * 100 + 0.5) / 100
    return (2 if o["cleanup"] == "high" else 1), (max(1, math.floor(feather / 2 + 0.5)) if feather else 0)


def halo(o: dict, dpi: float = 300.0) -> int:
    least, pores = areas(o, dpi)
    opening = opening_of(o) if o["cleanup_mode"] == "opening" else None
    clean = (opening[1] + 2 * opening[0] if opening else 0) if o["cleanup_mode"] == "opening" else least - 1
    near = max(o["edge_radius"] if o["protection"] == "edges" else 0, o["defringe_radius"] if o["defringe"] else 0)
    return clean + (pores - 1 if pores > 1 else 0) + near + {0: 0, 1: 5, 2: 57}[o["presmooth"]]


def reach(o: dict) -> int:
    """How far the steps of prepare() and process() look that take rasters side by side in one call; the others take them box by box."""
    return max(1, o["edge_radius"] if o["protection"] == "edges" else 0, o["defringe_radius"] if o["defringe"] else 0, 5 if o["presmooth"] else 0)


def _image_box(inside: np.ndarray, left: int, top: int) -> list[Box]:
    """The rectangle of an array that is of the image."""
    ys, xs = np.flatnonzero(inside.any(1)), np.flatnonzero(inside.any(0))
    return [Box(slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1), left + int(xs[0]), top + int(ys[0]))] if len(ys) else []


def prepare(rgba: np.ndarray, o: dict, left: int = 0, top: int = 0, inside: np.ndarray | None = None, selection: np.ndarray | None = None, dpi: float = 300.0, boxes: list[Box] | None = None) -> Prepared:
    """Screens one raster: all that doesn't ask how far a component goes. source: the colour that ink has at each pixel; opened: the screen after an opening, or as it is; candidate: where a pore may be filled. boxes: the array holds several rasters,
    reach() apart, and inside is what lies in a box."""
    h, w = rgba.shape[:2]
    if inside is None or inside.all():
        inside = np.ones((h, w), bool)
    else:
        rgba = np.where(inside[..., None], rgba, 0).astype(np.uint8)
    a = rgba[..., 3]
    plain, m = coverage(rgba, o)
    raw = plain
    if o["presmooth"]:
        plane = np.where(plain <= 0, 0, np.clip(rnd(plain * 65535.0), 1, 65535))
        plane = gaussian(plane, a)
        if o["presmooth"] == 2:  # blocks are the image's: what is beyond it has none
            for b in boxes if boxes is not None else _image_box(inside, left, top):
                plane[b.rows, b.columns] = guided(plane[b.rows, b.columns], a[b.rows, b.columns], b.left, b.top, o)
        raw = np.where(a > 0, plane / 65535.0, 0.0)
    value = levels(raw, o)
    solid = (plain >= 0.5) & (a > 0)
    floor = {"none": 0.0, "low": 0.01, "standard": 0.03, "high": 0.06}[o["cleanup"]]
    protected = np.zeros((h, w), bool)
    if o["protection"] == "selection" and selection is not None:
        protected = (selection >= 128) & (a >= 128)
    elif o["protection"] == "edges":
        protected = edge_protected(rgba, levels(plain, o) if o["presmooth"] else value, o["edge_radius"], o["edge_contrast"], inside)
    candidate = (a > 0) & (value >= floor) & (value > 0) & ~protected
    if o["halftone"]:
        dots = (value >= 1) | (value > (thresholds(h, w, left, top, o, dpi) if boxes is None else thresholds_of(boxes, (h, w), o, dpi)))
    else:
        dots = value * 255.0 >= o["alpha_threshold"]
    screened = protected | (candidate & dots)
    opening = opening_of(o) if o["cleanup_mode"] == "opening" else None
    ink = opened(screened, inside, *opening, protected) if opening and boxes is None else screened
    if opening and boxes is not None:
        ink = screened.copy()
        for b in boxes:
            at = b.rows, b.columns
            ink[at] = opened(screened[at], inside[at], *opening, protected[at])
    if not (o["defringe"] or m is not None or o["shadow_boost"] or o["color_boost"]):  # colours as they are
        return Prepared(rgba[..., :3], screened, ink, protected, candidate, solid)
    color = rgba[..., :3].astype(np.float64)
    key = np.array([o["key_r"], o["key_g"], o["key_b"]], np.float64)
    source = defringed(rgba, levels(plain, o) if o["presmooth"] else value, o["defringe_radius"], o["defringe_strength"], inside) if o["defringe"] else color
    if m is not None:
        with np.errstate(divide="ignore", invalid="ignore"):
            found = rnd(np.clip((color - (1.0 - m[..., None]) * key) / m[..., None], 0.0, 255.0))
        source = np.where((m > 0)[..., None], found, source)
    if o["shadow_boost"] or o["color_boost"]:
        source = boosted(source, o["shadow_boost"], o["color_boost"])
    return Prepared(np.where(protected[..., None], color, source), screened, ink, protected, candidate, solid)


def printed(source: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """RGBA: the colours where ink is, opaque."""
    out = np.zeros((*ink.shape, 4), np.uint8)
    out[..., 3] = np.where(ink, 255, 0)
    out[..., :3] = np.where(ink[..., None], source, 0)
    return out


def process(rgba: np.ndarray, o: dict, left: int = 0, top: int = 0, inside: np.ndarray | None = None, selection: np.ndarray | None = None, dpi: float = 300.0, boxes: list[Box] | None = None) -> Result:
    """Screens and cleans one raster. inside: pixels of the image (the rest of a tile's surroundings has none); selection: soft mask, 0 to 255; boxes: as for prepare()."""
    p = prepare(rgba, o, left, top, inside, selection, dpi, boxes)
    least, pores = areas(o, dpi)
    ink, particles = p.opened, np.zeros((0, 2), np.int64)
    if o["cleanup_mode"] != "opening":
        gone, particles = remove_particles(p.screened, least, p.protected)
        ink = p.screened & ~gone
    filled, holes = fill_holes(ink if inside is None else ink | ~inside, p.candidate, pores)  # beyond the image nothing is empty
    ink = ink | filled
    return Result(printed(p.source, ink), p.screened, (p.screened | filled) & ~ink, p.protected, p.solid, filled, particles, holes)


# ---- previews


def checker(h: int, w: int, left: int, top: int) -> np.ndarray:
    """The checker board of an image, (h, w, 1)."""
    cell = (np.arange(w) + left)[None, :] // 12 + ((np.arange(h) + top) // 12)[:, None]
    return np.where(cell % 2 == 0, 190, 230)[..., None]


def composite(rgba: np.ndarray, background) -> np.ndarray:
    """Opaque pixels: rgba over a colour or a raster of colours."""
    a = (np.arange(256) / 255.0)[rgba[..., 3]][..., None]
    out = np.full(rgba.shape, 255, np.uint8)
    out[..., :3] = rnd(rgba[..., :3] * a + np.asarray(background) * (1.0 - a))
    return out


def _body(chest_cm: float, height_cm: float) -> tuple[float, float, float, float]:
    """Scale, left, width and height of the garment on a canvas of 420 x 540; it starts at y = 30."""
    scale = min(260 / chest_cm, 450 / height_cm)
    return scale, (420 - chest_cm * scale) / 2, chest_cm * scale, height_cm * scale


@functools.lru_cache(100)
def _inside(chest_cm: float, height_cm: float) -> np.ndarray:
    _, left, body_w, body_h = _body(chest_cm, height_cm)
    x, y = np.arange(420)[None, :], np.arange(540)[:, None]
    sleeve = np.where(y < 30 + body_h * 0.24, body_w * 0.25 * (1.0 - (y - 30) / (body_h * 0.24)), 0.0)
    return (y >= 30) & (y <= 30 + body_h) & (x >= left - sleeve) & (x <= left + body_w + sleeve)


def garment(key: tuple[int, int, int], chest_cm: float, height_cm: float) -> tuple[np.ndarray, np.ndarray]:
    """(canvas, which pixels are garment)."""
    inside = _inside(chest_cm, height_cm)
    canvas = np.full((540, 420, 4), 255, np.uint8)
    canvas[..., :3] = np.where(inside[..., None], np.array(key, np.uint8), np.array((24, 27, 26), np.uint8))
    return canvas, inside


def mockup_places(w: int, h: int, width_cm: float, height_cm: float, chest_cm: float, garment_cm: float, at_x: float, at_y: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(left, top, source columns, source rows) of the box that art covers on the canvas."""
    scale, left, body_w, body_h = _body(chest_cm, garment_cm)
    aw, ah = width_cm * scale, height_cm * scale
    x0, y0 = left + body_w * (at_x / 100) - aw / 2.0, 30 + body_h * at_y / 100 - 0.0
    axis = lambda start, size, n: np.clip(np.floor((np.arange(math.floor(start), math.ceil(start + size)) - start) / size * n), 0, n - 1).astype(np.int64)
    return math.floor(x0), math.floor(y0), axis(x0, aw, w), axis(y0, ah, h)


def resample_axis(start: int, n: int, source: int, target: int) -> tuple[np.ndarray, int]:
    """(weights (n, source positions), first source position) of a run of output positions along one axis."""
    scale = source / target
    p = np.arange(start, start + n)
    if scale > 1:
        lo, hi = p * scale, np.minimum(source, (p + 1) * scale)
        first, last = int(math.floor(lo[0])), int(math.ceil(hi[-1]))
        at = np.arange(first, last)
        return np.maximum(0.0, (np.minimum(hi[:, None], at + 1) - np.maximum(lo[:, None], at)) / scale), first
    f = np.maximum(0.0, np.minimum(source - 1, (p + 0.5) * scale - 0.5))
    low = np.floor(f).astype(np.int64)
    first, last = int(low[0]), int(min(source - 1, low[-1] + 1)) + 1
    out = np.zeros((n, last - first))
    np.add.at(out, (np.arange(n), low - first), 1.0 - (f - low))
    np.add.at(out, (np.arange(n), np.minimum(source - 1, low + 1) - first), f - low)
    return out, first
