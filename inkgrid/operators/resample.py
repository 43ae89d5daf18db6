"""Resampling of tiles: area averages where art shrinks, straight lines where it grows, colours weighted by opacity."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.sizing import source_window
from inkgrid.operators.kernels import resample_axis, rnd
from inkgrid.operators.tiles import CORE, batches_of, grouped, rows_of, side_of
from inkgrid.schema import TILES

PART = "variant_id long, tile_y int, tile_x int, w int, h int, width int, height int, out_width int, out_height int, x0 int, y0 int, pw int, ph int, raw boolean, data binary"


@functools.lru_cache(4096)
def _axis(start: int, n: int, source: int, target: int) -> tuple[np.ndarray, int]:
    return resample_axis(start, n, source, target)


def resample_tiles(tiles: DataFrame, jobs: DataFrame, core: int = CORE, side: int | None = None, counts: bool = False) -> DataFrame:
    """jobs: (variant_id, image_id, width, height, out_width, out_height), and perhaps from_x, from_y: where a frame of that size starts in the image (0, 0 without). Output tiles of
    each job, as TILES with variant_id for image_id; with a recipe_id in jobs, this too. counts: adds covered, the number of a tile's pixels that anything of the art falls on; some of them are so thin that their opacity is rounded to 0.

    Work is done in blocks of the output (side_of(core) pixels). Each names the source tiles that it can need; an equi-join brings these, and what is sent on to the block is the smaller of two: the pixels that it needs of a tile, or
    the tile's part of its sums, by two small matrix products. Nothing is rounded before the sums meet, so the cut into tiles makes no difference.
    """
    side = side or side_of(core)
    cells = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / side).cast("int") - 1)
    more = ["recipe_id"] if "recipe_id" in jobs.columns else []
    jobs = jobs.withColumns({c: F.col(c) if c in jobs.columns else F.lit(0) for c in ("from_x", "from_y")})
    out = jobs.withColumn("ty", F.explode(cells("out_height"))).withColumn("tx", F.explode(cells("out_width")))
    out = out.withColumn("w", F.least(F.lit(side), F.col("out_width") - F.col("tx") * side).cast("int")).withColumn("h", F.least(F.lit(side), F.col("out_height") - F.col("ty") * side).cast("int"))
    needs = lambda t, n, o, s: source_window(F.col(t) * side, F.col(n), F.col(s) / F.col(o), F.col(s))
    wx, wy = needs("tx", "w", "out_width", "width"), needs("ty", "h", "out_height", "height")
    span = lambda win, start: F.sequence(F.floor((win["lo"] + F.col(start)) / core), F.floor((win["hi"] - 1 + F.col(start)) / core))
    out = out.withColumn("tile_x", F.explode(span(wx, "from_x"))).withColumn("tile_y", F.explode(span(wy, "from_y"))).withColumns({"tile_x": F.col("tile_x").cast("int"), "tile_y": F.col("tile_y").cast("int")})
    source = tiles.select("image_id", "tile_x", "tile_y", "left", "top", F.col("width").alias("sw"), F.col("height").alias("sh"), "data")
    joined = out.join(source.hint("merge"), ["image_id", "tile_x", "tile_y"]).select("variant_id", "ty", "tx", "w", "h", "width", "height", "out_width", "out_height", (F.col("left") - F.col("from_x")).alias("left"), (F.col("top") - F.col("from_y")).alias("top"), "sw", "sh", "data", *more)
    part_schema = ", ".join([PART, *(f"{c} long" for c in more)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in rows_of(batches):
            ax, x0 = _axis(t.tx * side, t.w, t.width, t.out_width)
            ay, y0 = _axis(t.ty * side, t.h, t.height, t.out_height)
            u0, u1, v0, v1 = max(0, t.left - x0), min(ax.shape[1], t.left + t.sw - x0), max(0, t.top - y0), min(ay.shape[1], t.top + t.sh - y0)
            if u0 >= u1 or v0 >= v1:
                continue
            own = [getattr(t, c) for c in more]
            d = np.frombuffer(t.data, np.uint8).reshape(t.sh, t.sw, 4)[v0 + y0 - t.top : v1 + y0 - t.top, u0 + x0 - t.left : u1 + x0 - t.left]
            head = (t.variant_id, t.ty, t.tx, t.w, t.h, t.width, t.height, t.out_width, t.out_height)
            if ax.shape[1] * ay.shape[1] <= 8 * t.w * t.h:  # four bytes for each pixel of the source against 32 for each of the block
                yield *head, u0, v0, u1 - u0, v1 - v0, True, d.tobytes(), *own
                continue
            cols, rws = np.flatnonzero(ax[:, u0:u1].any(1)), np.flatnonzero(ay[:, v0:v1].any(1))
            if not len(cols) or not len(rws):
                continue
            cx, cy = slice(cols[0], cols[-1] + 1), slice(rws[0], rws[-1] + 1)
            planes = _planes(d, ax[cx, u0:u1], ay[cy, v0:v1])
            yield *head, int(cols[0]), int(rws[0]), planes.shape[1], planes.shape[0], False, np.ascontiguousarray(planes).tobytes(), *own

    def join_parts(parts: list[SimpleNamespace]) -> list[tuple]:
        r = parts[0]
        s = np.zeros((r.h, r.w, 4))
        if raw := [p for p in parts if p.raw]:
            ax, ay = _axis(r.tile_x * side, r.w, r.width, r.out_width)[0], _axis(r.tile_y * side, r.h, r.height, r.out_height)[0]
            d = np.zeros((ay.shape[1], ax.shape[1], 4), np.uint8)
            for p in raw:
                d[p.y0 : p.y0 + p.ph, p.x0 : p.x0 + p.pw] = np.frombuffer(p.data, np.uint8).reshape(p.ph, p.pw, 4)
            s = _planes(d, ax, ay)
        for p in sorted((p for p in parts if not p.raw), key=lambda p: (p.y0, p.x0, p.ph, p.pw)):
            s[p.y0 : p.y0 + p.ph, p.x0 : p.x0 + p.pw] += np.frombuffer(p.data, np.float64).reshape(p.ph, p.pw, 4)
        rgba = np.zeros(s.shape, np.uint8)
        on = s[..., 0] > 0
        rgba[..., :3][on] = rnd(np.round(s[on][:, 1:] / s[on][:, :1], 9))  # sums of parts: halves must not depend on their order
        rgba[..., 3][on] = np.minimum(255, rnd(np.round(s[..., 0][on] * 255.0, 9)))
        made = []
        for y in range(0, r.h, core):
            for x in range(0, r.w, core):
                cut, left, top = rgba[y : y + core, x : x + core], r.tile_x * side + x, r.tile_y * side + y
                covered = [int(on[y : y + core, x : x + core].sum())] if counts else []
                made.append((r.variant_id, left // core, top // core, left, top, cut.shape[1], cut.shape[0], 4, cut.tobytes(), *(getattr(r, c) for c in more), *covered))
        return made

    sized = ", ".join(["variant_id" + TILES[len("image_id") :], *(f"{c} long" for c in more), *(["covered long"] if counts else [])])
    parts = joined.mapInArrow(lambda batches: batches_of(part(batches), part_schema), part_schema)
    return grouped(parts, ["variant_id", "tile_y", "tile_x"], join_parts, sized)


def _planes(d: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """Sums of opacity and of the colours that it weighs, for output positions with these weights."""
    a = d[..., 3] / 255.0
    p = np.concatenate([a[None], d[..., :3].transpose(2, 0, 1) * a])
    return (ay @ (p @ ax.T)).transpose(1, 2, 0)


def thumbnails(tiles: DataFrame, artworks: DataFrame, most: int = 360, core: int = CORE) -> DataFrame:
    """Tiles of small copies whose longer side has `most` pixels; smaller art stays as it is."""
    k = F.least(F.lit(1.0), most / F.greatest("width", "height"))
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * k + 0.5)).cast("int")
    jobs = artworks.select(F.col("image_id").alias("variant_id"), "image_id", "width", "height", side("width").alias("out_width"), side("height").alias("out_height"))
    return resample_tiles(tiles, jobs, core).withColumnRenamed("variant_id", "image_id")
