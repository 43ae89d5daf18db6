"""Islands and pores of any size on tiles: each tile labels its own pixels, and only what lies along the seams is joined between tiles.

A component that touches no seam is decided where it is. Of the others a tile sends its seam pixels' labels and what it knows of these labels (area, whether anything holds them, first
pixel); an image's seams are joined in one group, a few bytes for each seam pixel, and each tile gets back the labels that go. So what is shuffled doesn't depend on how large
the areas are, and nothing around a tile is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkgrid.operators import kernels
from inkgrid.operators.tiles import KEY, batch_of, batches_of, rows_of
from inkgrid.schema import TILES
from inkgrid.sources.workspace import forget, keep

#: Bits of the fourth byte of a pixel of a prepared tile, whose first three are the colour that ink has there.
SCREENED, PROTECTED, CANDIDATE, SOLID, INK, FILLED = 1, 2, 4, 8, 16, 32
#: Tiles with the smallest areas of an island and of a pore that stay (islands: 1 where they aren't asked for), and the components that have gone so far.
PREPARED = f"{TILES}, image_width int, image_height int, least long, pores long, removed_components long"
SEAMS = "image_id long, tile_y int, tile_x int, width int, height int, least long, edges binary, ids binary, area binary, held binary, first binary"
DECIDED = "image_id long, tile_y int, tile_x int, gone binary, mine long"
_NAMES = [c.split()[0] for c in PREPARED.split(", ")]


def flags(p: kernels.Prepared) -> np.ndarray:
    return (p.screened * SCREENED | p.protected * PROTECTED | p.candidate * CANDIDATE | p.solid * SOLID | p.opened * INK).astype(np.uint8)


class Labels:
    """The components of a tile's mask, numbered in the order of their first pixels."""

    def __init__(self, mask: np.ndarray, diagonal: bool, hold: np.ndarray, left: int, top: int):
        runs = kernels.components(mask, diagonal)
        own, self.of_run = np.unique(runs.label, return_inverse=True)
        self.runs, self.shape, n = runs, mask.shape, len(own)
        size = runs.end - runs.start
        self.area = np.bincount(self.of_run, size, n).astype(np.int64)
        upto = np.cumsum(np.pad(hold & mask, ((0, 0), (1, 0))), axis=1)
        self.held = np.bincount(self.of_run, upto[runs.row, runs.end] - upto[runs.row, runs.start], n) > 0
        self.first = ((runs.row[own].astype(np.int64) + top) << 32) | (runs.start[own] + left)
        raster = np.full(mask.shape, -1, np.int32)
        raster[mask] = np.repeat(self.of_run, size)
        self.sides = [raster[0], raster[-1], raster[:, 0], raster[:, -1]]

    def on_seams(self, seam: tuple[bool, bool, bool, bool]) -> tuple[np.ndarray, np.ndarray]:
        """(labels along all four sides, -1 where a side is no seam; the labels that touch one)."""
        edges = np.concatenate([s if on else np.full_like(s, -1) for s, on in zip(self.sides, seam, strict=True)])
        found = np.unique(edges)
        return edges, found[found >= 0]


def _labels(t: SimpleNamespace, data: np.ndarray, pores: bool) -> tuple[Labels, np.ndarray, int]:
    """(labels, those on seams with their sides, smallest area that stays). Pores are joined along sides, and held by pixels that aren't to be filled."""
    f = data[..., 3]
    on = Labels((f & INK) == 0, False, (f & CANDIDATE) == 0, t.left, t.top) if pores else Labels((f & SCREENED) > 0, True, (f & PROTECTED) > 0, t.left, t.top)
    seam = (t.top > 0, t.top + t.height < t.image_height, t.left > 0, t.left + t.width < t.image_width)
    return on, *on.on_seams(seam), (t.pores if pores else t.least)


def seams(prepared: DataFrame, pores: bool) -> DataFrame:
    """SEAMS: a row for each tile that has components on a seam."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in rows_of(batches):
            if (t.pores if pores else t.least) <= 1:
                continue
            on, edges, ids, least = _labels(t, np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 4), pores)
            if len(ids):
                yield t.image_id, t.tile_y, t.tile_x, t.width, t.height, least, edges.astype("<i4").tobytes(), ids.astype("<i4").tobytes(), on.area[ids].astype("<i8").tobytes(), on.held[ids].tobytes(), on.first[ids].astype("<i8").tobytes()

    return prepared.select(*_NAMES).mapInArrow(lambda batches: batches_of(made(batches), SEAMS), SEAMS)


def join_seams(tiles: list[SimpleNamespace], diagonal: bool) -> list[tuple]:
    """DECIDED rows of an image's tiles: labels whose whole component goes, and how many of these components begin in the tile."""
    at, n = {}, 0
    for t in tiles:
        ids = np.frombuffer(t.ids, "<i4")
        edges = np.frombuffer(t.edges, "<i4")
        number = np.full(ids[-1] + 2, -1)  # the last for -1
        number[ids] = np.arange(n, n + len(ids))
        edges = number[edges]
        w, h = t.width, t.height
        at[t.tile_y, t.tile_x] = SimpleNamespace(ids=ids, start=n, top=edges[:w], bottom=edges[w : 2 * w], left=edges[2 * w : 2 * w + h], right=edges[2 * w + h :])
        n += len(ids)
    pairs = []

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        both = (a >= 0) & (b >= 0)
        pairs.append((a[both], b[both]))

    for (y, x), t in at.items():
        for other, mine, its in (((y, x + 1), "right", "left"), ((y + 1, x), "bottom", "top")):
            if (o := at.get(other)) is not None:
                a, b = getattr(t, mine), getattr(o, its)
                meet(a, b)
                if diagonal:
                    meet(a[1:], b[:-1])
                    meet(a[:-1], b[1:])
        if diagonal:
            for other, mine, its in (((y + 1, x + 1), t.bottom[-1:], "top"), ((y + 1, x - 1), t.bottom[:1], "top")):
                if (o := at.get(other)) is not None:
                    meet(mine, getattr(o, its)[:1] if other[1] > x else getattr(o, its)[-1:])
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    label = kernels.unions(n, a, b)
    all_of = lambda name, kind: np.concatenate([np.frombuffer(getattr(t, name), kind) for t in tiles])
    first = np.full(n, np.iinfo(np.int64).max)
    own = all_of("first", "<i8")
    np.minimum.at(first, label, own)
    gone = (np.bincount(label, all_of("area", "<i8"), n) < tiles[0].least) & ~(np.bincount(label, all_of("held", bool), n) > 0)
    gone = gone[label]
    begins = gone & (first[label] == own)
    out = []
    for t in tiles:
        part = at[t.tile_y, t.tile_x]
        here = slice(part.start, part.start + len(part.ids))
        if gone[here].any():
            out.append((t.image_id, t.tile_y, t.tile_x, part.ids[gone[here]].astype("<i4").tobytes(), int(begins[here].sum())))
    return out


def decided(found: DataFrame, pores: bool) -> DataFrame:
    """DECIDED: tiles of which something on a seam goes. An image's seams are one group: at most a few bytes for each of its seam pixels."""

    def run(f):
        return pa.Table.from_batches([batch_of(join_seams(list(rows_of(f.to_batches())), not pores), DECIDED)])

    return found.groupBy("image_id").applyInArrow(run, DECIDED)


def apply(t: SimpleNamespace, pores: bool) -> tuple[np.ndarray, int]:
    """(data, components that went and begin here) of a row with its decisions."""
    data = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 4).copy()
    on, _, ids, least = _labels(t, data, pores)
    if least <= 1:
        return data, 0
    bad = (on.area < least) & ~on.held
    bad[ids] = False
    n = int(bad.sum())
    if t.gone is not None:
        bad[np.frombuffer(t.gone, "<i4")] = True
        n += t.mine
    where = kernels.paint(on.runs, bad[on.of_run], on.shape)
    if pores:
        data[where, 3] |= INK | FILLED
    else:
        data[..., 3] = np.where(where, data[..., 3] & ~np.uint8(INK), data[..., 3])
    return data, n


def without_islands(prepared: DataFrame, decisions: DataFrame) -> DataFrame:
    """PREPARED, its islands decided."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in rows_of(batches):
            data, n = apply(t, False)
            yield t.image_id, t.tile_x, t.tile_y, t.left, t.top, t.width, t.height, 4, data.tobytes(), t.image_width, t.image_height, t.least, t.pores, n

    return prepared.join(decisions, KEY, "left").select(*_NAMES, "gone", "mine").mapInArrow(lambda batches: batches_of(made(batches), PREPARED), PREPARED)


def finished(cleaned: DataFrame, decisions: DataFrame, schema: str, pixels: bool) -> DataFrame:
    """Output tiles with their counts, pores decided."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in rows_of(batches):
            data, n = apply(t, True)
            f = data[..., 3]
            ink = (f & INK) > 0
            is_ = lambda bit, f=f: (f & bit) > 0
            counts = [ink, is_(SCREENED), (is_(SCREENED) | is_(FILLED)) & ~ink, is_(PROTECTED), is_(SOLID), is_(FILLED)]
            out = kernels.printed(data[..., :3], ink).tobytes() if pixels else b""
            yield t.image_id, t.tile_x, t.tile_y, t.left, t.top, t.width, t.height, 4, out, *(int(np.count_nonzero(c)) for c in counts), t.removed_components, n

    return cleaned.join(decisions, KEY, "left").select(*_NAMES, "gone", "mine").mapInArrow(lambda batches: batches_of(made(batches), schema), schema)


def cleaned_tiles(prepared: DataFrame, schema: str, pixels: bool) -> DataFrame:
    """Output tiles of prepared ones. Tables between steps are written; those of decisions then have a known size, so that Spark sends small ones and shuffles large ones. Two stay, for the result to read."""
    prepared = keep(prepared, "tiles-prepared")
    islands = keep(decided(seams(prepared, False), False), "seams-islands")
    cleaned = keep(without_islands(prepared, islands), "tiles-cleaned")
    forget(prepared, islands)
    return finished(cleaned, keep(decided(seams(cleaned, True), True), "seams-pores"), schema, pixels)
