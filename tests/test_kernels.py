import hashlib
import itertools

import numpy as np
import pytest

from inkgrid.operators import kernels as K
from rasters import BASE, FEATURES, filled, golden, golden_raster


@pytest.mark.parametrize(("shape", "feature", "counts", "sha"), list(golden()))
def test_golden(shape, feature, counts, sha):
    rgba, selection = golden_raster()
    r = K.process(rgba, filled(**BASE, shape=shape) | filled(**{**BASE, "shape": shape, **FEATURES[feature]}), selection=selection)
    got = (int(r.screened.sum()), int((r.rgba[..., 3] > 0).sum()), int(r.removed.sum()), len(r.particles), int(r.protected.sum()))
    assert got == counts and hashlib.sha256(r.rgba.tobytes()).hexdigest() == sha


def brute_components(mask, diagonal):
    h, w = mask.shape
    seen, out = np.zeros(mask.shape, bool), []
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y, x in itertools.product(range(h), range(w)):
        if mask[y, x] and not seen[y, x]:
            seen[y, x], stack, own = True, [(y, x)], []
            while stack:
                p = stack.pop()
                own.append(p)
                for dy, dx in steps:
                    q = p[0] + dy, p[1] + dx
                    if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and not seen[q]:
                        seen[q] = True
                        stack.append(q)
            out.append(own)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_particles_and_holes_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((23, 31)) < (0.3, 0.5, 0.6, 0.7, 0.4, 0.9)[seed]
    keep, candidate = rng.random(mask.shape) < 0.05, rng.random(mask.shape) < 0.95
    gone, first = K.remove_particles(mask, 6, keep)
    want = [c for c in brute_components(mask, True) if len(c) < 6 and not any(keep[p] for p in c)]
    assert set(map(tuple, np.argwhere(gone))) == {p for c in want for p in c} and sorted(map(tuple, first)) == sorted(min(c) for c in want)
    fill, first = K.fill_holes(mask, candidate, 6)
    want = [c for c in brute_components(~mask, False) if len(c) < 6 and all(candidate[p] for p in c)]
    assert set(map(tuple, np.argwhere(fill))) == {p for c in want for p in c} and len(first) == len(want)


def test_known_particles():
    mask = np.zeros((40, 40), bool)
    mask[2:22, 2:22] = True
    for i in range(10):
        mask[25 + i, 25 + i] = True
    mask[38, 2] = True
    gone, first = K.remove_particles(mask, 5, np.zeros_like(mask))
    assert gone.sum() == 1 and (mask & ~gone).sum() == 410 and len(first) == 1


def test_distance_against_brute_force():
    rng = np.random.default_rng(1)
    mask = rng.random((20, 25)) < 0.93
    empty = np.argwhere(~mask)
    want = np.array([[0 if not mask[y, x] else min(np.abs(empty - (y, x)).max(axis=1)) for x in range(25)] for y in range(20)])
    assert (K.chebyshev(mask) == want).all()
    assert (K.chebyshev(np.ones((5, 5), bool), 9) == 9).all()


def test_white():
    block = np.zeros((60, 60), bool)
    block[10:50, 10:50] = True
    assert K.white_mask(block, 3).sum() == 34 * 34
    for size, kept in ((7, 5), (11, 7), (22, 16)):
        dot = np.zeros((40, 40), bool)
        dot[5 : 5 + size, 5 : 5 + size] = True
        assert K.white_mask(dot, 120).sum() == kept**2


def test_levels_gain_and_line_trim():
    o = filled(input_black=20.0, input_midtone=2.0, input_white=220.0, output_black=30.0, output_white=230.0)
    v = K.levels(np.array([0, 10, 20, 120, 240]) / 255, o)
    assert v == pytest.approx([0, 30 / 255, 30 / 255, (30 + 0.5**0.5 * 200) / 255, 230 / 255])
    o = filled() | {"gain": [[10, 14], [30, 41], [50, 63], [70, 80], [90, 94]]}
    assert K.levels(np.array([0.41, 0.63, 1.0]), o) == pytest.approx([0.3, 0.5, 1.0])


@pytest.mark.parametrize("shape", ["round", "euclidean", "ellipse", "square", "diamond", "line"])
def test_printed_share_is_the_tone(shape):
    th = K.thresholds(320, 320, 0, 0, filled(shape=shape, lpi=20.0, angle=0.0), dpi=6400.0)  # one cell
    for tone in (0.1, 0.25, 0.5, 0.75, 0.9):
        assert abs((tone > th).mean() - tone) < 0.01


def test_opening_parameters():
    p = lambda lpi, level: K.opening_of(filled(lpi=lpi, cleanup=level))
    assert p(30.0, "standard") == (1, 1) and p(20.0, "high") == (2, 2) and p(40.0, "low") == (1, 0) and p(30.0, "none") is None


def test_resample_axis_and_sums():
    a, first = K.resample_axis(0, 64, 256, 64)
    assert first == 0 and a.sum(axis=1) == pytest.approx(np.ones(64)) and (a[0, :4] == 0.25).all()
    a, first = K.resample_axis(10, 5, 10, 25)
    assert a.sum(axis=1) == pytest.approx(np.ones(5))
