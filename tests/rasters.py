"""Rasters and options that tests share."""

import numpy as np

from inkgrid.functions import options

BASE = {
    "lpi": 43.0, "angle": -37.0, "origin_x": 19.0, "origin_y": 71.0, "key": "#183c50", "input_black": 7.0, "input_midtone": 2.0, "input_white": 100.0, "output_white": 209.0,
}
#: Feature -> further options of the golden cases.
FEATURES = {
    "plain": {"defringe": True, "shadow_boost": 23.0, "color_boost": 12.0}, "solid": {"input_black": 0.0, "input_white": 1.0, "output_white": 255.0, "knockout": False}, "disabled": {"halftone": False},
    "recover": {"recover": True}, "edges": {"cleanup": "high", "protection": "edges", "edge_radius": 2}, "selection": {"cleanup": "high", "protection": "selection"},
}
#: A test value: shape and feature -> screened, ink, removed, components, protected, SHA-256 of the pixels. Read from FIXTURES.md.


def golden():
    import re
    from pathlib import Path

    text = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
    for m in re.finditer(r"^\| (\w+) \| (\w+) \| (\d+) \| (\d+) \| (\d+) \| (\d+) \| (\d+) \| `(\w{64})` \|", text, re.M):
        yield m[1], m[2], tuple(map(int, m.groups()[2:7])), m[8]


def golden_raster():
    w, h = 64, 48
    p = np.arange(w * h)
    x, y = p % w, p // w
    a = np.where(p % 7 == 0, 0, np.where(p % 5 == 0, 255, (13 * x + 23 * y) % 256))
    rgba = np.stack([(17 * x + 3 * y) % 256, (5 * x + 11 * y) % 256, (7 * x + 19 * y) % 256, a], axis=1).astype(np.uint8).reshape(h, w, 4)
    return rgba, np.where(p % 9 == 0, 255, 0).reshape(h, w)


def filled(**own):
    """Options as the kernel takes them, with defaults."""
    o = {n: d for n, _, d in options.DEFAULTS} | own
    key = o["key"].lstrip("#")
    o |= {f"key_{c}": int(key[2 * i : 2 * i + 2], 16) for i, c in enumerate("rgb")}
    if o["min_diameter_mm"] is None:
        o["min_diameter_mm"] = options.LEVELS[o["cleanup"]][1]
    return o
