"""SQL of the registered print queries, for DuckDB. Written from the meaning of each operator, not from its code; numbers such as 3e0 are doubles."""

from __future__ import annotations

import math
import struct

PI = repr(math.pi)

_ART = """art AS (SELECT p_partkey AS image_id, p_name || '.png' AS name, (24 + p_partkey % 17)::INT AS width, (16 + p_size % 13)::INT AS height,
  CASE WHEN p_size % 10 = 0 THEN 72e0 ELSE 300e0 END AS dpi, p_partkey % 5 AS recipe_id, p_size, p_brand FROM part)"""
_PX = """px AS (SELECT image_id, x, y, width, height, recipe_id, (17 * x + 3 * y + 7 * p_size) % 256 AS r, (5 * x + 11 * y + 13 * image_id) % 256 AS g, (7 * x + 19 * y) % 256 AS b,
  CASE WHEN p % 7 = 0 THEN 0 WHEN p % 5 = 0 THEN 255 ELSE (13 * x + 23 * y) % 256 END AS a
  FROM (SELECT *, y * width + x AS p FROM art, (SELECT unnest(range(64))::INT AS x), (SELECT unnest(range(48))::INT AS y) WHERE x < width AND y < height))"""
_REC = """rec(recipe_id, shape, knockout, recover, key, inb, mid, inw, outw, halftone) AS (VALUES (0, 'round', true, false, 0, 0e0, 1e0, 255e0, 255e0, true), (1, 'square', false, false, 0, 0e0, 1e0, 255e0, 255e0, true),
  (2, 'diamond', true, true, 32, 0e0, 1e0, 255e0, 255e0, true), (3, 'line', true, false, 0, 7e0, 2e0, 100e0, 209e0, true), (4, 'round', true, false, 0, 0e0, 1e0, 255e0, 255e0, false))"""
#: Coverage (raw, value), cell offsets (u, v) and the screen (th, ink).
_COV = """c0 AS (SELECT px.*, rec.* EXCLUDE (recipe_id), sqrt(((r - key) * (r - key) + (g - key) * (g - key) + (b - key) * (b - key))::DOUBLE) / (255e0 * sqrt(3e0)) AS d FROM px JOIN rec USING (recipe_id)),
c1 AS (SELECT *, greatest(0e0, least(1e0, (d - 2e0 / 1e2) / (35e0 / 1e2))) AS t, CASE WHEN recover THEN greatest(0e0, least(1e0, greatest(
  CASE WHEN r >= key THEN (r - key) / (255 - key)::DOUBLE ELSE (key - r) / key::DOUBLE END, CASE WHEN g >= key THEN (g - key) / (255 - key)::DOUBLE ELSE (key - g) / key::DOUBLE END,
  CASE WHEN b >= key THEN (b - key) / (255 - key)::DOUBLE ELSE (key - b) / key::DOUBLE END))) END AS m FROM c0),
c2 AS (SELECT *, CASE WHEN a > 0 THEN a / 255e0 * (CASE WHEN knockout THEN t * t * (3e0 - 2e0 * t) ELSE 1e0 END) * coalesce(m, 1e0) ELSE 0e0 END AS raw FROM c1),
c3 AS (SELECT *, CASE WHEN raw <= 0 THEN 0e0 ELSE pow(greatest(0e0, least(1e0, (raw * 255e0 - inb) / (inw - inb))), 1e0 / mid) * outw / 255e0 END AS value FROM c2)"""
_SCREEN = (
    """, c4 AS (SELECT *, ((x + 0.5e0) * cos(45e0 * PI / 180e0) + (y + 0.5e0) * sin(45e0 * PI / 180e0)) / (300e0 / 35e0) AS bu, (-(x + 0.5e0) * sin(45e0 * PI / 180e0) + (y + 0.5e0) * cos(45e0 * PI / 180e0)) / (300e0 / 35e0) AS bv FROM c3),
c5 AS (SELECT *, abs(bu - floor(bu) - 0.5e0) AS u, abs(bv - floor(bv) - 0.5e0) AS v FROM c4),
c6 AS (SELECT *, sqrt(u * u + v * v) AS rad FROM c5),
c7 AS (SELECT *, CASE shape WHEN 'square' THEN 4e0 * greatest(u, v) * greatest(u, v) WHEN 'line' THEN 2e0 * v WHEN 'diamond' THEN CASE WHEN u + v <= 0.5e0 THEN 2e0 * (u + v) * (u + v) ELSE 1e0 - 2e0 * (1e0 - u - v) * (1e0 - u - v) END
  ELSE CASE WHEN rad <= 0.5e0 THEN PI * rad * rad WHEN rad >= sqrt(0.5e0) THEN 1e0 ELSE PI * rad * rad - 4e0 * (rad * rad * acos(least(1e0, 0.5e0 / rad)) - 0.5e0 * sqrt(greatest(0e0, rad * rad - 0.25e0))) END END AS th FROM c6),
s AS (SELECT *, a > 0 AND value >= 0.03e0 AND value > 0 AND CASE WHEN halftone THEN value >= 1 OR value > th ELSE value * 255e0 >= 128e0 END AS ink FROM c7)"""
).replace("PI", PI)
_ALL = f"WITH {_ART}, {_PX}, {_REC}, {_COV}{_SCREEN}"
_OUT = "CASE WHEN NOT ink THEN 0 WHEN m > 0 THEN floor(least(255e0, greatest(0e0, ({c} - (1e0 - m) * key) / m)) + 0.5e0) ELSE {c} END"


def _print(c: str) -> str:
    return _OUT.format(c=c)


def _over(c: str, a: str, k: str) -> str:
    return f"floor({c} * ({a} / 255e0) + {k} * (1e0 - {a} / 255e0) + 0.5e0)::BIGINT"


_BOARD = "(CASE WHEN (x // 12 + y // 12) % 2 = 0 THEN 190 ELSE 230 END)"


def _previews() -> str:
    ink = "(CASE WHEN ink THEN 255 ELSE 0 END)"
    before = lambda c, k: _over(c, "a", k)
    after = lambda c, k: _over(f"({_print(c)})", ink, k)
    split = "floor(width / 2e0 + 0.5e0)"
    modes = {
        "original": lambda c: before(c, _BOARD), "garment": lambda c: after(c, "key"), "beforeGarment": lambda c: before(c, "key"), "transparent": lambda c: after(c, _BOARD), "mask": lambda c: ink,
        "compare": lambda c: f"CASE WHEN x < {split} THEN {before(c, 'key')} WHEN x = {split} AND {split} < width THEN 255 ELSE {after(c, 'key')} END",
        "removed": lambda c: f"CASE WHEN ink AND (x + 2 * y) % 7 = 0 THEN {dict(r=255, g=110, b=70)[c]} ELSE 0 END", "protection": lambda c: "CASE WHEN a >= 250 AND x % 3 = 0 THEN 240 ELSE 0 END",
    }
    return _ALL + " UNION ALL ".join(f" SELECT image_id, '{m}' AS mode, " + ", ".join(f"sum({f(c)})::BIGINT AS {c}" for c in "rgb") + " FROM s GROUP BY image_id" for m, f in modes.items())


def _cdf(shape: str) -> str:
    key = "(u * u + 4e0 * v * v) / 1.25e0" if shape == "ellipse" else "CASE WHEN 2e0 * u + 2e0 * v <= 1 THEN 4e0 * u * u + 4e0 * v * v ELSE 2e0 - ((2e0 * u - 1e0) * (2e0 * u - 1e0) + (2e0 * v - 1e0) * (2e0 * v - 1e0)) END / 2e0"
    return f"least(8191, floor(({key}) * 8192e0))::INT"


_LOOKUP = f"""ax AS (SELECT abs((unnest(range(512)) + 0.5e0) / 512e0 - 0.5e0) AS u), pt AS (SELECT a.u AS u, b.u AS v FROM ax a, ax b),
bins AS (SELECT 'ellipse' AS shape, {_cdf("ellipse")} AS bin FROM pt UNION ALL SELECT 'euclidean', {_cdf("euclidean")} FROM pt),
n AS (SELECT shape, bin, count(*) AS n FROM bins GROUP BY ALL),
cdf AS (SELECT shape, bin, ((sum(coalesce(n, 0)) OVER (PARTITION BY shape ORDER BY bin)) / 262144e0)::FLOAT::DOUBLE AS cdf FROM (SELECT unnest(range(8192))::INT AS bin) CROSS JOIN (VALUES ('ellipse'), ('euclidean')) sh(shape) LEFT JOIN n USING (shape, bin))"""


def _threshold(where: str, angle: str, cell: str) -> str:
    """CTEs from `where` (x, y, shape) to `th` with its threshold as th."""
    co, si = f"cos({angle} * {PI} / 180e0)", f"sin({angle} * {PI} / 180e0)"
    return f"""t4 AS (SELECT *, ((x + 0.5e0) * {co} + (y + 0.5e0) * {si}) / ({cell}) AS bu, (-(x + 0.5e0) * {si} + (y + 0.5e0) * {co}) / ({cell}) AS bv FROM {where}),
t5 AS (SELECT *, abs(bu - floor(bu) - 0.5e0) AS u, abs(bv - floor(bv) - 0.5e0) AS v FROM t4),
t6 AS (SELECT *, sqrt(u * u + v * v) AS rad, CASE shape WHEN 'ellipse' THEN {_cdf("ellipse")} WHEN 'euclidean' THEN {_cdf("euclidean")} END AS bin FROM t5),
th AS (SELECT t6.*, CASE shape WHEN 'square' THEN 4e0 * greatest(u, v) * greatest(u, v) WHEN 'line' THEN 2e0 * v WHEN 'diamond' THEN CASE WHEN u + v <= 0.5e0 THEN 2e0 * (u + v) * (u + v) ELSE 1e0 - 2e0 * (1e0 - u - v) * (1e0 - u - v) END
  WHEN 'round' THEN CASE WHEN rad <= 0.5e0 THEN {PI} * rad * rad WHEN rad >= sqrt(0.5e0) THEN 1e0 ELSE {PI} * rad * rad - 4e0 * (rad * rad * acos(least(1e0, 0.5e0 / rad)) - 0.5e0 * sqrt(greatest(0e0, rad * rad - 0.25e0))) END ELSE cdf END AS th
  FROM t6 LEFT JOIN cdf USING (shape, bin))"""


_GAIN = f"""WITH {_ART}, v AS (SELECT image_id, image_id % 3 AS k, p_size / 50e0 AS value FROM art),
knots(k, m, n) AS (VALUES (0, 0e0, 0e0), (0, 14e0, 10e0), (0, 41e0, 30e0), (0, 63e0, 50e0), (0, 80e0, 70e0), (0, 94e0, 90e0), (0, 100e0, 100e0), (1, 0e0, 0e0), (1, 40e0, 25e0), (1, 70e0, 50e0), (1, 90e0, 75e0), (1, 100e0, 100e0)),
seg AS (SELECT k, lag(m) OVER w AS m0, m AS m1, lag(n) OVER w AS n0, n AS n1 FROM knots WINDOW w AS (PARTITION BY k ORDER BY m)),
x AS (SELECT image_id, value, CASE WHEN value >= 1 THEN 1e0 ELSE coalesce((n0 + (n1 - n0) * (value * 100e0 - m0) / (m1 - m0)) / 100e0, value) END AS req FROM v LEFT JOIN seg ON seg.k = v.k AND value * 100e0 > m0 AND value * 100e0 <= m1)
SELECT image_id, round(CASE WHEN req >= 0.95e0 THEN 1e0 ELSE req END, 9) AS by_array, round(req, 9) AS requested FROM x"""

_GAIN_PARSE = f"""WITH {_ART}, a AS (SELECT image_id, p_size::DOUBLE AS n1, (image_id % 103)::DOUBLE AS m1, image_id % 11 = 0 AS odd, (p_size + image_id % 3 * 20)::DOUBLE AS n2, (image_id % 103 + image_id % 7 - 1)::DOUBLE AS m2 FROM art),
o AS (SELECT *, CASE WHEN (n1, m1) <= (n2, m2) THEN n1 ELSE n2 END AS na, CASE WHEN (n1, m1) <= (n2, m2) THEN m1 ELSE m2 END AS ma, CASE WHEN (n1, m1) <= (n2, m2) THEN n2 ELSE n1 END AS nb, CASE WHEN (n1, m1) <= (n2, m2) THEN m2 ELSE m1 END AS mb FROM a),
e AS (SELECT *, CASE WHEN odd OR m2 < 0 THEN 'not a pair' WHEN na <= 0 OR nb >= 100 THEN 'nominal out of range' WHEN ma > 100 OR mb > 100 THEN 'measured out of range' WHEN nb <= na THEN 'nominal repeats'
  WHEN ma <= 0 OR mb <= ma THEN 'measured does not grow' WHEN mb >= 100 THEN 'last measured is full' END AS error FROM o)
SELECT image_id, error, CASE WHEN error IS NULL THEN 2 END AS n, CASE WHEN error IS NULL THEN ma END AS first_measured FROM e"""

_RULES = f"""WITH {_ART}, o AS (SELECT image_id AS recipe_id, ['dark-photo', 'dark-fine', 'light-logo', 'vintage', 'engraving', 'dark-euclid', 'knockout-only', 'none'][image_id % 8 + 1] AS preset_id, p_size * 4e0 AS lpi0, (image_id % 300)::DOUBLE AS black,
  CASE WHEN image_id % 2 = 0 THEN '#' ELSE '' END || substr(md5(name), 1, 6) || CASE WHEN image_id % 13 = 0 THEN '0' ELSE '' END AS key0, p_size / 10e0 AS gamma FROM art),
p AS (SELECT *, CASE preset_id WHEN 'dark-fine' THEN 40e0 WHEN 'light-logo' THEN 35e0 WHEN 'vintage' THEN 25e0 WHEN 'none' THEN lpi0 ELSE 30e0 END AS lpi, CASE preset_id WHEN 'engraving' THEN 'line' WHEN 'dark-euclid' THEN 'euclidean' ELSE 'round' END AS shape,
  CASE preset_id WHEN 'knockout-only' THEN 0e0 WHEN 'dark-fine' THEN 0.12e0 WHEN 'light-logo' THEN 0.12e0 WHEN 'vintage' THEN 0.12e0 ELSE 0.2e0 END AS min_diameter_mm,
  CASE preset_id WHEN 'none' THEN key0 WHEN 'light-logo' THEN '#ffffff' ELSE '#000000' END AS key FROM o),
q AS (SELECT *, CASE WHEN length(ltrim(key, '#')) = 6 THEN ltrim(key, '#') END AS hex FROM p)
SELECT recipe_id, preset_id, lpi, shape, min_diameter_mm, concat_ws(',', CASE WHEN lpi < 5 OR lpi > 150 THEN 'lpi' END, CASE WHEN gamma < 0.25e0 OR gamma > 4 THEN 'gamma' END, CASE WHEN preset_id = 'none' AND black > 254 THEN 'input_black' END,
  CASE WHEN preset_id = 'none' AND black >= 255 THEN 'input black and white' END, CASE WHEN preset_id <> 'knockout-only' AND 300e0 / lpi < 4 THEN 'resolution' END, CASE WHEN hex IS NULL THEN 'key' END) AS violations,
  ('0x' || substr(hex, 1, 2))::INT AS r, ('0x' || substr(hex, 5, 2))::INT AS b FROM q"""

_NEAR = """SELECT DISTINCT p.image_id, p.x, p.y FROM {p} p, (VALUES (-1), (0), (1)) dx(dx), (VALUES (-1), (0), (1)) dy(dy) JOIN {q} q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy WHERE (dx <> 0 OR dy <> 0)"""

_RESAMPLED = f"""WITH {_ART}, {_PX}, z AS (SELECT image_id, width AS w, height AS h, (width * 2) // 3 AS ow, (height * 3) // 2 AS oh FROM art),
wx AS (SELECT image_id, ox, p, least((ox + 1) * sx, p + 1e0) - greatest(ox * sx, p) AS q, sx FROM (SELECT *, w / ow::DOUBLE AS sx FROM z), (SELECT unnest(range(64)) AS ox), (SELECT unnest(range(64)) AS p) WHERE ox < ow AND p < w AND p + 1 > ox * sx AND p < (ox + 1) * sx),
cy AS (SELECT image_id, oy, h, greatest(0e0, least(h - 1e0, (oy + 0.5e0) * (h / oh::DOUBLE) - 0.5e0)) AS f FROM z, (SELECT unnest(range(64)) AS oy) WHERE oy < oh),
wy AS (SELECT image_id, oy, floor(f)::INT AS p, 1e0 - (f - floor(f)) AS q FROM cy UNION ALL SELECT image_id, oy, least(h - 1, floor(f)::INT + 1), f - floor(f) FROM cy),
t AS (SELECT px.image_id, ox, oy, sum(a / 255e0 * wx.q / sx * wy.q) AS sa, sum(r * (a / 255e0 * wx.q / sx) * wy.q) AS sr, sum(g * (a / 255e0 * wx.q / sx) * wy.q) AS sg, sum(b * (a / 255e0 * wx.q / sx) * wy.q) AS sb
  FROM px JOIN wx ON wx.image_id = px.image_id AND wx.p = px.x JOIN wy ON wy.image_id = px.image_id AND wy.p = px.y WHERE a > 0 GROUP BY ALL)
SELECT image_id, count(*) AS pixels, sum(floor(round(sr / sa, 9) + 0.5e0))::BIGINT AS r, sum(floor(round(sg / sa, 9) + 0.5e0))::BIGINT AS g, sum(floor(round(sb / sa, 9) + 0.5e0))::BIGINT AS b, sum(floor(round(sa * 255e0, 9) + 0.5e0))::BIGINT AS a FROM t WHERE sa > 0 GROUP BY image_id"""

#: Both axes shrink to 12 pixels at most; an area average by the overlap of pixels.
_SMALL = f"""WITH {_ART}, {_PX}, z AS (SELECT image_id, width AS w, height AS h, greatest(1, floor(width * least(1e0, 12 / greatest(width, height)::DOUBLE) + 0.5e0))::INT AS ow, greatest(1, floor(height * least(1e0, 12 / greatest(width, height)::DOUBLE) + 0.5e0))::INT AS oh FROM art),
wx AS (SELECT image_id, ox, p, (least((ox + 1) * sx, p + 1e0) - greatest(ox * sx, p)) / sx AS q FROM (SELECT *, w / ow::DOUBLE AS sx FROM z), (SELECT unnest(range(12)) AS ox), (SELECT unnest(range(64)) AS p) WHERE ox < ow AND p < w AND p + 1 > ox * sx AND p < (ox + 1) * sx),
wy AS (SELECT image_id, oy, p, (least((oy + 1) * sy, p + 1e0) - greatest(oy * sy, p)) / sy AS q FROM (SELECT *, h / oh::DOUBLE AS sy FROM z), (SELECT unnest(range(12)) AS oy), (SELECT unnest(range(64)) AS p) WHERE oy < oh AND p < h AND p + 1 > oy * sy AND p < (oy + 1) * sy),
t AS (SELECT px.image_id, ox, oy, sum(a / 255e0 * wx.q * wy.q) AS sa, sum(r * (a / 255e0 * wx.q) * wy.q) AS sr, sum(g * (a / 255e0 * wx.q) * wy.q) AS sg, sum(b * (a / 255e0 * wx.q) * wy.q) AS sb
  FROM px JOIN wx ON wx.image_id = px.image_id AND wx.p = px.x JOIN wy ON wy.image_id = px.image_id AND wy.p = px.y WHERE a > 0 GROUP BY ALL)
SELECT image_id, max(ox)::INT AS max_x, max(oy)::INT AS max_y, sum(floor(round(sr / sa, 9) + 0.5e0))::BIGINT AS r, sum(floor(round(sg / sa, 9) + 0.5e0))::BIGINT AS g, sum(floor(round(sb / sa, 9) + 0.5e0))::BIGINT AS b, sum(floor(round(sa * 255e0, 9) + 0.5e0))::BIGINT AS a
FROM t WHERE floor(round(sa * 255e0, 9) + 0.5e0) > 0 GROUP BY image_id"""

#: FNV-1a over a tile's bytes in row order: h -> (h xor byte) * 16777619 mod 2 ** 32, from 2166136261 on.
_FNV = f"""WITH {_ART}, {_PX}, t AS (SELECT image_id, y // 16 AS tile_y, x // 16 AS tile_x, flatten(list([r, g, b, a] ORDER BY y, x)) AS bytes FROM px GROUP BY ALL)
SELECT image_id, tile_y, tile_x, format('{{:08x}}', list_reduce(list_prepend(2166136261::BIGINT, bytes::BIGINT[]), lambda h, v: (xor(h, v) * 16777619) % 4294967296)) AS fnv FROM t"""

#: Art is drawn pixel by pixel; the rest of the canvas is the same for all art but for the garment's colour.
_MOCKUP = (
    _ALL
    + f""", ys AS (SELECT y, CASE WHEN y < 30 + 360e0 * 0.24e0 THEN 65e0 * (1e0 - (y - 30) / (360e0 * 0.24e0)) ELSE 0e0 END AS sl FROM (SELECT unnest(range(540)) AS y)),
cv AS (SELECT x, y, y >= 30 AND y <= 390 AND x >= 80e0 - sl AND x <= 340e0 + sl AS inside FROM (SELECT unnest(range(420)) AS x), ys),
cn AS (SELECT count(*) AS n, count(*) FILTER (inside) AS n_in FROM cv),
g AS (SELECT image_id, width AS w, height AS h, 30e0 * 5e0 AS aw, height / width::DOUBLE * 30e0 * 5e0 AS ah, key FROM art JOIN rec USING (recipe_id)),
b AS (SELECT *, 80e0 + 260e0 * 0.5e0 - aw / 2e0 AS al, 30 + 360e0 * 18 / 100e0 AS tp FROM g),
bx AS (SELECT image_id, x, least(w - 1, greatest(0, floor((x - al) / aw * w)))::INT AS sx FROM b, (SELECT unnest(range(420)) AS x) WHERE x >= floor(al) AND x < ceil(al + aw)),
bv AS (SELECT image_id, y, least(h - 1, greatest(0, floor((y - tp) / ah * h)))::INT AS sy FROM b, (SELECT unnest(range(540)) AS y) WHERE y >= floor(tp) AND y < ceil(tp + ah)),
o AS (SELECT image_id, x AS sx, y AS sy, {", ".join(f"{_print(c)} AS {c}" for c in "rgb")} FROM s WHERE ink),
f AS (SELECT bx.image_id, o.r, o.g, o.b, bx.x, bv.y FROM bx JOIN bv ON bv.image_id = bx.image_id JOIN o ON o.image_id = bx.image_id AND o.sx = bx.sx AND o.sy = bv.sy JOIN cv ON cv.x = bx.x AND cv.y = bv.y WHERE cv.inside),
z AS (SELECT image_id, count(*) AS k, {", ".join(f"sum({c}) AS {c}" for c in "rgb")}, sum(CASE WHEN r > 100 THEN x + y ELSE 0 END) AS places FROM f GROUP BY image_id)
SELECT g.image_id, n AS pixels, {", ".join(f"(coalesce({c}, 0) + (n_in - coalesce(k, 0)) * key + (n - n_in) * {v})::BIGINT AS {c}" for c, v in (("r", 24), ("g", 27), ("b", 26)))}, coalesce(places, 0)::BIGINT AS places FROM g CROSS JOIN cn LEFT JOIN z USING (image_id)"""
)
#: Chest 52 cm, garment 72 cm: 5 pixels a cm, body 260 x 360.

_AREAS = """ad(placement, i, w, h) AS (SELECT p, unnest(range(1, 8)), unnest(ws), unnest(hs) FROM (VALUES ('front', [22e0, 24, 27, 29, 30, 31, 31.5], [28e0, 30, 33, 35, 35.5, 38, 40]), ('back', [24e0, 26, 28, 30, 30, 31, 31.5], [30e0, 32, 34, 35.5, 35.5, 38, 40]),
  ('chest', [10e0, 10, 10, 10, 10, 10, 10], [10e0, 10, 10, 10, 10, 10, 10]), ('sleeve', [8e0, 8, 8, 8, 8, 8, 8], [10e0, 10, 10, 10, 10, 10, 10]), ('neck', [8e0, 8, 8, 8, 8, 8, 8], [5e0, 5, 5, 5, 5, 5, 5])) t(p, ws, hs))"""
_SIZE = "['XS', 'S', 'M', 'L', 'XL', '2XL', '3XL']"

_VARIANT_SIZES = f"""WITH {_ART}, {_AREAS}, v AS (SELECT l_partkey AS image_id, l_linenumber AS i, ['front', 'back', 'chest', 'sleeve', 'neck'][1 + l_suppkey % 5] AS placement, sum(l_quantity::BIGINT)::BIGINT AS copies FROM lineitem GROUP BY ALL),
w AS (SELECT v.image_id, {_SIZE}[v.i] AS size, placement, copies, width AS w, height AS h, CASE WHEN placement = 'neck' AND v.i = 3 THEN 9e0 WHEN placement = 'front' AND v.i = 5 THEN 20e0 ELSE ad.w END AS area_w,
  CASE WHEN placement = 'neck' AND v.i = 3 THEN 6e0 WHEN placement = 'front' AND v.i = 5 THEN 20e0 ELSE ad.h END AS area_h FROM v JOIN art USING (image_id) JOIN ad USING (placement, i)),
p AS (SELECT *, greatest(1, floor(w * least(area_w / w, area_h / h) / 2.54e0 * 300e0 + 0.5e0))::BIGINT AS ow FROM w)
SELECT image_id, size, placement, copies, area_w, area_h, ow AS width, greatest(1, floor(ow * h / w::DOUBLE + 0.5e0))::BIGINT AS height FROM p"""

_PLANS = f"""WITH {_ART}, a AS (SELECT *, p_size / 2e0 + 77e0 AS cm, greatest(1, floor((p_size / 2e0 + 77e0) / 2.54e0 * 300e0 + 0.5e0))::BIGINT AS w0, greatest(1, floor(height / dpi * 2.54e0 / 2.54e0 * 300e0 + 0.5e0))::BIGINT AS h1 FROM art),
b AS (SELECT *, greatest(1, floor(w0 * height / width::DOUBLE + 0.5e0))::BIGINT AS h0, greatest(1, floor(h1 * width / height::DOUBLE + 0.5e0))::BIGINT AS w1 FROM a),
c AS (SELECT *, CASE WHEN cm > 100 THEN 'size out of range' WHEN w0 * h0 > 128000000 THEN 'too many pixels' END AS w_error FROM b)
SELECT image_id, CASE WHEN w_error IS NULL THEN w0 END AS ww, CASE WHEN w_error IS NULL THEN h0 END AS wh, w_error, w1 AS tw, h1 AS th, round(h1 / 300e0 * 2.54e0, 9) AS t_cm, w1 > width OR h1 > height AS t_up, dpi = 300 AS ready FROM c"""

_DERIVED = f"""WITH {_ART}, a AS (SELECT *, p_size AS s, width / height::DOUBLE AS k, ['none', 'low', 'standard', 'high'][image_id % 4 + 1] AS lv FROM art),
b AS (SELECT *, greatest(1, ceil({PI} * (s / 100e0 / 25.4e0 * 300e0 / 2e0) * (s / 100e0 / 25.4e0 * 300e0 / 2e0))) AS area, greatest(1, ceil({PI} * (s / 200e0 / 25.4e0 * 300e0 / 2e0) * (s / 200e0 / 25.4e0 * 300e0 / 2e0))) AS pores,
  CASE WHEN lv = 'low' THEN 0e0 ELSE floor((CASE WHEN s + 10 >= 40 THEN 1e0 ELSE 1e0 + 0.1e0 * (40e0 - (s + 10e0)) END + CASE WHEN lv = 'high' THEN 0.5e0 ELSE 0e0 END) * 100e0 + 0.5e0) / 100e0 END AS feather, width::BIGINT * 200 * height * 200 AS n FROM a),
c AS (SELECT *, CASE WHEN s % 10 = 0 OR n > 16000000 THEN n * CASE WHEN s % 4 = 0 THEN 9 ELSE 8 END ELSE 0 END AS cache FROM b)
SELECT image_id, greatest(0, floor(CASE WHEN k > 1 THEN s * 3 * k ELSE (s * 3 + 0.5e0) * k - 0.5e0 END) - 1)::BIGINT AS lo, least(width * 5, ceil(CASE WHEN k > 1 THEN (s * 3 + 16) * k ELSE (s * 3 + 16 - 0.5e0) * k - 0.5e0 END) + 2)::BIGINT AS hi,
  greatest(1, ceil({PI} * (s / 50e0 / 25.4e0 * 300e0 / 2e0) * (s / 50e0 / 25.4e0 * 300e0 / 2e0)))::BIGINT AS min_area, greatest(1, floor(300e0 / (s + 10e0) * (300e0 / (s + 10e0)) + 0.5e0))::BIGINT AS tones,
  (CASE WHEN s % 2 = 1 THEN CASE WHEN lv = 'none' THEN 0 ELSE CASE WHEN feather > 0 THEN greatest(1, floor(feather / 2e0 + 0.5e0)) ELSE 0 END + 2 * CASE WHEN lv = 'high' THEN 2 ELSE 1 END END ELSE area - 1 END
   + CASE WHEN pores > 1 THEN pores - 1 ELSE 0 END + greatest(CASE WHEN s % 3 = 0 THEN 3 ELSE 0 END, CASE WHEN s % 5 = 0 THEN 4 ELSE 0 END) + [0, 5, 57][s % 3 + 1])::BIGINT AS halo,
  floor(s / 25.4e0 * 300e0 + 0.5e0)::BIGINT AS mm_px, floor(s / 2.54e0 * 300e0 + 0.5e0)::BIGINT AS cm_px, round(s / 300e0 * 2.54e0, 9) AS px_cm, cache::BIGINT AS cache, CASE WHEN s % 10 = 0 OR n > 16000000 THEN 32000000 ELSE n * 14 END::BIGINT AS working, ceil(cache * 1.25e0 + n * 4)::BIGINT AS recommended FROM c"""


def _safe(c: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace({c}, '\\.[^.]+$', ''), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', ''), 1, 80), ''), 'imagen')"


def _name(i: str, c: str, size: str, place: str) -> str:
    return f"(CASE WHEN {i} + 1 < 1000 THEN lpad(({i} + 1)::VARCHAR, 3, '0') ELSE ({i} + 1)::VARCHAR END || '_' || {_safe(c)} || '_' || {size} || '_' || {place} || '_300ppp.png')"


_NAMES = f"""WITH a AS (SELECT page_id, {_safe("url")} AS safe, {_name("page_id", "url", "'M'", "'front'")} AS output, ['=', '+', '"', 'a', '-'][page_id % 5 + 1] || url AS odd FROM pages)
SELECT page_id, safe, output, regexp_replace(output, '\\.png$', '_blanco.png') AS white, '"' || replace(CASE WHEN regexp_matches(odd, '^[=+@-]') THEN '''' ELSE '' END || odd, '"', '""') || '","' || page_id || '",""' AS line FROM a"""

_JOB = f"""{_ART}, {_AREAS}, f AS (SELECT image_id AS i, name, CASE WHEN image_id % 3 = 0 AND image_id % 2 = 0 THEN ['S', 'XL'] WHEN image_id % 15 = 0 THEN [] ELSE ['M', 'L'] END AS ss, CASE WHEN image_id % 12 = 0 THEN ['back', 'neck'] ELSE ['front'] END AS pp,
  CASE WHEN image_id % 9 = 0 THEN 'child' ELSE 'adult' END AS garment, CASE WHEN image_id % 3 = 0 THEN 1 ELSE recipe_id END AS recipe_id FROM art),
g AS (SELECT *, unnest(range(1, len(ss) + 1)) AS si FROM f), h AS (SELECT *, unnest(range(1, len(pp) + 1)) AS pi FROM g),
v AS (SELECT row_number() OVER (ORDER BY i, si, pi) - 1 AS id, i AS image_idx, name AS image, ss[si] AS size, pp[pi] AS placement, garment, recipe_id, CASE WHEN garment = 'child' THEN 'error' ELSE 'pending' END AS status,
  ss[si] || '/' || {_name("i", "name", "ss[si]", "pp[pi]")} AS output, CASE WHEN garment = 'child' THEN 'size or position' END AS error FROM h)"""

_PREFLIGHT = f"""WITH {_JOB}, {_REC}, w AS (SELECT v.*, a.width * 20 AS w, a.height * 20 AS h, a.p_size, ad.w AS aw, ad.h AS ah, halftone FROM v JOIN art a ON a.image_id = image_idx LEFT JOIN ad ON ad.placement = v.placement AND {_SIZE}[ad.i] = v.size JOIN rec ON rec.recipe_id = v.recipe_id),
p AS (SELECT *, greatest(1, floor(w * least(aw / w, ah / h) / 2.54e0 * 300e0 + 0.5e0))::BIGINT AS ow FROM w), q AS (SELECT *, greatest(1, floor(ow * h / w::DOUBLE + 0.5e0))::BIGINT AS oh FROM p),
r AS (SELECT *, CASE WHEN status = 'error' THEN 'area' WHEN p_size = 7 THEN 'unreadable' END AS problem, ow * oh AS n FROM q)
SELECT id, image, size, placement, CASE WHEN problem IS NULL THEN 'ready' ELSE 'error' END AS status, CASE WHEN problem IS NULL THEN ow END AS width_px, CASE WHEN problem IS NULL THEN oh END AS height_px,
  CASE WHEN problem IS NULL THEN ceil(CASE WHEN n > 16000000 THEN n * 8 ELSE 0 END * 1.25e0 + n * 4)::BIGINT END AS recommended_bytes, CASE WHEN problem IS NULL THEN concat_ws(',', CASE WHEN NOT halftone THEN 'no_screen' END, CASE WHEN ow > w OR oh > h THEN 'upscaled' END) END AS warnings, problem AS error FROM r"""

_MANIFEST = f"""WITH {_ART}, p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY image_id) - 1) % 500 AS pos FROM art),
q AS (SELECT CASE WHEN image_id % 17 = 0 THEN pos + 1 ELSE pos END AS id, CASE WHEN p_brand = 'Brand#3' THEN 'format' WHEN image_id % 17 = 0 THEN 'id' WHEN image_id % 19 = 0 THEN 'index' WHEN image_id % 5 = 0 THEN 'output' ELSE 'none' END AS problem FROM p)
SELECT problem, count(*) AS rows, sum(id)::BIGINT AS ids FROM q GROUP BY problem"""

_RECIPES = f"""WITH {_ART}, p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY image_id) // 50 AS n FROM art),
q AS (SELECT CASE WHEN p_size = 5 THEN 'no name' ELSE 'none' END AS error, p_size + 5e0 AS lpi, 1 AS one FROM p WHERE n <> 1 UNION ALL SELECT 'format', NULL, NULL FROM (SELECT DISTINCT p_brand FROM p WHERE n = 1))
SELECT error, count(*) AS n, sum(lpi) AS lpi, count(one) AS ids FROM q GROUP BY error"""

_STATE = """WITH e AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'cancelled' END AS status,
  CASE WHEN value > 20 THEN floor(value * 10)::INT END AS px, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error FROM events),
l AS (SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(px, seq) FILTER (px IS NOT NULL) AS "widthPX", arg_max(error, seq) FILTER (error IS NOT NULL) AS error, max(seq) AS seq FROM e GROUP BY id)
"""

_RESUME = f"""WITH {_JOB}, l AS (SELECT id, CASE WHEN id % 9 = 0 THEN regexp_replace(output, '\\.png$', '_r2.png') ELSE output END AS out2 FROM v WHERE id % 6 = 0),
s AS (SELECT v.id, coalesce(out2, output) AS output, v.output AS base, l.id IS NOT NULL AS done FROM v LEFT JOIN l USING (id)),
t AS (SELECT output AS name FROM v WHERE id % 2 = 0 UNION SELECT regexp_replace(output, '\\.png$', '_r2.png') FROM v WHERE id % 4 = 0)
SELECT id, CASE WHEN done THEN 'done' ELSE 'pending' END AS status, output, CASE WHEN done THEN NULL WHEN base NOT IN (SELECT name FROM t) THEN base WHEN regexp_replace(base, '\\.png$', '_r2.png') NOT IN (SELECT name FROM t) THEN regexp_replace(base, '\\.png$', '_r2.png') ELSE regexp_replace(base, '\\.png$', '_r3.png') END AS free FROM s"""

_SENTENCES = f"""WITH {_ART}, a AS (SELECT image_id, [12.5e0, 0, 0, 0, 40][image_id % 5 + 1] AS price, least(1e0, p_size * 2e0 / 100e0) AS f, p_size * 15e0 / 1000000 AS q, width * 1e0 * height AS area FROM art)
SELECT image_id, price, round((1e0 - f / greatest(f, least(1e0, q))) * 100e0, 6) AS savings, round(area * f / 10000e0 * 8e0, 6) AS color_ml, true AS told FROM a"""

_ITEMS = f"""{_ART}, it AS (SELECT l_orderkey AS job_id, sum(l_quantity)::INT AS copies, any_value(width) * 20 AS w, any_value(height) * 20 AS h FROM lineitem JOIN art ON image_id = l_partkey GROUP BY l_orderkey, l_partkey)"""

_SHEET_RULES = """WITH o AS (SELECT o_orderkey AS job_id, (o_orderkey % 230)::DOUBLE AS w, (o_orderkey % 25)::DOUBLE AS l, (o_orderkey % 9)::DOUBLE AS s, (o_orderkey % 61)::DOUBLE AS m, o_orderkey % 2 = 0 AS k FROM orders),
p AS (SELECT *, floor(w / 2.54e0 * 300e0 + 0.5e0)::INT AS wp, floor(s / 25.4e0 * 300e0 + 0.5e0)::INT AS gap, floor(m / 25.4e0 * 300e0 + 0.5e0)::INT AS margin, floor(l / 2.54e0 * 300e0 + 0.5e0)::INT AS lp FROM o),
q AS (SELECT *, CASE WHEN w < 10 OR w > 200 THEN 'width' WHEN l > 0 AND l < 10 THEN 'length' WHEN k AND s < 6 THEN 'spacing' WHEN m > 50 OR (k AND m < 5) THEN 'margin' WHEN wp - 2 * margin <= 0 THEN 'no room' END AS problem FROM p)
SELECT job_id, CASE WHEN problem IS NULL THEN wp END AS sheet_width, gap, margin, CASE WHEN problem IS NULL THEN CASE WHEN l > 0 THEN least(lp, 128000000 // wp) ELSE 128000000 // wp END END::INT AS limit, problem FROM q"""



def _balls() -> str:
    """CTE ball: for each pixel p of `i` whose island has at most four pixels, all these pixels q. An island of five or more has five within four steps of any of its pixels."""
    small = "QUALIFY count(*) OVER (PARTITION BY p) <= 4"
    steps = [f"k1 AS (SELECT p, q FROM nb {small})"]
    for n in (2, 3, 4):
        steps.append(f"k{n} AS (SELECT p, q FROM (SELECT DISTINCT k{n - 1}.p, nb.q FROM k{n - 1} JOIN nb ON nb.p = k{n - 1}.q) {small})")
    return (
        "i AS (SELECT *, image_id * 4096 + y * 64 + x AS pid FROM s WHERE ink), nb AS (SELECT a.pid AS p, b.pid AS q FROM i a, (VALUES (-1), (0), (1)) dx(dx), (VALUES (-1), (0), (1)) dy(dy) "
        "JOIN i b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy), " + ", ".join(steps) + ", ball AS (SELECT p, min(q) AS island FROM k4 GROUP BY p)"
    )


#: With the standard cleanup, islands of fewer than five pixels go: ceil(pi (0.2 / 25.4 * 300 / 2)**2) = 5.
_PROCESS = (
    _ALL
    + f""", {_balls()}
SELECT image_id, count(*) FILTER (s1) AS ink_pixels, count(*) FILTER (pid IS NOT NULL) AS screened_pixels, count(*) FILTER (island IS NOT NULL) AS removed_pixels, 0::BIGINT AS protected_pixels, count(*) FILTER (raw >= 0.5e0 AND a > 0) AS solid_pixels,
0::BIGINT AS filled_pixels, count(DISTINCT island) AS removed_components, 0::BIGINT AS filled_components, coalesce(sum(CASE WHEN s1 THEN {_print("r")} END), 0)::BIGINT AS sum_r, coalesce(sum(CASE WHEN s1 THEN x * 64 + y END), 0)::BIGINT AS places
FROM (SELECT *, pid IS NOT NULL AND island IS NULL AS s1 FROM (SELECT s.*, i.pid, island FROM s LEFT JOIN (SELECT image_id, x, y, pid FROM i) i USING (image_id, x, y) LEFT JOIN ball ON p = i.pid)) GROUP BY image_id"""
)


def _white(choke: int, cap: int) -> str:
    """The under-layer of all ink: distances as the number of boxes without an empty pixel, then, from the highest distance down, what neighbours above reach."""
    box = lambda k: f"min(row{k}) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    rows = ", ".join(f"min(i) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS row{k}" for k in range(1, cap))
    plain = ", ".join(f"({i}, 'round', true, false, 0, 0e0, 1e0, 255e0, 255e0, false)" for i in range(5))
    sql = f"WITH {_ART}, {_PX}, rec(recipe_id, shape, knockout, recover, key, inb, mid, inw, outw, halftone) AS (VALUES {plain}), {_COV}{_SCREEN}, {_balls()}, "
    sql += f"i0 AS (SELECT s.image_id, s.x, s.y, (ink AND island IS NULL)::INT AS i FROM s LEFT JOIN ball ON p = CASE WHEN ink THEN image_id * 4096 + y * 64 + x END), i1 AS (SELECT *, {rows} FROM i0), "
    sql += f"d AS (SELECT image_id, x, y, i, CASE WHEN i = 0 THEN 0 ELSE 1 + {' + '.join(f'(b{k} = 1)::INT' for k in range(1, cap))} END AS d FROM (SELECT *, {', '.join(f'{box(k)} AS b{k}' for k in range(1, cap))} FROM i1)), t0 AS (SELECT *, d AS top, max(d) OVER v AS dv FROM d WINDOW v AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
    for n, level in enumerate(range(cap - 1, 0, -1)):
        sql += f", u{n} AS (SELECT *, max(CASE WHEN d > {level} THEN top END) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS tv FROM t{n}), t{n + 1} AS (SELECT * EXCLUDE (top, tv), CASE WHEN d = {level} THEN greatest(top, coalesce(max(tv) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), top)) ELSE top END AS top FROM u{n})"
    sql += f", w AS (SELECT *, max(dv) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > d AS higher FROM t{cap - 1})"
    return sql + f" SELECT image_id, sum(i)::BIGINT AS color_pixels, count(*) FILTER (i = 1 AND (d > least({choke}, floor(0.35e0 * top)) OR NOT higher)) AS white_pixels FROM w GROUP BY image_id"


_DEBOUNCED = "WITH e AS (SELECT user_id::VARCHAR AS key, event_id AS id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT key, id, epoch_us(ts + INTERVAL 4 HOUR) AS fires_at FROM e WHERE nx IS NULL OR nx >= ts + INTERVAL 4 HOUR"

_PLAIN_REC = "rec(recipe_id, shape, knockout, recover, key, inb, mid, inw, outw, halftone) AS (VALUES " + ", ".join(f"({i}, 'round', true, false, 0, 0e0, 1e0, 255e0, 255e0, true)" for i in range(5)) + ")"
_PLAIN = f"WITH {_ART}, {_PX}, {_PLAIN_REC}, {_COV}{_SCREEN}"
#: Pores of fewer than five pixels (0.2 mm) that are candidates as a whole. A pore is joined along sides.
_PORES = (
    f"{_PLAIN}, i AS (SELECT *, image_id * 4096 + y * 64 + x AS pid, a > 0 AND value >= 0.03e0 AND value > 0 AS may FROM s WHERE NOT ink), nb AS (SELECT a.pid AS p, b.pid AS q FROM i a, (VALUES (-1), (0), (1)) dx(dx), (VALUES (-1), (0), (1)) dy(dy) JOIN i b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy WHERE dx = 0 OR dy = 0), "
    + _balls().partition("k1 AS")[1]
    + _balls().partition("k1 AS")[2]
    + """, f AS (SELECT island, count(*) AS n, min(p) AS p, sum(x * 64 + y) AS places FROM ball JOIN i ON pid = p GROUP BY island HAVING bool_and(may)),
g AS (SELECT p // 4096 AS image_id, sum(n)::BIGINT AS filled, count(*) AS pores, sum(places)::BIGINT AS places FROM f GROUP BY ALL),
t AS (SELECT image_id, count(*) FILTER (ink) AS ink, coalesce(sum(CASE WHEN ink THEN x * 64 + y END), 0)::BIGINT AS places FROM s GROUP BY image_id)
SELECT t.image_id, (ink + coalesce(filled, 0))::BIGINT AS ink_pixels, coalesce(filled, 0)::BIGINT AS filled_pixels, coalesce(pores, 0)::BIGINT AS filled_components, (t.places + coalesce(g.places, 0))::BIGINT AS places FROM t LEFT JOIN g USING (image_id)"""
)


def _around(c: str, table: str, to: str, f: str, beyond: str) -> str:
    """CTE `to`: f over a pixel and its four neighbours of c in `table`; beyond the image stands `beyond`."""
    side = lambda n, by, over: f"{n}({c}, 1, {beyond}) OVER (PARTITION BY image_id, {over} ORDER BY {by})"
    return f"{to} AS (SELECT *, {f}({c}, {side('lag', 'x', 'y')}, {side('lead', 'x', 'y')}, {side('lag', 'y', 'x')}, {side('lead', 'y', 'x')}) AS {to}_v FROM {table})"


def _three(c: str, by: str, over: str) -> str:
    """The sum of three pixels in a line, edge pixels repeated."""
    return f"{c} + lag({c}, 1, {c}) OVER (PARTITION BY image_id, {over} ORDER BY {by}) + lead({c}, 1, {c}) OVER (PARTITION BY image_id, {over} ORDER BY {by})"


#: With the standard cleanup at 35 lpi an opening blurs over 3 x 3 pixels, and erodes and dilates by a cross.
_OPENINGS = f"""{_PLAIN}, m AS (SELECT image_id, x, y, ink::INT AS i FROM s), b1 AS (SELECT *, {_three("i", "x", "y")} AS h FROM m), b2 AS (SELECT *, (2 * ({_three("h", "y", "x")}) >= 9)::INT AS b FROM b1),
{_around("b", "b2", "er", "least", "1")}, {_around("er_v", "er", "di", "greatest", "0")}
SELECT image_id, count(*) FILTER (i = 1 AND di_v = 1) AS ink_pixels, count(*) FILTER (i = 1 AND di_v = 0) AS removed_pixels, coalesce(sum(CASE WHEN i = 1 AND di_v = 1 THEN x * 64 + y END), 0)::BIGINT AS places FROM di GROUP BY image_id"""


def _smoothed() -> str:
    """The screen of a coverage in 16 bits that is blurred over 11 pixels each way, transparent ones left out, with sums of 32 bits."""
    k = [struct.unpack("f", struct.pack("f", math.exp(-(i * i) / (2 * 1.4 * 1.4))))[0] for i in range(-5, 6)]
    line = lambda c, by, over: " + ".join(f"{w!r}::DOUBLE * {'lag' if i < 0 else 'lead'}({c}, {abs(i)}, 0e0) OVER (PARTITION BY image_id, {over} ORDER BY {by})" for i, w in zip(range(-5, 6), k, strict=True))
    short = lambda x: f"({x})::FLOAT::DOUBLE"
    blur = f"""g0 AS (SELECT *, CASE WHEN a > 0 AND raw > 0 THEN greatest(1e0, least(65535e0, floor(raw * 65535e0 + 0.5e0))) ELSE 0e0 END AS cov, (a > 0)::INT::DOUBLE AS seen FROM c2),
g1 AS (SELECT *, {short(line("cov", "x", "y"))} AS num, {short(line("seen", "x", "y"))} AS den FROM g0),
g2 AS (SELECT *, {line("num", "y", "x")} AS n2, {line("den", "y", "x")} AS d2 FROM g1),
g3 AS (SELECT * REPLACE (CASE WHEN a > 0 AND d2 > 0 THEN greatest(0e0, least(65535e0, floor(n2 / d2 + 0.5e0))) / 65535e0 ELSE 0e0 END AS raw) FROM g2),
"""
    first, _, last = _COV.partition("c3 AS")
    return f"WITH {_ART}, {_PX}, {_PLAIN_REC}, {first}{blur}c3 AS{last.replace('FROM c2)', 'FROM g3)')}{_SCREEN} SELECT image_id, count(*) FILTER (ink) AS ink_pixels, coalesce(sum(CASE WHEN ink THEN x * 64 + y END), 0)::BIGINT AS places FROM s GROUP BY image_id"


#: Why each of sixteen kinds of options is rejected, and the screen of those that aren't.
_ODD = ("NULL", "'number: lpi'", "'boolean: knockout'", "'text: key'", "'range: lpi'", "'range: shape'", "'options'", "'areas'", "'range: garment'", "'areas'", "'text: key'", "'range: presmooth'", "'range: widthCM'", "'boolean: knockout'", "'range: input black and white'", "NULL")
_RECIPE_RULES = f"""WITH {_ART}, k AS (SELECT *, image_id % 16 AS k, (image_id // 50) % 10 = 3 AS old, image_id % 23 = 0 AS bare FROM art),
e AS (SELECT image_id::VARCHAR AS id, CASE WHEN bare THEN '' ELSE p_brand END AS name, CASE WHEN bare THEN 'no name' ELSE CASE k {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_ODD))} END END AS error, CASE k WHEN 0 THEN 30e0 WHEN 15 THEN 40e0 END AS lpi FROM k WHERE NOT old)
SELECT id, name, error, lpi, CASE WHEN lpi IS NOT NULL THEN 12.5e0 END AS height FROM e UNION ALL SELECT NULL, '', 'format', NULL, NULL FROM (SELECT DISTINCT image_id // 50 FROM k WHERE old)"""
_REPORT_FILE = f"""WITH {_JOB}, c AS (SELECT v.id, [v.image, v.size, v.placement, v.status, v.output, '', '', '', '', '300', '', '', '', '', '', coalesce(v.error, '')] AS cells FROM v),
t AS (SELECT id + 1 AS line, '"' || array_to_string(list_transform(cells, lambda x: replace(x, '"', '""')), '","') || '"' AS value FROM c UNION ALL SELECT 0, chr(65279) || 'image,size,placement,status,output,widthCM,heightCM,widthPX,heightPX,dpi,coveragePercent,colorML,whiteML,cost,whiteOutput,error')
SELECT line, value, (SELECT sum(strlen(value) + 2) FROM t)::BIGINT AS bytes FROM t"""

ORACLE_SQL: dict[str, str] = {
    "tile_process": _PROCESS,
    "white_layer": _white(3, 9),
    "pores": _PORES,
    "openings": _OPENINGS,
    "smoothed": _smoothed(),
    "ink_cost": _ALL
    + """, n AS (SELECT image_id, any_value(width) AS w, any_value(height) AS h, count(*) FILTER (ink) AS ink_pixels, count(*) FILTER (raw >= 0.5e0 AND a > 0) AS solid_pixels FROM s GROUP BY image_id),
o AS (SELECT *, ink_pixels / (w * h)::DOUBLE * 100e0 AS cov, ink_pixels / (w * h)::DOUBLE AS f, greatest(ink_pixels, solid_pixels) / (w * h)::DOUBLE AS q, (w / 300e0 * 2.54e0) * (h / 300e0 * 2.54e0) AS area FROM n)
SELECT image_id, ink_pixels, 0::BIGINT AS protected_pixels, solid_pixels, round(cov, 6) AS coverage_percent, round(area * f / 10000e0 * 8e0, 9) AS color_ml, round(area * f / 10000e0 * 8e0 * 90e0 / 1000e0 + area * f / 10000e0 * 12e0 * 60e0 / 1000e0 + area / 10000e0 * 3e0, 9) AS total_cost,
CASE WHEN q > 0 THEN round((1e0 - f / q) * 100e0, 6) END AS savings_percent FROM o""",
    "ink_by_recipe": _ALL + "SELECT recipe_id, count(*) FILTER (ink) AS ink, " + ", ".join(f"sum({_print(c)})::BIGINT AS sum_{c}" for c in "rgb") + ", sum(CASE WHEN ink THEN x * 31 + y ELSE 0 END)::BIGINT AS place_hash FROM s GROUP BY recipe_id",
    "shapes_by_image": f"WITH {_ART}, {_PX}, {_LOOKUP}, sh AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN 'ellipse' ELSE 'euclidean' END AS shape FROM px), {_threshold('sh', '30e0', '300e0 / 30e0')} "
    "SELECT image_id, count(*) FILTER (a > 0 AND a / 255e0 >= 0.03e0 AND (a = 255 OR a / 255e0 > th)) AS ink, round(sum(th), 6) AS thresholds FROM th GROUP BY image_id",
    "tone_response": f"WITH {_ART}, {_LOOKUP}, gr AS (SELECT DISTINCT ['round', 'euclidean', 'ellipse', 'square', 'diamond', 'line'][image_id % 6 + 1] AS shape, p_size * 2e0 AS tone FROM art), "
    f"pt2 AS (SELECT * FROM gr, (SELECT unnest(range(48)) AS x), (SELECT unnest(range(48)) AS y)), {_threshold('pt2', '45e0', '300e0 / 25e0')} SELECT shape, 25e0 AS lpi, tone, round(avg(CASE WHEN tone / 100e0 > th THEN 1e0 ELSE 0e0 END), 9) AS printed FROM th GROUP BY shape, tone",
    "gain_compensation": _GAIN,
    "gain_parse": _GAIN_PARSE,
    "option_rules": _RULES,
    "trim": f"WITH {_ART}, {_PX}, k AS (SELECT * FROM px WHERE (x + y) % 5 > 1) SELECT image_id, min(x) AS \"left\", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, NULL::VARCHAR AS error FROM k WHERE a > 0 GROUP BY image_id",
    "composites": f"WITH {_ART}, {_PX} SELECT image_id, " + ", ".join([f"sum({_over(c, 'a', _BOARD)})::BIGINT AS board_{c}" for c in "rgb"] + [f"sum({_over(c, 'a', k)})::BIGINT AS over_{c}" for c, k in zip("rgb", ("18", "52", "86"), strict=True)]) + " FROM px GROUP BY image_id",
    "previews": _previews(),
    "turned_white": f"WITH {_ART}, {_PX}, t AS (SELECT image_id, height - 1 - y AS x, x AS y, a >= 128 AS ink FROM px) SELECT image_id, max(x) AS max_x, max(y) AS max_y, "
    + ", ".join(f"sum({v} * (x + 1) + y)::BIGINT AS {n}" for n, v in {"blackOnWhite_grey": "(CASE WHEN ink THEN 0 ELSE 255 END)", "blackOnWhite_a": "255", "alpha_grey": "(CASE WHEN ink THEN 255 ELSE 0 END)", "alpha_a": "(CASE WHEN ink THEN 255 ELSE 0 END)", "whiteOnBlack_grey": "(CASE WHEN ink THEN 255 ELSE 0 END)", "whiteOnBlack_a": "255"}.items())
    + " FROM t GROUP BY image_id",
    "edge_protection": f"WITH {_ART}, {_PX}, {_REC}, {_COV}, e AS (SELECT DISTINCT p.image_id, p.x, p.y FROM c3 p, (VALUES (-1), (0), (1)) dx(dx), (VALUES (-1), (0), (1)) dy(dy) JOIN px q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy "
    "WHERE p.a >= 250 AND p.value > 0 AND (dx <> 0 OR dy <> 0) AND (q.a < 128 OR (q.a >= 250 AND sqrt(((p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b))::DOUBLE) >= 96))) SELECT image_id, count(*) AS protected, sum(x * 64 + y)::BIGINT AS places FROM e GROUP BY image_id",
    "masks": _ALL + f", i AS (SELECT image_id, x, y FROM s WHERE ink), k AS ({_NEAR.format(p='i', q='i')}), a AS (SELECT image_id, count(*) AS screened FROM i GROUP BY image_id), f AS (SELECT image_id, count(*) AS final FROM k GROUP BY image_id) "
    "SELECT image_id, screened, coalesce(final, 0)::BIGINT AS final, (screened - coalesce(final, 0))::BIGINT AS removed FROM a LEFT JOIN f USING (image_id)",
    "tile_roundtrip": f"WITH {_ART}, {_PX} SELECT image_id, count(*) AS pixels, sum(r * (x + 1))::BIGINT AS r, sum(g * (y + 1))::BIGINT AS g, sum(b + a)::BIGINT AS ba FROM px WHERE a > 0 GROUP BY image_id",
    "crops": f"WITH {_ART}, {_PX}, k AS (SELECT * FROM px WHERE a > 0 AND x >= 5 AND x < width - 3 AND y >= 3 AND y < height - 4) SELECT image_id, count(*) AS pixels, sum(r * (x - 4))::BIGINT AS r, sum(a * (y - 2))::BIGINT AS a FROM k GROUP BY image_id",
    "tile_audit": f"WITH {_ART} SELECT image_id, tile_y, tile_x, CASE WHEN image_id % 11 = 0 THEN 'missing' WHEN image_id % 9 = 0 THEN 'length' WHEN image_id % 7 = 0 THEN 'hash' ELSE 'none' END AS problem "
    "FROM art, (SELECT unnest(range(3))::INT AS tile_x), (SELECT unnest(range(2))::INT AS tile_y) WHERE tile_x * 16 < width AND tile_y * 16 < height",
    "resampled": _RESAMPLED,
    "thumbnail_sums": _SMALL,
    "checksums": _FNV,
    "brand_mockups": _MOCKUP,
    "print_plans": _PLANS,
    "variant_sizes": _VARIANT_SIZES,
    "derived_sizes": _DERIVED,
    "file_names": _NAMES,
    "job_variants": f"WITH {_JOB} SELECT id, image_idx, size, placement, garment, recipe_id, status, output, error FROM v",
    "job_preflight": _PREFLIGHT,
    "job_manifest": _MANIFEST,
    "recipe_files": _RECIPES,
    "recipe_rules": _RECIPE_RULES,
    "report_file": _REPORT_FILE,
    "latest_state": _STATE + "SELECT * FROM l",
    "state_summary": _STATE + "SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) AS \"all\" FROM l",
    "job_resume": _RESUME,
    "source_identity": f"WITH {_ART} SELECT name || image_id AS name, image_id % 10 <> 0 AND (image_id % 8 = 0 OR image_id % 4 <> 0) AS same FROM art",
    "export_checks": f"WITH {_ART}, e AS (SELECT image_id::VARCHAR AS output, CASE WHEN image_id % 13 = 0 THEN 'missing' WHEN image_id % 7 = 0 THEN 'alpha' WHEN image_id % 5 = 0 THEN 'empty' WHEN image_id % 3 = 0 THEN 'size' WHEN dpi = 72 THEN 'resolution' END AS problem FROM art) SELECT output, problem IS NULL AS ok, problem FROM e",
    "ink_sentences": _SENTENCES,
    "sheet_copies": f"WITH {_ITEMS}, c AS (SELECT * FROM it WHERE copies BETWEEN 1 AND 999) SELECT job_id, sum(copies)::BIGINT AS pieces, max(greatest(w, h)) AS longest, sum(w::BIGINT * h * copies)::BIGINT AS area, sum(copies * (copies + 1) // 2)::BIGINT AS copies FROM c GROUP BY job_id",
    "sheet_rules": _SHEET_RULES,
    "debounced": _DEBOUNCED,
    "stream_requests": _DEBOUNCED,
    "stream_state": _STATE + "SELECT * FROM l",
}

#: Where pieces of a job can be placed at all, none is lost, overlaps another or leaves its sheet. Width 58 cm, spacing 6 mm, margin 5 mm; orders with a multiple of 97 ask for 5 cm.
_PACKED = f"""WITH {_ITEMS}, c AS (SELECT *, job_id % 97 <> 0 AND least(w, h) + 2 * 59 <= 6850 AS fits FROM it WHERE copies BETWEEN 1 AND 999)
SELECT job_id, sum(copies)::BIGINT AS pieces, coalesce(sum(copies) FILTER (fits), 0)::BIGINT AS placed, coalesce(sum(w::BIGINT * h * copies) FILTER (fits), 0)::BIGINT AS area, 0::BIGINT AS overlaps, 0::BIGINT AS outside, coalesce(sum(copies) FILTER (fits), 0)::BIGINT * 8 AS marks FROM c GROUP BY job_id"""

#: A batch: variants, trimmed boxes of recipe 2, straight lines between source pixels (all art grows), coverage and screen at the new size, names.
_BATCH = (
    f"""WITH {_ART}, {_PX.replace("px AS", "px0 AS", 1)}, src AS (SELECT * FROM px0 WHERE a > 0 AND (image_id % 31 <> 0 OR x >= 32)),
ar(placement, size, aw, ah) AS (VALUES ('neck', 'S', 0.5e0, 0.4e0), ('neck', 'M', 0.52e0, 0.42e0), ('front', 'S', 0.54e0, 0.4e0), ('front', 'M', 0.5e0, 0.45e0)),
f AS (SELECT *, CASE WHEN image_id % 4 = 0 THEN ['S', 'M'] ELSE ['S'] END AS ss, CASE WHEN image_id % 4 = 0 THEN ['front', 'neck'] ELSE ['neck'] END AS pp FROM art),
g1 AS (SELECT *, unnest(range(1, len(ss) + 1)) AS si FROM f), g2 AS (SELECT *, unnest(range(1, len(pp) + 1)) AS pi FROM g1),
v0 AS (SELECT row_number() OVER (ORDER BY image_id, si, pi) - 1 AS id, image_id, name AS image, ss[si] AS size, pp[pi] AS placement, recipe_id, width, height, ss[si] || '/' || {_name("image_id", "name", "ss[si]", "pp[pi]")} AS output FROM g2),
bb AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM src GROUP BY image_id),
v1 AS (SELECT v0.*, aw, ah, CASE WHEN recipe_id = 2 THEN x0 ELSE 0 END AS fx, CASE WHEN recipe_id = 2 THEN y0 ELSE 0 END AS fy, CASE WHEN recipe_id = 2 THEN x1 - x0 ELSE width END AS w, CASE WHEN recipe_id = 2 THEN y1 - y0 ELSE height END AS h,
  CASE WHEN image_id % 29 = 0 THEN 'no source' WHEN recipe_id = 4 THEN 'white format' END AS bad FROM v0 JOIN ar USING (placement, size) LEFT JOIN bb USING (image_id)),
v2 AS (SELECT *, greatest(1, floor(w * least(aw / w, ah / h) / 2.54e0 * 300e0 + 0.5e0))::BIGINT AS ow FROM v1), v AS (SELECT *, greatest(1, floor(ow * h / w::DOUBLE + 0.5e0))::BIGINT AS oh FROM v2),
ax AS (SELECT id, o, greatest(0e0, least(w - 1e0, (o + 0.5e0) * (w / ow::DOUBLE) - 0.5e0)) AS f, w FROM v, (SELECT unnest(range(70)) AS o) WHERE o < ow AND bad IS NULL),
ay AS (SELECT id, o, greatest(0e0, least(h - 1e0, (o + 0.5e0) * (h / oh::DOUBLE) - 0.5e0)) AS f, h FROM v, (SELECT unnest(range(70)) AS o) WHERE o < oh AND bad IS NULL),
wx AS (SELECT id, o, floor(f)::INT AS p, 1e0 - (f - floor(f)) AS q FROM ax UNION ALL SELECT id, o, least(w - 1, floor(f)::INT + 1), f - floor(f) FROM ax),
wy AS (SELECT id, o, floor(f)::INT AS p, 1e0 - (f - floor(f)) AS q FROM ay UNION ALL SELECT id, o, least(h - 1, floor(f)::INT + 1), f - floor(f) FROM ay),
sv AS (SELECT v.id, src.x - fx AS x, src.y - fy AS y, r, g, b, a / 255e0 AS a FROM v JOIN src USING (image_id) WHERE bad IS NULL),
t AS (SELECT sv.id, wx.o AS x, wy.o AS y, sum(a * wx.q * wy.q) AS sa, sum(r * a * wx.q * wy.q) AS sr, sum(g * a * wx.q * wy.q) AS sg, sum(b * a * wx.q * wy.q) AS sb FROM sv JOIN wx ON wx.id = sv.id AND wx.p = sv.x JOIN wy ON wy.id = sv.id AND wy.p = sv.y GROUP BY ALL),
px AS (SELECT t.id AS image_id, x::INT AS x, y::INT AS y, ow AS width, oh AS height, recipe_id, floor(round(sr / sa, 9) + 0.5e0)::INT AS r, floor(round(sg / sa, 9) + 0.5e0)::INT AS g, floor(round(sb / sa, 9) + 0.5e0)::INT AS b, least(255, floor(round(sa * 255e0, 9) + 0.5e0))::INT AS a FROM t JOIN v USING (id) WHERE sa > 0),
{_REC}, {_COV}{_SCREEN},
n AS (SELECT image_id AS id, count(*) FILTER (ink) AS ink FROM s GROUP BY image_id),
tk AS (SELECT output AS name FROM v WHERE id % 7 = 0), tw AS (SELECT output AS name FROM v WHERE id % 5 = 0),
e AS (SELECT v.*, coalesce(ink, 0) / (ow * oh)::DOUBLE AS cov, CASE WHEN bad IS NOT NULL THEN bad WHEN coalesce(ink, 0) = 0 THEN 'empty' END AS error, output IN (SELECT name FROM tk) OR (recipe_id IN (1, 2) AND output IN (SELECT name FROM tw)) AS there FROM v LEFT JOIN n USING (id)),
k AS (SELECT *, CASE WHEN error IS NULL AND there THEN regexp_replace(output, '\\.png$', '_r2.png') ELSE output END AS own, (ow / 300e0 * 2.54e0) * (oh / 300e0 * 2.54e0) * cov / 10000e0 * 8e0 AS ml FROM e)
SELECT id, image, size, placement, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, own AS output, CASE WHEN w IS NOT NULL AND bad IS DISTINCT FROM 'no source' THEN ow END AS "widthPX", CASE WHEN w IS NOT NULL AND bad IS DISTINCT FROM 'no source' THEN oh END AS "heightPX",
CASE WHEN error IS NULL THEN round(cov * 100e0, 2) END AS "coveragePercent", CASE WHEN error IS NULL THEN round(ml, 3) END AS "colorML", CASE WHEN error IS NULL AND recipe_id IN (0, 2) THEN round(ml * CASE recipe_id WHEN 0 THEN 90e0 ELSE 45.5e0 END / 1000e0, 3) END AS cost,
CASE WHEN error IS NULL AND recipe_id IN (1, 2) THEN regexp_replace(own, '\\.png$', '_blanco.png') END AS "whiteOutput", error FROM k"""
)

_BOOSTED = (
    _ALL
    + f""", o AS (SELECT image_id, ink, {", ".join(f"CASE WHEN m > 0 THEN floor(least(255e0, greatest(0e0, ({c} - (1e0 - m) * key) / m)) + 0.5e0) ELSE {c} END::DOUBLE AS {c}" for c in "rgb")} FROM s),
l AS (SELECT *, 30e0 / 100e0 * ((1e0 - (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255e0) * (1e0 - (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) / 255e0)) AS lift FROM o),
x AS (SELECT image_id, ink, {", ".join(f"{c} + (255e0 - {c}) * lift AS {c}" for c in "rgb")} FROM l), y AS (SELECT *, (r + g + b) / 3e0 AS mean FROM x)
SELECT image_id, {", ".join(f"sum(CASE WHEN ink THEN floor(least(255e0, greatest(0e0, mean + ({c} - mean) * (1e0 + 20e0 / 100e0))) + 0.5e0) ELSE 0 END)::BIGINT AS sum_{c}" for c in "rgb")} FROM y GROUP BY image_id"""
)

#: For a wanted tone the value on the inverse curve, in whole percent.
_SUMMARIES = f"""WITH {_ART}, knots(k, m, n) AS (VALUES (0, 0e0, 0e0), (0, 14e0, 10e0), (0, 41e0, 30e0), (0, 63e0, 50e0), (0, 80e0, 70e0), (0, 94e0, 90e0), (0, 100e0, 100e0), (1, 0e0, 0e0), (1, 40e0, 25e0), (1, 70e0, 50e0), (1, 90e0, 75e0), (1, 100e0, 100e0), (2, 0e0, 0e0), (2, 100e0, 100e0)),
seg AS (SELECT k, lag(m) OVER w AS m0, m AS m1, lag(n) OVER w AS n0, n AS n1 FROM knots WINDOW w AS (PARTITION BY k ORDER BY m)),
t AS (SELECT k, d, round(n0 + (n1 - n0) * (d - m0) / (m1 - m0))::INT AS v FROM (SELECT unnest([10, 30, 50, 70, 90]) AS d) JOIN seg ON d > m0 AND d <= m1),
u AS (SELECT k, string_agg(v::VARCHAR, ',' ORDER BY d) AS summary FROM t GROUP BY k)
SELECT image_id, summary FROM art JOIN u ON k = image_id % 3"""

_AUDIT = f"""WITH {_JOB}, n AS (SELECT count(*) AS n FROM v), e AS (SELECT event_id % 5000 < n AND event_id % 10 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS valid FROM events, n)
SELECT count(*) AS records, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM e"""

ORACLE_SQL |= {"boosted_colors": _BOOSTED, "gain_summaries": _SUMMARIES, "journal_audit": _AUDIT, "batch_run": _BATCH, "ink_cost_pixels": ORACLE_SQL["ink_cost"], "tile_composites": ORACLE_SQL["composites"], "sheet_checks": _PACKED}
