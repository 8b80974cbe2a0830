"""Resampling, as relational texts over px, by image over im. A destination of fixed size stands in for any: DST_W and DST_H are put in.

``EACH[a; b]`` makes a row for each whole number from a to b, within the task that holds the row.
"""

DST = "(SELECT image_id, w, h, dx, EACH[0; DST_H - 1] AS dy FROM (SELECT image_id, w, h, EACH[0; DST_W - 1] AS dx FROM {im}) i)"

#: Mean by overlap, in whole numbers, halves rounded up: each source pixel goes to the few destinations that it overlaps.
AREA = """SELECT image_id, dx, dy, CAST((2 * sum(r * ox * oy) + max(w * h)) DIV (2 * max(w * h)) AS INT) AS r2, CAST((2 * sum(g * ox * oy) + max(w * h)) DIV (2 * max(w * h)) AS INT) AS g2, CAST((2 * sum(b * ox * oy) + max(w * h)) DIV (2 * max(w * h)) AS INT) AS b2 FROM (
  SELECT image_id, w, h, dx, dy, r, g, b,
    least((dx + 1) * w, (x + 1) * DST_W) - greatest(dx * w, x * DST_W) AS ox,
    least((dy + 1) * h, (y + 1) * DST_H) - greatest(dy * h, y * DST_H) AS oy
  FROM (SELECT image_id, w, h, x, y, r, g, b, dx, EACH[CAST(y * DST_H DIV h AS INT); CAST(((y + 1) * DST_H - 1) DIV h AS INT)] AS dy FROM (
    SELECT image_id, w, h, x, y, r, g, b, EACH[CAST(x * DST_W DIV w AS INT); CAST(((x + 1) * DST_W - 1) DIV w AS INT)] AS dx FROM {px}) i) j) o
GROUP BY image_id, dx, dy"""

FX = "CAST(CAST(dx AS FLOAT) * CAST(CAST(w - 1 AS FLOAT) / CAST(DST_W - 1 AS FLOAT) AS FLOAT) AS FLOAT)"
FY = "CAST(CAST(dy AS FLOAT) * CAST(CAST(h - 1 AS FLOAT) / CAST(DST_H - 1 AS FLOAT) AS FLOAT) AS FLOAT)"

#: Corners aligned, weights of 11 bits: four taps a destination, met with their pixels in one join.
BILINEAR = "SELECT t.image_id, t.dx, t.dy, " + ", ".join(f"CAST((sum(p.{c} * t.weight) + 2097152) >> 22 AS INT) AS {c}2" for c in "rgb") + f""" FROM (
  SELECT image_id, dx, dy, least(x0 + i, w - 1) AS tx, least(y0 + j, h - 1) AS ty, (CASE WHEN i = 0 THEN 2048 - wx ELSE wx END) * (CASE WHEN j = 0 THEN 2048 - wy ELSE wy END) AS weight FROM (
    SELECT image_id, w, h, dx, dy, x0, y0, wx, wy, i, EACH[0; 1] AS j FROM (
      SELECT image_id, w, h, dx, dy, x0, y0, CAST(floor((fx - x0) * 2048 + 0.5) AS BIGINT) AS wx, CAST(floor((fy - y0) * 2048 + 0.5) AS BIGINT) AS wy, EACH[0; 1] AS i FROM (
        SELECT image_id, w, h, dx, dy, {FX} AS fx, {FY} AS fy, CAST(floor({FX}) AS INT) AS x0, CAST(floor({FY}) AS INT) AS y0 FROM {DST} q) s) k) l) t
JOIN {{px}} p ON p.image_id = t.image_id AND p.x = t.tx AND p.y = t.ty GROUP BY t.image_id, t.dx, t.dy"""


def cubic(t: str, unit: str) -> str:
    """Keys' kernel at a = -1/2 of t/unit, times 2 * unit^3: whole numbers."""
    a = f"abs({t})"
    return f"CASE WHEN {a} <= {unit} THEN 3 * {a} * {a} * {a} - 5 * {a} * {a} * {unit} + 2 * {unit} * {unit} * {unit} WHEN {a} < 2 * {unit} THEN -{a} * {a} * {a} + 5 * {a} * {a} * {unit} - 8 * {a} * {unit} * {unit} + 4 * {unit} * {unit} * {unit} ELSE 0 END"


CX, CY = "(((2 * dx + 1) * w - DST_W) - 2 * DST_W * sx)", "(((2 * dy + 1) * h - DST_H) - 2 * DST_H * sy)"
WX, WY = cubic(CX, "(2 * DST_W)"), cubic(CY, "(2 * DST_H)")

_level = "CAST(greatest(0, least(255, (2 * total_{c} + unit) DIV (2 * unit))) AS INT) AS {c}2"
#: Half-pixel centres, taps clamped to the edge. Weights are exact fractions, so any order of summation gives the same.
BICUBIC = "SELECT image_id, dx, dy, " + ", ".join(_level.format(c=c) for c in "rgb") + " FROM (SELECT t.image_id, dx, dy, " + ", ".join(f"CAST(sum(p.{c} * CAST(wx AS BIGINT) * wy) AS BIGINT) AS total_{c}" for c in "rgb") + f""", CAST(4 AS BIGINT) * (2 * DST_W) * (2 * DST_W) * (2 * DST_W) * (2 * DST_H) * (2 * DST_H) * (2 * DST_H) AS unit FROM (
    SELECT image_id, dx, dy, greatest(0, least(w - 1, sx)) AS tx, greatest(0, least(h - 1, sy)) AS ty, CAST({WX} AS BIGINT) AS wx, CAST({WY} AS BIGINT) AS wy FROM (
      SELECT image_id, w, h, dx, dy, CAST(floor(((2 * dx + 1) * w - DST_W) / CAST(2 * DST_W AS DOUBLE)) AS INT) - 1 + i AS sx, CAST(floor(((2 * dy + 1) * h - DST_H) / CAST(2 * DST_H AS DOUBLE)) AS INT) - 1 + j AS sy
      FROM (SELECT image_id, w, h, dx, dy, i, EACH[0; 3] AS j FROM (SELECT image_id, w, h, dx, dy, EACH[0; 3] AS i FROM {DST} q) e) f) s) t
  JOIN {{px}} p ON p.image_id = t.image_id AND p.x = tx AND p.y = ty GROUP BY t.image_id, dx, dy) u"""

FIT = """SELECT image_id, greatest(1, CAST(bround(w * s, 0) AS INT)) AS fw, greatest(1, CAST(bround(h * s, 0) AS INT)) AS fh FROM (
  SELECT image_id, w, h, least(CAST(32 AS DOUBLE) / w, CAST(24 AS DOUBLE) / h) AS s FROM {im}) f"""

#: The blue difference of each pixel, as in color.PROJECTIONS.
CB = "(((-43 * {p}.r - 85 * {p}.g + 128 * {p}.b) >> 8) + 128)"
_cb = {p: CB.replace("{p}", p) for p in "bcdef"}

CHROMA_NEAREST = f"SELECT a.image_id, a.x, a.y, {_cb['b']} AS cb FROM {{px}} a JOIN {{px}} b ON a.image_id = b.image_id AND b.x = a.x DIV 2 AND b.y = a.y DIV 2"

#: Halves of a plane put between: weights 3/4 and 1/4 as 192 and 64 of 256, in both directions.
CHROMA_LINEAR = f"""SELECT a.image_id, a.x, a.y, CAST(((((({_cb['c']} * 192 + {_cb['d']} * 64 + 128) >> 8) * 192 + (({_cb['e']} * 192 + {_cb['f']} * 64 + 128) >> 8) * 64 + 128) >> 8)) AS INT) AS cb FROM (
  SELECT image_id, x, y, x DIV 2 AS x0, y DIV 2 AS y0, greatest(0, least((w - 1) DIV 2, x DIV 2 + CASE WHEN x % 2 = 0 THEN -1 ELSE 1 END)) AS x1, greatest(0, least((h - 1) DIV 2, y DIV 2 + CASE WHEN y % 2 = 0 THEN -1 ELSE 1 END)) AS y1 FROM {{px}}) a
JOIN {{px}} c ON c.image_id = a.image_id AND c.x = a.x0 AND c.y = a.y0 JOIN {{px}} d ON d.image_id = a.image_id AND d.x = a.x1 AND d.y = a.y0
JOIN {{px}} e ON e.image_id = a.image_id AND e.x = a.x0 AND e.y = a.y1 JOIN {{px}} f ON f.image_id = a.image_id AND f.x = a.x1 AND f.y = a.y1"""
