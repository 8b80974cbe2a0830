"""Steps of the block transform coder, as relational texts over px and im."""

import math

from pixelloom.operators.color import GRAY

#: The standard luminance table of the JPEG specification, in natural order.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_table = "CASE k " + " ".join(f"WHEN {k} THEN {q}" for k, q in enumerate(LUMA)) + " END"


def scaled(quality: str) -> str:
    """The table at a quality from 1 to 100."""
    share = f"CASE WHEN {quality} < 50 THEN 5000 DIV {quality} ELSE 200 - 2 * {quality} END"
    return f"greatest(1, least(255, ({_table} * ({share}) + 50) DIV 100))"


QUANT_TABLE = f"SELECT k, quality, CAST({scaled('quality')} AS INT) AS q FROM (SELECT k, EACH[1; 100] AS quality FROM (SELECT EACH[0; 63] AS k) a) b"

_coefficients = f"(SELECT image_id, x, y, k, v, {scaled('75')} AS q FROM (SELECT image_id, x, y, (y % 8) * 8 + x % 8 AS k, (r - 128) * 8 + g AS v FROM {{px}}) c)"
_level = "CASE WHEN v < 0 THEN -((abs(v) * (1048576 DIV (8 * q)) + 524288) >> 20) ELSE (abs(v) * (1048576 DIV (8 * q)) + 524288) >> 20 END"
QUANTIZE = f"SELECT image_id, x, y, CAST({_level} AS INT) AS level FROM {_coefficients} t"
DEQUANTIZE = f"SELECT image_id, x, y, CAST(({_level}) * q AS INT) AS v2 FROM {_coefficients} t"

#: sqrt(2) cos(k pi / 16) in units of 2^-13 with the roundings of the usual whole-number transform; one row per frequency.
INTEGER_BASIS = (
    (8192, 8192, 8192, 8192, 8192, 8192, 8192, 8192),
    (11363, 9633, 6437, 2260, -2260, -6437, -9633, -11363),
    (10703, 4433, -4433, -10703, -10703, -4433, 4433, 10703),
    (9633, -2259, -11362, -6436, 6436, 11362, 2259, -9633),
    (8192, -8192, -8192, 8192, 8192, -8192, -8192, 8192),
    (6437, -11362, 2261, 9633, -9633, -2261, 11362, -6437),
    (4433, -10704, 10704, -4433, -4433, 10704, -10704, 4433),
    (2260, -6436, 9633, -11363, 11363, -9633, 6436, -2260),
)
_basis = "(VALUES " + ", ".join(f"({u}, {x}, {c})" for u, row in enumerate(INTEGER_BASIS) for x, c in enumerate(row)) + ") AS t(u, x, c)"


#: The same by formula: cosines of the exact transform in units of 2^-12, halved, so that two passes need one rounding at their end.
COSINES = tuple(tuple(round(2048 * (0.5**0.5 if u == 0 else 1.0) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)) for u in range(8))
_cosines = "(VALUES " + ", ".join(f"({u}, {x}, {c})" for u, row in enumerate(COSINES) for x, c in enumerate(row)) + ") AS t(u, x, c)"


def integer_pass(source: str, along: str, frequency: bool, shift: int, basis: str = _basis) -> str:
    """One pass over (image_id, col, line, y, x, v): a join with 64 fixed rows and a sum, rounded, whose index takes the place of ``along``."""
    across = "y" if along == "x" else "x"
    at, to = ("u", "x") if frequency else ("x", "u")
    total = f"(CAST(sum(s.v * t.c) AS BIGINT) + {1 << (shift - 1)}) >> {shift}" if shift else "CAST(sum(s.v * t.c) AS BIGINT)"
    return f"(SELECT s.image_id, s.col, s.line, s.{across} AS {across}, t.{to} AS {along}, {total} AS v FROM {source} s JOIN {basis} ON s.{along} = t.{at} GROUP BY s.image_id, s.col, s.line, s.{across}, t.{to})"


def inverse(source: str, first: str = "x") -> str:
    """Coefficients to samples: rows first, or columns."""
    return integer_pass(integer_pass(source, first, True, 11), "y" if first == "x" else "x", True, 18)


_ID = "image_id, col, line"
#: The 8x8 blocks of each image's gray levels, cells beyond its edge taken from the last row and column.
BLOCKS = f"""(SELECT d.image_id, d.col, d.line, d.y, d.x, {GRAY.replace("r +", "p.r +").replace("* g", "* p.g").replace("* b", "* p.b")} AS v FROM (
  SELECT image_id, w, h, col, line, y, EACH[0; 7] AS x FROM (SELECT image_id, w, h, col, line, EACH[0; 7] AS y FROM (
    SELECT image_id, w, h, col, EACH[0; CAST((h - 1) DIV 8 AS INT)] AS line FROM (SELECT image_id, w, h, EACH[0; CAST((w - 1) DIV 8 AS INT)] AS col FROM {{im}}) i) j) k) d
  JOIN {{px}} p ON p.image_id = d.image_id AND p.x = least(d.col * 8 + d.x, d.w - 1) AND p.y = least(d.line * 8 + d.y, d.h - 1))"""
EDGE_REPLICATE = f"SELECT image_id, CAST(col * 8 + x AS INT) AS x, CAST(line * 8 + y AS INT) AS y, CAST(v AS INT) AS v FROM {BLOCKS} e"
_shifted = f"(SELECT {_ID}, y, x, v - 128 AS v FROM {BLOCKS} e)"
_forward = integer_pass(integer_pass(_shifted, "x", False, 11), "y", False, 15)
_levels = f"(SELECT {_ID}, y, x, q, CAST({_level} AS INT) AS level FROM (SELECT {_ID}, y, x, v, {scaled('75').replace('CASE k', 'CASE y * 8 + x')} AS q FROM {_forward} f) f)"
_quantised = f"(SELECT {_ID}, y, x, q * level AS v FROM {_levels} l)"
_sample = "CAST(greatest(0, least(255, v + 128)) AS INT) AS v"
FDCT_INTEGER = f"SELECT {_ID}, y, x, CAST(v AS INT) AS v FROM {_forward} f"
IDCT_INTEGER = f"SELECT {_ID}, y, x, {_sample} FROM {inverse(_quantised)} f"
IDCT_INTEGER_COLUMNS = f"SELECT {_ID}, y, x, {_sample} FROM {inverse(_quantised, 'y')} f"
_exact = integer_pass(integer_pass(_quantised, "x", True, 0, _cosines), "y", True, 24, _cosines)
IDCT_FLOAT = f"SELECT {_ID}, y, x, {_sample} FROM {_exact} f"
_near = inverse(f"(SELECT {_ID}, y, x, (v + 4) >> 3 AS v FROM {_forward} f)")
INTEGER_ROUND_TRIP = f"SELECT a.image_id, count(*) AS n, CAST(max(abs(a.v - b.v)) AS BIGINT) AS furthest FROM {_shifted} a JOIN {_near} b ON a.image_id = b.image_id AND a.col = b.col AND a.line = b.line AND a.x = b.x AND a.y = b.y GROUP BY a.image_id"

#: Differences of the blocks' first levels, in the order of blocks.
DC_DIFF = f"SELECT {_ID}, CAST(level - coalesce(lag(level) OVER (PARTITION BY image_id ORDER BY line, col), 0) AS INT) AS diff FROM {_levels} l WHERE x = 0 AND y = 0"

#: The place of a cell in the order of diagonals: those of an even sum upwards, of an odd one downwards.
_d, _along = "(x + y)", "(CASE WHEN (x + y) % 2 = 0 THEN x ELSE y END)"
ZIGZAG = f"(CASE WHEN {_d} < 8 THEN {_d} * ({_d} + 1) DIV 2 + {_along} ELSE 64 - (15 - {_d}) * (16 - {_d}) DIV 2 + {_along} - ({_d} - 7) END)"
ZIGZAG_ORDER = f"SELECT y, x, CAST({ZIGZAG} AS INT) AS k FROM (SELECT y, EACH[0; 7] AS x FROM (SELECT EACH[0; 7] AS y) a) b"

#: Symbols of the levels after the first in that order: run of zeros and size, with 16 zeros as symbols of their own before, and the end of a block that closes with zeros.
_size = "CAST(floor(log2(CAST(abs(level) AS DOUBLE))) AS INT) + 1"
_runs = f"(SELECT {_ID}, k, level, k - coalesce(lag(k) OVER (PARTITION BY image_id, col, line ORDER BY k), 0) - 1 AS run FROM (SELECT {_ID}, CAST({ZIGZAG} AS INT) AS k, level FROM {_levels} l) z WHERE k > 0 AND level <> 0)"
AC_SYMBOLS = f"""SELECT {_ID}, k, CAST(run DIV 16 AS INT) AS sixteens, CAST((run % 16) * 16 + {_size} AS INT) AS symbol, CAST(CASE WHEN level < 0 THEN level - 1 + (1 << ({_size})) ELSE level END AS INT) AS bits FROM {_runs} r
UNION ALL SELECT {_ID}, 64 AS k, 0 AS sixteens, 0 AS symbol, 0 AS bits FROM (SELECT {_ID}, max(CASE WHEN level <> 0 THEN CAST({ZIGZAG} AS INT) ELSE 0 END) AS last FROM {_levels} l GROUP BY {_ID}) e WHERE last < 63"""
