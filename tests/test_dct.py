"""The whole-number block transform against the exact one."""

import re

import numpy as np

from pixelloom.codecs.jpeg import COSINES
from pixelloom.operators import dct
from pixelloom.operators.dct import INTEGER_BASIS
from pixelloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_basis_is_the_cosines():
    assert np.abs(np.array(INTEGER_BASIS) - COSINES * 8192 * 8**0.5).max() < 1.5


def test_forward_is_near_the_exact_transform(spark):
    """Both blocks of a 12 x 8 image; the second is filled up from the last column."""
    gray = lambda x: min(x, 11) * 255 // 11
    rows = [(1, 12, 8, x, y, gray(x), gray(x), gray(x)) for y in range(8) for x in range(12)]
    px = spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, r int, g int, b int")
    text = re.sub(r"EACH\[(.+?); (.+?)\]", r"explode(sequence(\1, \2))", dct.FDCT_INTEGER)
    got = np.zeros((2, 8, 8))
    for row in spark.sql(text, px=px, im=px.select("image_id", "w", "h").distinct()).collect():
        got[row["col"], row["y"], row["x"]] = row["v"]
    for col in range(2):
        block = np.array([[gray(8 * col + x) - 128 for x in range(8)]] * 8)
        assert np.abs(got[col] - 8 * (COSINES @ block @ COSINES.T)).max() < 2


def test_zigzag_goes_along_the_diagonals(spark):
    cells = {(r.y, r.x): r.k for r in catalog.QUERIES["zigzag_order"](spark, DATA).collect()}
    order = sorted(cells, key=cells.get)
    assert sorted(cells.values()) == list(range(64)) and order[:7] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3)] and order[-1] == (7, 7)
    assert all(abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1 for a, b in zip(order, order[1:]))


def test_float_and_integer_inverse_are_near(spark):
    one, other = ({tuple(r[:5]): r.v for r in catalog.QUERIES[q](spark, DATA).select("image_id", "col", "line", "y", "x", "v").collect()} for q in ("idct8x8_float", "idct8x8_int"))
    assert one.keys() == other.keys() and max(abs(one[k] - other[k]) for k in one) <= 1


def test_inverse_gives_the_samples_back(spark):
    found = catalog.QUERIES["fdct_idct_furthest"](spark, DATA).collect()
    assert found and all(r["n"] % 64 == 0 and r["furthest"] <= 2 for r in found)
