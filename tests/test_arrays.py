"""Operators of whole images: the rows of their texts, also for images that share an id or have none, and no pixels at the driver."""

import duckdb
import numpy as np
import pytest

from pixelloom.codecs import jpeg
from pixelloom.functions import seeds
from pixelloom.plans import catalog

DATA = "/root/testdata/sf0.001"
WHOLE = [
    "chroma_up_linear",
    "palette_join",
    "palette_trns",
    "plane_interleave",
    "idct8x8_columns_first",
    "idct8x8_float",
    "idct8x8_int",
    "sub_rectangle",
    "wu_moments",
    "resize_bicubic",
    "ac_symbols",
    "dc_diff",
    "edge_replicate",
    "fdct8x8",
    "resize_bilinear",
    "fdct_idct_furthest",
    "chroma_up_nearest",
    "four_channel_guess",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Images with an id of their own, one below zero too; two and three that share one, alike and not; without an id or a size."""
    folder = str(tmp_path_factory.mktemp("odd"))
    sizes = {1: [5], 2: [50, 50], 3: [7, 31], 4: [12], 5: [1, 20, 20], -7: [33], -8: [34], 9: [None], 10: [None, 8], None: [6, 9]}
    spark.createDataFrame([(key, size) for key, found in sizes.items() for size in found], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", [*WHOLE, "jpeg_stream_equals_array"])
def test_odd_images_as_the_oracle_has_them(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{odd}/part.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, odd)
    columns = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name]).select(*columns).fetchall()
    assert want and sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def broadcast(plan: str) -> list[str]:
    """What stands below each broadcast of a plan."""
    lines, found = plan.splitlines(), []
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


@pytest.mark.parametrize("name", WHOLE)
def test_pixels_are_not_broadcast(spark, name):
    """Spark takes pixels to be as few as the images, so it would send them to the driver, which 120,000 images fill."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any("Generate" in below for below in broadcast(plan))


def test_planes_are_the_pixels(spark):
    found = {}
    for p in seeds.gradient_pixels(spark, DATA).where("image_id < 60").collect():
        found[p.image_id, p.w, p.h, p.y, p.x] = [p.r, p.g, p.b, p.a]
    for image_id, w, h in {k[:3] for k in found}:
        v = seeds.planes(np.array([image_id]), w, h)[:, 0]
        assert all(v[:, y, x].tolist() == found[image_id, w, h, y, x] for y in range(h) for x in range(w))


def test_huffman_tables_are_kept_between_files():
    """Making the tables of an image of the queries took over half of the time of reading it."""
    found = [jpeg.parse(jpeg.encode(np.full((8, 8, 3), v, np.uint8))).huffman for v in (7, 200)]
    assert found[0].keys() == found[1].keys() == {0, 1, 16, 17} and all(found[0][k] is found[1][k] for k in found[0])
