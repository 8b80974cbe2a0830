import numpy as np

from pixelloom.codecs import bmp, png
from pixelloom.sources import images
from pixelloom.streaming import convert


def test_scan_decode_encode(spark, tmp_path):
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PNG").write_bytes(png.encode(image))
    (tmp_path / "in/b.png").write_bytes(bmp.encode(image))
    (tmp_path / "in/c.gif").write_bytes(b"junk")
    (tmp_path / "in/d.txt").write_bytes(b"text")
    rows = {r.path[-5:]: r for r in images.decoded(images.scan(spark, str(tmp_path / "in"))).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.PNG": "ok", "b.png": "ok", "c.gif": "failed"}
    assert rows["b.png"].fmt == "bmp" and bytes(rows["b.png"].buf) == image.tobytes()
    again = images.encoded(images.decoded(images.scan(spark, str(tmp_path / "in"))), "bmp").collect()
    assert all((bmp.decode(bytes(r.content)) == image).all() for r in again) and len(again) == 2


def test_stream(spark, tmp_path):
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bmp").write_bytes(bmp.encode(image))
    convert.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert (png.decode(bytes(spark.read.parquet(str(tmp_path / "out")).first().content)) == image).all()


def test_raster_operators():
    import pytest

    from pixelloom.operators import raster

    checker = np.array([[[100, 110, 120], [200, 210, 220]], [[200, 210, 220], [100, 110, 120]]], np.uint8)
    assert raster.resize(checker, 1, 1).tolist() == [[[150, 160, 170]]]
    assert raster.grayscale(np.array([[[10, 200, 50]]], np.uint8)).tolist() == [[[125] * 3]]
    assert raster.resize_to_fit(np.zeros((200, 400, 3), np.uint8), 320, 240).shape == (160, 320, 3)
    assert raster.resize_to_fit(np.zeros((400, 200, 3), np.uint8), 320, 240).shape == (240, 120, 3)
    ramp = raster.resize(np.tile(np.array([[0, 100, 200]], np.uint8)[:, :, None], (3, 1, 3)), 6, 6)
    assert (np.diff(ramp[:, :, 0].astype(int), axis=1) >= 0).all()
    from pixelloom.operators.geometry import ORIENTATIONS

    image = np.arange(18, dtype=np.uint8).reshape(3, 2, 3)
    for n, (fx, fy) in ORIENTATIONS.items():
        got = raster.oriented(image, n)
        for y in range(3):
            for x in range(2):
                at = {"x": x, "y": y, "w": 2, "h": 3}
                assert (got[eval(fy, at.copy()), eval(fx, at.copy())] == image[y, x]).all()
    with pytest.raises(ValueError):
        raster.operation("resize:axb")


def test_convert(spark, tmp_path):
    from pixelloom.plans.convert import convert

    (tmp_path / "in").mkdir()
    image = np.arange(96, dtype=np.uint8).reshape(4, 8, 3)
    (tmp_path / "in/a.png").write_bytes(png.encode(image))
    (tmp_path / "in/b.bmp").write_bytes(b"BM")
    out = str(tmp_path / "out")
    assert {r.status: r.n for r in convert(spark, str(tmp_path / "in"), out, "bmp", ("resizefit:4x4", "grayscale")).collect()} == {"ok": 1, "failed": 1}
    assert bmp.decode(bytes(spark.read.parquet(out).first().content)).shape == (2, 4, 3)
    assert {r.status: r.n for r in convert(spark, str(tmp_path / "in"), out, "bmp", skip_existing=True).collect()} == {"failed": 1}


def test_frames_and_gray(spark, tmp_path):
    from pixelloom.codecs import gif, jpeg
    from pixelloom.plans.convert import convert

    (tmp_path / "in").mkdir()
    image = np.arange(96, dtype=np.uint8).reshape(4, 8, 3)
    (tmp_path / "in/a.b.gif").write_bytes(gif.encode([image, image[::-1]], [20, 40]))
    (tmp_path / "in/c.png").write_bytes(png.encode(image))
    (tmp_path / "in/d.webp").write_bytes(b"junk")
    rows = sorted(images.frames(images.scan(spark, str(tmp_path / "in"))).collect(), key=lambda r: (r.path, r.frame))
    assert [(r.name, r.duration_ms, r.status) for r in rows] == [("a.b_000", 20, "ok"), ("a.b_001", 40, "ok"), ("c_000", 0, "ok"), (None, None, "failed")]
    assert (np.frombuffer(bytes(rows[1].buf), np.uint8).reshape(4, 8, -1)[:, :, :3] == image[::-1]).all()
    out = str(tmp_path / "out")
    assert {r.status: r.n for r in convert(spark, str(tmp_path / "in"), out, "jpeg", gray=True, quality=100).collect()} == {"ok": 2, "failed": 1}
    stored = [jpeg.parse(bytes(r.content)) for r in spark.read.parquet(out).collect()]
    assert [(len(h.components), h.width, h.height) for h in stored] == [(1, 8, 4)] * 2


def test_convert_to_files(spark, tmp_path):
    """Names are those of the sources, numbered where they are taken; nothing is overwritten; encoders' errors stop nothing."""
    from pixelloom.codecs import bmp, png
    from pixelloom.plans.convert import convert

    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    for folder in ("in/a", "in/b"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.bmp").write_bytes(bmp.encode(image))
    (tmp_path / "in/a/y.png").write_bytes(png.encode(image))
    files, out = tmp_path / "files", str(tmp_path / "out")
    files.mkdir()
    (files / "y.png").write_bytes(b"mine")
    told = convert(spark, str(tmp_path / "in"), out, "png", recursive=True, skip_existing=True, files=str(files))
    assert [tuple(r) for r in told.collect()] == [("ok", 3)]
    assert sorted(p.name for p in files.iterdir()) == ["x (1).png", "x.png", "y (1).png", "y.png"]
    assert (files / "y.png").read_bytes() == b"mine" and (png.decode((files / "x (1).png").read_bytes()) == image).all()
    assert convert(spark, str(tmp_path / "in"), out, "png", recursive=True, skip_existing=True).count() == 0

    def refuses(image):
        raise ValueError("no")

    images.register("refused", encoder=refuses)
    try:
        assert [tuple(r) for r in convert(spark, str(tmp_path / "in"), str(tmp_path / "none"), "refused", recursive=True).collect()] == [("failed", 3)]
    finally:
        del images.ENCODERS["refused"]
