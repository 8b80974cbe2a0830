"""What files tell besides their pixels, through codecs and conversions."""

import zlib

import numpy as np
import pytest

from pixelloom.codecs import bmp, gif, jpeg, png, webp
from pixelloom.plans.convert import convert
from pixelloom.sources import images

rng = np.random.default_rng(3)
IMAGE = rng.integers(0, 256, (4, 8, 3), dtype=np.uint8)
TURNED = {order: head + b"".join(n.to_bytes(size, "little" if order == "II" else "big") for n, size in ((42, 2), (8, 4), (2, 2), (0x0100, 2), (3, 2), (1, 4), (9, 2), (0, 2), (0x0112, 2), (3, 2), (1, 4), (6, 2), (0, 2), (0, 4))) for order, head in (("II", b"II"), ("MM", b"MM"))}
ICC = rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("order", ["II", "MM"])
def test_orientation_is_set(order):
    exif = TURNED[order]
    got = jpeg.set_upright(exif)
    assert (jpeg.orientation_of(exif), jpeg.orientation_of(got)) == (6, 1)
    assert [i for i, (a, b) in enumerate(zip(exif, got, strict=True)) if a != b] == [30 if order == "II" else 31]
    for odd in (b"", b"II", b"XX" + exif[2:], exif[:25], exif[:4] + b"\xff" * 4 + exif[8:]):
        assert jpeg.set_upright(odd) == odd


def test_png():
    assert png.metadata(png.encode(IMAGE)) == {}
    assert png.metadata(png.encode(IMAGE, TURNED["MM"], ICC, True)) == {"exif": TURNED["MM"], "icc": ICC}
    data = png.encode(IMAGE, srgb=True)
    assert png.metadata(data) == {"srgb": True} and (png.decode(data, check=True) == IMAGE).all()
    prefixed = png.SIGNATURE + png.chunk(b"eXIf", b"Exif\0\0" + TURNED["II"]) + png.chunk(b"iCCP", b"x\0\0junk") + png.chunk(b"iCCP", b"none")
    assert png.metadata(prefixed) == {"exif": TURNED["II"]}
    assert png.metadata(png.SIGNATURE + png.chunk(b"iCCP", b"x\0\1" + zlib.compress(ICC))) == {}


def test_bmp():
    assert bmp.metadata(bmp.encode(IMAGE)) == {"ppm": 2835, "ppm_y": 2835}
    assert bmp.metadata(bmp.encode(IMAGE, 100, 200)) == {"ppm": 100, "ppm_y": 200}
    assert bmp.metadata(bmp.encode(IMAGE, 0)) == {} == bmp.metadata(b"BM")


def test_convert_keeps_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(jpeg.encode(IMAGE, 100, False, TURNED["MM"], ICC))
    (tmp_path / "in/b.png").write_bytes(png.encode(IMAGE, TURNED["II"], ICC))
    (tmp_path / "in/c.png").write_bytes(png.encode(IMAGE, srgb=True))
    (tmp_path / "in/d.bmp").write_bytes(bmp.encode(IMAGE, 100, 200))
    (tmp_path / "in/e.gif").write_bytes(b"GIF")

    def made(fmt, **options):
        out = str(tmp_path / (fmt + "_".join(options)))
        told = {r.status: r.n for r in convert(spark, str(tmp_path / "in"), out, fmt, **options).collect()}
        assert told == {"ok": 4, "failed": 1}
        return {r.path[-5:]: bytes(r.content) for r in spark.read.parquet(out).collect()}

    upright = {k: jpeg.set_upright(v) for k, v in TURNED.items()}
    got = made("png", keep_metadata=True)
    assert {k: png.metadata(v) for k, v in got.items()} == {"a.jpg": {"exif": upright["MM"], "icc": ICC}, "b.png": {"exif": upright["II"], "icc": ICC}, "c.png": {"srgb": True}, "d.bmp": {}}
    assert png.decode(got["a.jpg"]).shape == (8, 4, 3)
    got = made("jpeg", keep_metadata=True, operations=("resize:3x3",))
    assert {k: jpeg.metadata(v) for k, v in got.items()} == {"a.jpg": {"exif": upright["MM"], "icc": ICC}, "b.png": {"exif": upright["II"], "icc": ICC}, "c.png": {}, "d.bmp": {}}
    assert {k: bmp.metadata(v).get("ppm_y") for k, v in made("bmp", keep_metadata=True).items()} == {"a.jpg": 2835, "b.png": 2835, "c.png": 2835, "d.bmp": 200}
    assert not any(png.metadata(v) for v in made("png").values())


@pytest.mark.skipif(not webp.available(), reason="no libwebp")
def test_convert_frames(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frames = [IMAGE, IMAGE[::-1], IMAGE[:, ::-1]]
    (tmp_path / "in/a.gif").write_bytes(gif.encode(frames, [20, 40, 60]))
    (tmp_path / "in/b.png").write_bytes(png.encode(IMAGE))
    (tmp_path / "in/c.webp").write_bytes(webp.animation(frames[:2], [30, 50], lossless=True))
    (tmp_path / "in/d.webp").write_bytes(b"RIFF0000WEBPjunk")
    source = str(tmp_path / "in")
    each = str(tmp_path / "each")
    assert {r.status: r.n for r in convert(spark, source, each, "png", frames="each", files=str(tmp_path / "files"), partitions=2).collect()} == {"ok": 6, "failed": 1}
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["a_000.png", "a_001.png", "a_002.png", "b.png", "c_000.png", "c_001.png"]
    assert (png.decode((tmp_path / "files/a_002.png").read_bytes()) == frames[2]).all()
    assert {r.status: r.n for r in convert(spark, source, each, "png", frames="each", skip_existing=True).collect()} == {"failed": 1}
    out = str(tmp_path / "all")
    assert {r.status: r.n for r in convert(spark, source, out, "webp", frames="all", lossless=True).collect()} == {"ok": 3, "failed": 1}
    got = {r.path[-6:]: webp.decode_frames(bytes(r.content)) for r in spark.read.parquet(out).collect()}
    assert [ms for _, ms in got["/a.gif"]] == [20, 40, 60] and all((image[:, :, :3] == f).all() for (image, _), f in zip(got["/a.gif"], frames, strict=True))
    assert len(got["/b.png"]) == 1 and [ms for _, ms in got["c.webp"]] == [30, 50]
    back = str(tmp_path / "back")
    convert(spark, source, back, "gif", frames="all")
    assert [len(gif.decode(bytes(r.content))) for r in spark.read.parquet(back).orderBy("path").collect()] == [3, 1, 2]
    for wrong in ({"frames": "last"}, {"frames": "all"}, {"frames": "each", "keep_metadata": True}):
        with pytest.raises(ValueError):
            convert(spark, source, str(tmp_path / "wrong"), "png", **wrong)


def test_options_of_decoders(spark, tmp_path):
    data = bytearray(png.encode(IMAGE))
    data[29] ^= 1  # of the header's checksum
    (tmp_path / "a.png").write_bytes(data)
    files = images.scan(spark, str(tmp_path))
    assert images.decoded(files).first().status == "ok"
    assert "checksum" in images.decoded(files, options={"png": {"check": True}}).first().error


def test_command(spark, tmp_path, capsys):
    from pixelloom.__main__ import main

    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/a.png").write_bytes(png.encode(IMAGE))
    (tmp_path / "in/b.bmp").write_bytes(b"BM")
    out, files = str(tmp_path / "out"), tmp_path / "files"
    assert main([str(tmp_path / "in"), out, "resizefit:4x4", "grayscale", "--to", ".JPG", "-q", "90", "--subsample", "444", "--recursive", "--files", str(files), "--parallel", "2", "--linear-chroma"], spark) == 1
    assert set(capsys.readouterr().out.split("\n")) == {"ok: 1", "failed: 1", ""}
    head = jpeg.parse((files / "a.jpg").read_bytes())
    assert (head.width, head.height, len(head.components), head.components[0].h) == (4, 2, 3, 1)
    assert main([str(tmp_path / "in/deep"), out, "--skip-existing", "--to", "jpg"], spark) == 0
