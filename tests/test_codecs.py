"""Codecs by exact round trips, hand-built bytes and the JVM's own readers."""

import struct
import zlib

import numpy as np
import pytest

from pixelloom.codecs import bmp, gif, png

rng = np.random.default_rng(1)
SIZES = [(1, 1), (2, 3), (3, 5), (9, 7), (33, 20)]


@pytest.mark.parametrize("size", SIZES)
def test_bmp(size):
    rgb, gray = rng.integers(0, 256, (*size, 3), dtype=np.uint8), rng.integers(0, 256, size, dtype=np.uint8)
    assert (bmp.decode(bmp.encode(rgb)) == rgb).all()
    assert (bmp.decode(bmp.encode(gray)) == gray[:, :, None]).all()


def test_bmp_masks():
    head = struct.pack("<2sIHHI", b"BM", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0)
    assert bmp.decode(head + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + b"\x11\x22\x33\0").tolist() == [[[17, 34, 51]]]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("channels", [3, 4])
def test_png(size, channels):
    image = rng.integers(0, 256, (*size, channels), dtype=np.uint8)
    assert (png.decode(png.encode(image), channels == 4, check=True) == image).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8).astype(int)
    flat = image.reshape(6, -1)
    body = b""
    for y in range(6):
        line = []
        for i, v in enumerate(flat[y]):
            a, b, c = (flat[y, i - 3] if i >= 3 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i >= 3 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        body += bytes([kind, *line])
    data = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(body)) + png.chunk(b"IEND", b"")
    assert (png.decode(data) == image).all()


def test_png_interlaced_palette():
    w, h, index = 11, 9, rng.integers(0, 4, (9, 11), dtype=np.uint8)
    palette = rng.integers(0, 256, (4, 3), dtype=np.uint8)
    body = b""
    for x, y, dx, dy in png.PASSES:
        for row in index[y::dy, x::dx]:
            if len(row):
                bits = np.unpackbits(row[:, None], axis=1)[:, 6:].reshape(-1)
                body += b"\0" + np.packbits(bits).tobytes()
    data = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 2, 3, 0, 0, 1)) + png.chunk(b"PLTE", palette.tobytes()) + png.chunk(b"tRNS", b"\0\x80") + png.chunk(b"IDAT", zlib.compress(body)) + png.chunk(b"IEND", b"")
    got = png.decode(data, alpha=True)
    assert (got[:, :, :3] == palette[index]).all() and (got[:, :, 3] == np.array([0, 128, 255, 255])[index]).all()


def test_jvm_reads_png_and_bmp(spark, tmp_path):
    image = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    (tmp_path / "b.bmp").write_bytes(bmp.encode(image))
    for row in spark.read.format("image").load(str(tmp_path)).select("image.data").collect():
        assert (np.frombuffer(row.data, np.uint8).reshape(5, 4, 3)[:, :, ::-1] == image).all()


@pytest.mark.parametrize("n", [1, 2, 5, 700, 20_000])
def test_lzw(n):
    for colours, bits in ((2, 2), (256, 8)):
        values = rng.integers(0, colours, n, dtype=np.uint8).tobytes()
        assert gif.lzw_decode(gif.lzw_encode(values, bits), bits, n) == values


def test_gif_animation():
    frames = [rng.integers(0, 4, (7, 5, 3), dtype=np.uint8) * 60 for _ in range(3)]
    got = gif.decode(gif.encode(frames, [20, 300, 0]))
    assert [d for _, d in got] == [20, 300, 10]
    assert all((a[:, :, :3] == b).all() for (a, _), b in zip(got, frames, strict=True))
    mask = np.concatenate([frames[0], np.where(frames[0][:, :, :1] > 60, 255, 0).astype(np.uint8)], axis=2)
    assert (gif.decode(gif.encode([mask]))[0][0][:, :, 3] == mask[:, :, 3]).all()


@pytest.mark.parametrize("dither", [False, True])
def test_gif_of_many_colours(dither):
    y, x = np.mgrid[0:40, 0:48]
    image = np.stack([x * 255 // 47, y * 255 // 39, (x + y) * 255 // 86], axis=2).astype(np.uint8)
    got = gif.decode(gif.encode([image], dither=dither))[0][0][:, :, :3]
    assert len(np.unique(got.reshape(-1, 3), axis=0)) <= 256
    assert ((got.astype(int) - image) ** 2).mean() < 100
    assert np.abs(got.reshape(-1, 3).mean(axis=0) - image.reshape(-1, 3).mean(axis=0)).max() < 2


def test_gif_alpha_with_many_colours():
    image = rng.integers(0, 256, (20, 30, 4), dtype=np.uint8)
    assert ((gif.decode(gif.encode([image]))[0][0][:, :, 3] > 0) == (image[:, :, 3] >= 128)).all()
