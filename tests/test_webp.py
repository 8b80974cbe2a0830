"""WebP by libwebp; what the container says is read back by libwebp's own parser."""

import ctypes

import numpy as np
import pytest

from pixelloom.codecs import webp

pytestmark = pytest.mark.skipif(not webp.available(), reason="no libwebp")
rng = np.random.default_rng(5)


def features(data: bytes) -> list[int]:
    """width, height, alpha, animation, as libwebp reads them."""
    out = (ctypes.c_int * 10)()
    assert webp.library().WebPGetFeaturesInternal(ctypes.c_char_p(data), ctypes.c_size_t(len(data)), out, 0x0209) == 0
    return list(out[:4])


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (17, 16)])
@pytest.mark.parametrize("channels", [0, 1, 3, 4])
def test_lossless(size, channels):
    image = rng.integers(1, 256, (*size, channels) if channels else size, dtype=np.uint8)
    assert (webp.decode(webp.encode(image, lossless=True)) == webp.rgba(image)).all()


def test_lossy_is_near_and_grows_with_quality():
    image = np.stack(np.meshgrid(np.arange(64), np.arange(64)), axis=2).repeat(2, axis=2).astype(np.uint8)[:, :, :3] * 3
    got = webp.decode(webp.encode(image, 100))
    assert np.abs(got[:, :, :3].astype(int) - image).mean() < 4 and (got[:, :, 3] == 255).all()
    sizes = [len(webp.encode(image, q)) for q in (0, 50, 100)]
    assert sizes == sorted(sizes)
    for quality in (-1, 101):
        with pytest.raises(ValueError):
            webp.encode(image, quality)


@pytest.mark.parametrize("lossless", [False, True])
@pytest.mark.parametrize("channels", [3, 4])
def test_animation(lossless, channels):
    frames = [rng.integers(1, 256, (8, 6, channels), dtype=np.uint8) for _ in range(3)]
    data = webp.animation(frames, [5, 20, 300], 2, 90, lossless)
    assert features(data) == [6, 8, int(channels == 4), 1]
    got = webp.decode_frames(data)
    assert [ms for _, ms in got] == [10, 20, 300]
    want = [webp.still(webp.encode(f, 90, lossless)) for f in frames]
    assert all((a == b).all() for (a, _), b in zip(got, want, strict=True)) and (webp.decode(data) == want[0]).all()
    assert webp.animation(frames[:1], [5], lossless=lossless) == webp.encode(frames[0], 75, lossless)


def test_places_blending_and_broken_files():
    base, top = np.full((4, 6, 4), 200, np.uint8), np.zeros((2, 2, 4), np.uint8)
    top[0, 0] = (10, 20, 30, 255)
    parts = [b"".join(webp.chunk(*c) for c in webp.images_of(webp.encode(i, lossless=True), 12)) for i in (base, top)]
    body = webp.head(6, 4, webp.ANIMATED | webp.WITH_ALPHA) + webp.chunk(b"ANIM", b"\0" * 6)
    body += webp.chunk(b"ANMF", webp.three(0, 0, 5, 3, 10) + b"\2" + parts[0]) + webp.chunk(b"ANMF", webp.three(1, 1, 1, 1, 10) + b"\0" + parts[1])
    want = base.copy()
    want[2, 2] = (10, 20, 30, 255)
    data = webp.file_of(body)
    assert (webp.decode_frames(data)[1][0] == want).all()
    for broken in (b"", b"RIFF", data[:-9], data[:12], webp.file_of(b"VP8X\1"), webp.encode(base)[:30], webp.file_of(webp.head(6, 4, 2))):
        with pytest.raises(ValueError):
            webp.decode_frames(broken)
    with pytest.raises(ValueError):
        webp.animation([base, top], [1, 2])
