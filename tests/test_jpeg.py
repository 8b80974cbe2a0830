"""JPEG against the JVM's reader and writer, hand-built streams and broken ones."""

import struct

import numpy as np
import pytest

from pixelloom.codecs import jpeg

rng = np.random.default_rng(3)


def ramp(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([40 + x * 150 // max(1, w - 1), 50 + y * 140 // max(1, h - 1), 60 + (x + y) * 120 // max(1, w + h - 2)], axis=2).astype(np.uint8)


def near(a, b, most, mean):
    differ = np.abs(a.astype(int) - b.astype(int))
    assert a.shape == b.shape and differ.max() <= most and differ.mean() <= mean


def halved_chroma(image):
    """What is left of an image, apart from quantisation, when each 2 x 2 pixels share their chroma."""
    r, g, b = np.moveaxis(image.astype(float), 2, 0)
    luma, out = 0.299 * r + 0.587 * g + 0.114 * b, np.zeros(image.shape)
    for y in range(0, len(r), 2):
        for x in range(0, len(r[0]), 2):
            at = np.s_[y : y + 2, x : x + 2]
            cb, cr = (np.pad(v, ((0, 2 - len(v)), (0, 2 - len(v[0]))), mode="edge").mean() for v in ((b - luma)[at] / 1.772, (r - luma)[at] / 1.402))
            out[at] = np.stack([luma[at] + 1.402 * cr, luma[at] - 0.344136 * cb - 0.714136 * cr, luma[at] + 1.772 * cb], axis=2)
    return np.clip(np.round(out), 0, 255)


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (9, 7), (17, 33), (64, 64)])
@pytest.mark.parametrize("subsample", [False, True])
def test_round_trip(size, subsample):
    image = ramp(*size)
    meant = halved_chroma(image) if subsample else image
    near(jpeg.decode(jpeg.encode(image, 95, subsample)), meant, 9, 3)
    gray = image[:, :, 0]
    near(jpeg.decode(jpeg.encode(gray, 100)), np.repeat(gray[:, :, None], 3, axis=2), 3, 1)


def test_noise_and_qualities():
    noise = rng.integers(0, 256, (24, 40, 3), dtype=np.uint8)
    near(jpeg.decode(jpeg.encode(noise, 100, False)), noise, 8, 2.5)
    sizes = [len(jpeg.encode(noise, q)) for q in (0, 1, 25, 50, 75, 100, 101)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[1] and sizes[5] == sizes[6]


def test_metadata():
    exif = b"MM\0*\0\0\0\x08\0\1\1\x12\0\3\0\0\0\1\0\6\0\0\0\0\0\0"
    icc = rng.integers(0, 256, 150_000, dtype=np.uint8).tobytes()
    data = jpeg.encode(ramp(6, 9), exif=exif, icc=icc)
    head = jpeg.parse(data, scans=False)
    assert (head.orientation, head.exif, head.icc, head.width, head.height) == (6, exif, icc, 9, 6)
    assert (jpeg.decode(data, upright=True) == jpeg.decode(data).swapaxes(0, 1)[:, ::-1]).all()
    assert [jpeg.orientation_of(x) for x in (b"", b"II", b"II*\0\xff\xff\0\0", exif[:12])] == [1] * 4


@pytest.mark.parametrize("size", [(1, 1), (7, 19), (33, 18)])
@pytest.mark.parametrize("subsample", [False, True, None])
def test_progressive_equals_baseline(size, subsample):
    image = rng.integers(0, 256, (*size, 3), dtype=np.uint8)
    options = {"subsample": bool(subsample)}
    image = image[:, :, 0] if subsample is None else image
    data = jpeg.encode(image, 80, progressive=True, **options)
    assert jpeg.parse(data, scans=False).progressive
    assert (jpeg.decode(data) == jpeg.decode(jpeg.encode(image, 80, **options))).all()


def test_jvm_reads_progressive(spark, tmp_path):
    data = jpeg.encode(ramp(19, 26), 90, False, progressive=True)
    (tmp_path / "p.jpg").write_bytes(data)
    read = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(tmp_path / "p.jpg")))
    pixels = np.array([[read.getRGB(x, y) & 0xFFFFFF for x in range(26)] for y in range(19)])
    near(np.stack([pixels >> 16, pixels >> 8 & 255, pixels & 255], axis=2), jpeg.decode(data), 4, 3)


def test_components_out_of_order():
    """Planes stored as 3, 1, 2 are read as 1, 2, 3; unknown names stay in their order."""
    image = ramp(8, 8)
    data = jpeg.encode(image, 100, subsample=False)
    at = data.index(b"\xff\xc0") + 10
    scan = data.index(b"\xff\xda") + 5
    frame = [data[at + 3 * k : at + 3 * k + 3] for k in range(3)]
    stored = data[:at] + frame[1] + frame[2] + frame[0] + data[at + 9 :]
    assert (jpeg.decode(stored) == jpeg.decode(data)).all()
    renamed = bytearray(data)
    for k in range(3):
        renamed[at + 3 * k] = renamed[scan + 2 * k] = 40 + k
    assert (jpeg.decode(bytes(renamed)) == jpeg.decode(data)).all()


def test_exact_cosines_are_near_whole_numbers():
    image = ramp(20, 30)
    whole, exact = jpeg.encode(image, 95, False), jpeg.encode(image, 95, False, integer=False)
    near(jpeg.decode(whole), jpeg.decode(whole, integer=False), 4, 1)
    near(jpeg.decode(exact, integer=False), image, 16, 3)


@pytest.mark.parametrize("block", [1, 2, 13, 1 << 16])
def test_stream(block):
    import io

    image = rng.integers(0, 256, (30, 20, 3), dtype=np.uint8)
    for progressive in (False, True):
        data = jpeg.encode(image, 95, exif=b"\xff\xd9" * 20, icc=b"\xff\xd8\xff" * 30_000, progressive=progressive)
        stream = io.BytesIO(data + jpeg.encode(image[:5]))
        assert (jpeg.decode_stream(stream, block) == jpeg.decode(data)).all() and stream.tell() < len(data) + block
    with pytest.raises(ValueError):
        jpeg.decode_stream(io.BytesIO(data[:-500]), block)


def test_restarts():
    one = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([1]) * 64) + jpeg.segment(0xC0, struct.pack(">BHHB", 8, 16, 8, 1) + b"\1\x11\0")
    one += b"".join(jpeg.segment(0xC4, bytes([kind << 4]) + bytes([1]) + bytes(15) + b"\0") for kind in (0, 1))
    data = one + jpeg.segment(0xDD, b"\0\1") + jpeg.segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x3f\xff\xd0\x3f\xff\xd9"
    assert (jpeg.decode(data) == 128).all()


@pytest.mark.parametrize("change", [
    lambda d: b"", lambda d: d[:2], lambda d: d[:-40], lambda d: b"\0" + d,
    lambda d: d.replace(b"\xff\xda", jpeg.segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + b"\1\x11\0") + b"\xff\xda"),
    lambda d: d.replace(struct.pack(">HH", 20, 30), b"\xff\xff\xff\xff"),
])
def test_broken(change):
    data = change(jpeg.encode(ramp(20, 30)))
    with pytest.raises(ValueError):
        jpeg.decode(data)


def test_flipped_bits_only_raise_value_errors():
    data = jpeg.encode(ramp(20, 30))
    for _ in range(150):
        broken = bytearray(data)
        for at in rng.integers(0, len(data) * 8, 3):
            broken[at // 8] ^= 1 << at % 8
        try:
            jpeg.decode(bytes(broken))
        except ValueError:
            pass


def jvm_image(spark, image):
    jvm = spark._jvm
    out = jvm.java.awt.image.BufferedImage(image.shape[1], image.shape[0], 1)
    for y, row in enumerate(image.astype(int)):
        for x, (r, g, b) in enumerate(row.tolist()):
            out.setRGB(x, y, r << 16 | g << 8 | b)
    return out


def test_jvm_reads_ours(spark, tmp_path):
    image = ramp(19, 26)
    for name, data in (("420", jpeg.encode(image, 90)), ("444", jpeg.encode(image, 90, False))):
        path = tmp_path / f"{name}.jpg"
        path.write_bytes(data)
        read = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(path)))
        pixels = np.array([[read.getRGB(x, y) & 0xFFFFFF for x in range(26)] for y in range(19)])
        near(np.stack([pixels >> 16, pixels >> 8 & 255, pixels & 255], axis=2), jpeg.decode(data), 40 if name == "420" else 4, 3)


@pytest.mark.parametrize("progressive", [False, True])
def test_we_read_the_jvms(spark, tmp_path, progressive):
    image, jvm = ramp(40, 53), spark._jvm
    image[10:20, 10:30] = 255 - image[10:20, 10:30]
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)
    settings.setCompressionQuality(0.9)
    if progressive:
        settings.setProgressiveMode(1)
    path = tmp_path / "a.jpg"
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(jvm_image(spark, image), None, None), settings)
    stream.close()
    data = path.read_bytes()
    assert jpeg.parse(data, scans=False).progressive == progressive
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(path)))
    pixels = np.array([[read.getRGB(x, y) & 0xFFFFFF for x in range(53)] for y in range(40)])
    near(np.stack([pixels >> 16, pixels >> 8 & 255, pixels & 255], axis=2), jpeg.decode(data), 60, 2)


@pytest.mark.parametrize("adobe", [None, 0, 2])
@pytest.mark.parametrize("chroma", [128, 0])
def test_four_inks(adobe, chroma):
    """Flat blocks of one DC value: the second component 128 or 0, the others 128."""
    data = b"\xff\xd8" + (jpeg.segment(0xEE, b"Adobe\0\x64\0\0\0\0" + bytes([adobe])) if adobe is not None else b"")
    data += jpeg.segment(0xDB, b"\0" + bytes([1]) * 64) + jpeg.segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 4) + b"".join(bytes([i, 0x11, 0]) for i in range(1, 5)))
    data += jpeg.segment(0xC4, b"\0" + bytes([1, 1]) + bytes(14) + b"\0\x0b") + jpeg.segment(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\0")
    second = "10" + format(-1024 + 2047, "011b") if chroma == 0 else "0"
    bits = "00" + second + "0" + "00" + "00"
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    data += jpeg.segment(0xDA, bytes([4]) + b"".join(bytes([i, 0]) for i in range(1, 5)) + b"\0\x3f\0") + body + b"\xff\xd9"
    got = jpeg.decode(data)
    inks = [128, chroma, 128]
    if adobe == 2:
        inks = [int(v) for v in jpeg.colours(*(np.array(x) for x in inks))]
    assert (got == np.array([(x * 128 + 127) // 255 for x in inks])).all()


def test_linear_chroma_is_nearer_on_a_ramp():
    x, y = np.meshgrid(np.arange(64), np.arange(64))
    image = np.stack([40 + x * 150 // 63, 50 + y * 140 // 63, 60 + (x + y) * 120 // 126], axis=2).astype(np.uint8)
    data = jpeg.encode(image, 95, subsample=True)
    error = [((jpeg.decode(data, linear=linear).astype(int) - image) ** 2).mean() for linear in (False, True)]
    assert error[1] < error[0] < 60
    odd = image[:61, :63]
    assert jpeg.decode(jpeg.encode(odd, 95, subsample=True), linear=True).shape == odd.shape
    gray = jpeg.encode(image[:, :, 0], 95)
    assert (jpeg.decode(gray, linear=True) == jpeg.decode(gray)).all()


def test_doubling_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        half = rng.integers(0, 256, ((n + 1) // 2, 3))
        want = [(half[i // 2] * 192 + half[min(max(i // 2 + (1 if i % 2 else -1), 0), (n - 1) // 2)] * 64 + 128) >> 8 for i in range(n)]
        assert (jpeg.doubled(half, n, 0) == np.array(want)).all()
