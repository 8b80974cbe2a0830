"""WebP: stills by the system's libwebp where it can be loaded; the container, and with it animations, here."""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from functools import lru_cache

import numpy as np

ANIMATED, WITH_ALPHA = 0x02, 0x10
#: Of a frame: the canvas is cleared after it; it replaces what is there.
CLEARED, REPLACES = 0x01, 0x02
MOST_SIDE = 16383


@lru_cache(maxsize=1)
def library() -> ctypes.CDLL:
    try:
        lib = ctypes.CDLL(ctypes.util.find_library("webp") or "libwebp.so.7")
    except OSError as e:
        raise ValueError("WebP codec unavailable: no libwebp") from e
    number, address = ctypes.c_int, ctypes.c_void_p
    lib.WebPDecodeRGBA.restype, lib.WebPDecodeRGBA.argtypes = address, [ctypes.c_char_p, ctypes.c_size_t, ctypes.POINTER(number), ctypes.POINTER(number)]
    lib.WebPEncodeRGBA.restype, lib.WebPEncodeRGBA.argtypes = ctypes.c_size_t, [ctypes.c_char_p, number, number, number, ctypes.c_float, ctypes.POINTER(address)]
    lib.WebPEncodeLosslessRGBA.restype, lib.WebPEncodeLosslessRGBA.argtypes = ctypes.c_size_t, [ctypes.c_char_p, number, number, number, ctypes.POINTER(address)]
    lib.WebPFree.restype, lib.WebPFree.argtypes = None, [address]
    return lib


def available() -> bool:
    try:
        library()
    except ValueError:
        return False
    return True


def rgba(image: np.ndarray) -> np.ndarray:
    image = image[:, :, None] if image.ndim == 2 else image
    colours = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image
    return colours if colours.shape[2] == 4 else np.concatenate([colours, np.full((*colours.shape[:2], 1), 255, np.uint8)], axis=2)


def encode(image: np.ndarray, quality: float = 75, lossless: bool = False) -> bytes:
    """Gray, RGB or RGBA. Lossless keeps every pixel but the colours of wholly transparent ones."""
    if not 0 <= quality <= 100:
        raise ValueError("quality not between 0 and 100")
    h, w = image.shape[:2]
    if not 0 < w <= MOST_SIDE or not 0 < h <= MOST_SIDE:
        raise ValueError(f"size not between 1 and {MOST_SIDE}")
    lib, out, raw = library(), ctypes.c_void_p(), rgba(image).astype(np.uint8).tobytes()
    n = lib.WebPEncodeLosslessRGBA(raw, w, h, 4 * w, ctypes.byref(out)) if lossless else lib.WebPEncodeRGBA(raw, w, h, 4 * w, quality, ctypes.byref(out))
    if not n:
        raise ValueError("WebP could not be encoded")
    try:
        return ctypes.string_at(out, n)
    finally:
        lib.WebPFree(out)


def still(data: bytes) -> np.ndarray:
    lib, w, h = library(), ctypes.c_int(), ctypes.c_int()
    pixels = lib.WebPDecodeRGBA(data, len(data), ctypes.byref(w), ctypes.byref(h))
    if not pixels:
        raise ValueError("broken WebP")
    try:
        return np.frombuffer(ctypes.string_at(pixels, 4 * w.value * h.value), np.uint8).reshape(h.value, w.value, 4)
    finally:
        lib.WebPFree(pixels)


# The container.


def chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def file_of(chunks: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WEBP" + chunks


def chunks_of(data: bytes, at: int = 0) -> list[tuple[bytes, bytes]]:
    found = []
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if at + 8 + n > len(data):
            raise ValueError("WebP ends early")
        found.append((kind, data[at + 8 : at + 8 + n]))
        at += 8 + n + n % 2
    return found


def three(*numbers: int) -> bytes:
    return b"".join(struct.pack("<I", n)[:3] for n in numbers)


def head(w: int, h: int, flags: int) -> bytes:
    return chunk(b"VP8X", bytes([flags, 0, 0, 0]) + three(w - 1, h - 1))


def images_of(data: bytes, at: int) -> list[tuple[bytes, bytes]]:
    return [(kind, part) for kind, part in chunks_of(data, at) if kind in (b"ALPH", b"VP8 ", b"VP8L")]


def animation(frames: list[np.ndarray], durations_ms: list[int], loops: int = 0, quality: float = 75, lossless: bool = False) -> bytes:
    """Frames of one size, each in place of the one before, for 10 ms at least; one frame makes a still."""
    if not frames or len(frames) != len(durations_ms):
        raise ValueError("no frames, or not as many durations")
    if len({f.shape[:2] for f in frames}) > 1:
        raise ValueError("frames of several sizes")
    files = [encode(f, quality, lossless) for f in frames]
    if len(files) == 1:
        return files[0]
    h, w = frames[0].shape[:2]
    clear = any(f.ndim == 3 and f.shape[2] == 4 and bool((f[:, :, 3] < 255).any()) for f in frames)
    out = head(w, h, ANIMATED | WITH_ALPHA * clear) + chunk(b"ANIM", struct.pack("<IH", 0, min(max(loops, 0), 65535)))
    for one, ms in zip(files, durations_ms, strict=True):
        shown = three(0, 0, w - 1, h - 1, min(max(ms, 10), (1 << 24) - 1)) + bytes([CLEARED | REPLACES])
        out += chunk(b"ANMF", shown + b"".join(chunk(*c) for c in images_of(one, 12)))
    return file_of(out)


def blended(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """One RGBA image over another, not premultiplied."""
    a, b = above[:, :, 3:] / 255.0, below[:, :, 3:] / 255.0
    whole = a + b * (1 - a)
    mixed = (above[:, :, :3] * a + below[:, :, :3] * b * (1 - a)) / np.where(whole > 0, whole, 1)
    return np.floor(np.concatenate([mixed, whole * 255], axis=2) + 0.5).astype(np.uint8)


def decode_frames(data: bytes, most: int | None = None) -> list[tuple[np.ndarray, int]]:
    """(RGBA canvas, duration in ms) of each frame; a still has one, of no duration."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    top = data[12:21]
    if top[:4] != b"VP8X" or len(top) < 9 or not top[8] & ANIMATED:
        return [(still(data), 0)]
    canvas, found = None, []
    for kind, part in chunks_of(data, 12):
        if kind == b"VP8X" and len(part) >= 10:
            w, h = (int.from_bytes(part[k : k + 3], "little") + 1 for k in (4, 7))
            if w > MOST_SIDE or h > MOST_SIDE:
                raise ValueError("canvas too large")
            canvas = np.zeros((h, w, 4), np.uint8)
        elif kind == b"ANMF" and canvas is not None and (most is None or len(found) < most):
            if len(part) < 16:
                raise ValueError("frame ends early")
            x, y, fw, fh, ms = (int.from_bytes(part[k : k + 3], "little") for k in range(0, 15, 3))
            flags, chunks = part[15], images_of(part, 16)
            body = b"".join(chunk(*c) for c in chunks)
            image = still(file_of((head(fw + 1, fh + 1, WITH_ALPHA) if chunks and chunks[0][0] == b"ALPH" else b"") + body))
            place = canvas[2 * y : 2 * y + image.shape[0], 2 * x : 2 * x + image.shape[1]]
            if place.shape != image.shape:
                raise ValueError("frame beyond the canvas")
            place[:] = image if flags & REPLACES else blended(image, place)
            found.append((canvas.copy(), ms))
            if flags & CLEARED:
                place[:] = 0
    if not found:
        raise ValueError("animation without frames")
    return found


def decode(data: bytes) -> np.ndarray:
    """RGBA; of an animation the first frame."""
    return decode_frames(data, 1)[0][0]
