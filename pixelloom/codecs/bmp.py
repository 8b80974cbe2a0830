"""BMP: 8-bit gray and 24-bit out; 8, 16, 24 and 32 bits in. Images are arrays of rows, columns and channels."""

from __future__ import annotations

import struct

import numpy as np

DEFAULT_PPM = 2835


def encode(image: np.ndarray, ppm: int = DEFAULT_PPM, ppm_y: int | None = None) -> bytes:
    """Bottom-up rows of 4-byte multiples: one byte a pixel with a gray palette, or blue, green, red. Pixels a metre are the same both ways unless ``ppm_y`` is given."""
    h, w = image.shape[:2]
    gray = image.ndim == 2
    rows = image[::-1] if gray else image[::-1, :, 2::-1]
    body = np.zeros((h, -(-w * (1 if gray else 3) // 4) * 4), np.uint8)
    body[:, : w * (1 if gray else 3)] = rows.reshape(h, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4) * np.array([1, 1, 1, 0], np.uint8) if gray else np.zeros(0, np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if gray else 24, 0, body.size, ppm, ppm if ppm_y is None else ppm_y, 256 if gray else 0, 0)
    return head + palette.tobytes() + body.tobytes()


def metadata(data: bytes) -> dict:
    """Pixels a metre across and down, where the file gives them."""
    x, y = struct.unpack_from("<ii", data, 38) if len(data) >= 54 else (0, 0)
    return {k: v for k, v in (("ppm", x), ("ppm_y", y)) if v > 0}


def scaled(values: np.ndarray, mask: int) -> np.ndarray:
    """A masked field, spread over 0 to 255."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return ((((values & mask) >> shift).astype(np.int64) * 255 + (top >> 1)) // top).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Red, green and blue; alpha is dropped."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    start, size, w, h, planes, bits, compression, _, _, _, used = struct.unpack_from("<I IiiHHIIiiI", data, 10)
    if size < 40 or planes != 1 or w <= 0 or h == 0 or compression not in (0, 3, 6) or bits not in (8, 16, 24, 32):
        raise ValueError("unsupported BMP header")
    top_down, h = h < 0, abs(h)
    masks = struct.unpack_from("<III", data, 54) if compression else (0x7C00, 0x3E0, 0x1F)
    step = -(-w * bits // 32) * 4
    if start + step * h > len(data):
        raise ValueError("BMP ends early")
    rows = np.frombuffer(data, np.uint8, step * h, start).reshape(h, step)
    rows = rows if top_down else rows[::-1]
    if bits == 8:
        palette = np.zeros((256, 4), np.uint8)
        quads = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)
        palette[: len(quads)] = quads
        index = rows[:, :w]
        return palette[np.where(index < len(quads), index, 0)][:, :, 2::-1]
    if bits == 24:
        return rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1]
    if bits == 32 and not compression:
        return rows.reshape(h, w, 4)[:, :, 2::-1]
    values = np.ascontiguousarray(rows[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").reshape(h, w)
    if bits == 16 and not compression:
        parts = [(values >> s) & 31 for s in (10, 5, 0)]
        return np.stack([(p << 3) | (p >> 2) for p in parts], axis=2).astype(np.uint8)
    return np.stack([scaled(values, m) for m in masks], axis=2)
