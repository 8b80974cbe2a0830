"""PNG: gray, RGB and RGBA of 8 bits out; all colour types, depths and interlacing in."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven interlace passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def parts_of(size: tuple[int, int], interlaced: bool) -> list[tuple[slice, slice]]:
    """Rows and columns of each pass that has pixels."""
    passes = [(x, y, dx, dy) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),)) if y < size[0] and x < size[1]]
    return [(slice(y, None, dy), slice(x, None, dx)) for x, y, dx, dy in passes]


def described(exif: bytes, icc: bytes, srgb: bool) -> bytes:
    """Chunks of metadata that come before the pixels; a profile goes before the mark of sRGB."""
    out = chunk(b"iCCP", b"ICC Profile\0\0" + zlib.compress(icc)) if icc else chunk(b"sRGB", b"\0") if srgb else b""
    return out + (chunk(b"eXIf", exif) if exif else b"")


def encode(image: np.ndarray, exif: bytes = b"", icc: bytes = b"", srgb: bool = False, interlaced: bool = False) -> bytes:
    """Every row is filtered by the row above, in one stream; ``exif`` begins with its TIFF header."""
    h, w = image.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    body = b""
    for part in parts_of((h, w), interlaced):
        rows = image[part].astype(np.uint8)
        rows = rows.reshape(len(rows), -1)
        up = rows.copy()
        up[1:] -= rows[:-1]
        body += np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], axis=1).tobytes()
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, interlaced)) + described(exif, icc, srgb)
    return SIGNATURE + head + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def encode_indexed(index: np.ndarray, palette: np.ndarray, opacity: bytes = b"", interlaced: bool = False) -> bytes:
    """Places in a palette of up to 256 colours, in as few bits as it takes; ``opacity`` is that of its first colours."""
    h, w = index.shape
    depth = next(d for d in (1, 2, 4, 8) if len(palette) <= 1 << d)
    body = b""
    for part in parts_of((h, w), interlaced):
        bits = np.unpackbits(index[part].astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - depth :]
        rows = np.packbits(bits.reshape(len(bits), -1), axis=1)
        body += np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 3, 0, 0, interlaced)) + chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return SIGNATURE + head + (chunk(b"tRNS", opacity) if opacity else b"") + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def metadata(data: bytes) -> dict:
    """``exif`` from its TIFF header on, ``icc`` inflated, ``srgb``: those that the file has. A broken profile is none."""
    found: dict = {}
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"eXIf" and part:
            found["exif"] = part.removeprefix(b"Exif\0\0")
        elif kind == b"iCCP" and (name := part.find(b"\0")) >= 0 and part[name + 1 : name + 2] == b"\0":
            try:
                found["icc"] = zlib.decompress(part[name + 2 :])
            except zlib.error:
                pass
        elif kind == b"sRGB":
            found["srgb"] = True
        elif kind == b"IEND":
            break
    if found.get("icc"):
        found.pop("srgb", None)
    return {k: v for k, v in found.items() if v}


def unfilter(body: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters; those that depend on the byte to the left go byte by byte."""
    out = np.zeros((len(body), body.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(body):
        kind, now = row[0], row[1:].copy()
        if kind == 1:
            for c in range(step):
                now[c::step] = np.cumsum(now[c::step], dtype=np.uint8)
        elif kind == 2:
            now += above
        elif kind in (3, 4):
            line, up = now.tolist(), above.tolist()
            for i, v in enumerate(line):
                left = line[i - step] if i >= step else 0
                if kind == 3:
                    line[i] = (v + ((left + up[i]) >> 1)) & 255
                else:
                    corner = up[i - step] if i >= step else 0
                    guess = left + up[i] - corner
                    line[i] = (v + min((left, up[i], corner), key=lambda p, g=guess: abs(g - p))) & 255
            now = np.array(line, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = above = now
    return out


def samples(rows: np.ndarray, w: int, depth: int, channels: int) -> np.ndarray:
    """Raw samples of each row: fields of under 8 bits from the high end, 16 bits whole."""
    if depth == 8:
        flat = rows.astype(np.int32)
    elif depth == 16:
        flat = rows[:, ::2].astype(np.int32) << 8 | rows[:, 1::2]
    else:
        bits = np.unpackbits(rows, axis=1)[:, : w * channels * depth].reshape(len(rows), -1, depth)
        flat = bits @ (1 << np.arange(depth)[::-1])
    return flat[:, : w * channels].reshape(len(rows), w, channels)


def decode(data: bytes, alpha: bool = False, check: bool = False) -> np.ndarray:
    """RGB, or RGBA: transparency keys compare raw samples, 16 bits keep their high byte, alpha is dropped, not blended."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, key, head = 8, b"", np.zeros((0, 3), np.uint8), None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if check and zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("PNG checksum differs")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            key = part
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    if head is None or head[3] not in CHANNELS or head[4] or head[5] or head[6] > 1:
        raise ValueError("unsupported PNG header")
    w, h, depth, kind, _, _, interlaced = head
    channels = CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    values, used = np.zeros((h, w, channels), np.int32), 0
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x) // dx) if w > x else 0, -(-(h - y) // dy) if h > y else 0
        if pw and ph:
            line = -(-pw * channels * depth // 8) + 1
            rows = unfilter(raw[used : used + line * ph].reshape(ph, line), max(1, channels * depth // 8))
            values[y::dy, x::dx] = samples(rows, pw, depth, channels)
            used += line * ph
    opaque = np.full((h, w), 255, np.uint8)
    if kind == 3:
        index = values[:, :, 0]
        full = np.zeros((256, 3), np.uint8)
        full[: len(palette)] = palette
        rgb = full[index]
        if key is not None:
            opaque = np.concatenate([np.frombuffer(key, np.uint8), np.full(256, 255, np.uint8)])[:256][index]
    else:
        colours = values[:, :, : 3 if kind in (2, 6) else 1]
        if key is not None and kind in (0, 2):
            opaque = np.where((colours == np.frombuffer(key, ">u2").astype(np.int32)).all(axis=2), 0, 255).astype(np.uint8)
        top = (1 << depth) - 1
        spread = lambda v: (v >> 8 if depth == 16 else v * (255 // top)).astype(np.uint8)
        rgb = np.repeat(spread(colours), 3, axis=2) if colours.shape[2] == 1 else spread(colours)
        if kind in (4, 6):
            opaque = spread(values[:, :, -1])
    return np.concatenate([rgb, opaque[:, :, None]], axis=2) if alpha else rgb
