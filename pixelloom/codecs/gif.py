"""GIF: palettes of 256 colours out, single images or animations; all frames in, painted on their canvas."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.codecs import quantize

#: First rows and steps of the interlace passes.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def lzw_encode(indices: bytes, bits: int) -> bytes:
    """Codes from the least bit on; the table starts anew when it is full."""
    clear, width, acc, held = 1 << bits, bits + 1, 0, 0
    out, table, after = bytearray(), {}, (1 << bits) + 2

    def put(code: int) -> None:
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    put(clear)
    if indices:
        code = indices[0]
        for value in indices[1:]:
            if (known := table.get((code, value))) is not None:
                code = known
                continue
            put(code)
            if after < 4096:
                table[code, value] = after
                after += 1
                width = max(width, (after - 1).bit_length())
            else:
                put(clear)
                table, after, width = {}, clear + 2, bits + 1
            code = value
        put(code)
        if after < 4096 and after == 1 << width:
            width += 1
    put(clear + 1)
    if held:
        out.append(acc & 255)
    return bytes(out)


def lzw_decode(data: bytes, bits: int, n: int) -> bytes:
    """At most ``n`` values; what a stream that ends early lacks is zero."""
    clear, width, acc, held = 1 << bits, bits + 1, 0, 0
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last, out = list(start), None, bytearray()
    for byte in data:
        acc |= byte << held
        held += 8
        while held >= width and len(out) < n:
            code, acc, held = acc & ((1 << width) - 1), acc >> width, held - width
            if code == clear:
                table, width, last = list(start), bits + 1, None
                continue
            if code == clear + 1:
                return bytes(out[:n]).ljust(n, b"\0")
            if code < len(table):
                said = table[code]
            elif last is not None and code == len(table):
                said = last + last[:1]
            else:
                raise ValueError("bad LZW code")
            out += said
            if last is not None and len(table) < 4096:
                table.append(last + said[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = said
    return bytes(out[:n]).ljust(n, b"\0")


def indexed(image: np.ndarray, dither: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Palette and indices; of four channels, pixels under half opaque are index 0. Images of few colours keep them all."""
    h, w = image.shape[:2]
    flat = image.reshape(-1, image.shape[2])
    opaque = flat[:, 3] >= 128 if flat.shape[1] == 4 else np.ones(len(flat), bool)
    first = 0 if opaque.all() else 1
    colours = np.unique(flat[opaque, :3], axis=0)
    if len(colours) + first > 256:
        colours = quantize.palette(flat[opaque, :3], 256 - first)
    out = np.zeros(len(flat), np.uint8)
    if opaque.any():
        found = quantize.dithered(colours, image[:, :, :3]).reshape(-1) if dither else quantize.nearest(colours, flat[:, :3])
        out[opaque] = found[opaque] + first
    return np.concatenate([np.zeros((first, 3), np.uint8), colours]), out.reshape(h, w)


def encode(frames: list[np.ndarray], durations_ms: list[int] | None = None, loops: int = 0, dither: bool = False) -> bytes:
    h, w = frames[0].shape[:2]
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0)
    if len(frames) > 1:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    for k, frame in enumerate(frames):
        palette, index = indexed(frame, dither)
        clear = frame.shape[2] == 4 and bool((frame[:, :, 3] < 128).any())
        delay = (durations_ms[k] + 5) // 10 if durations_ms else 0
        bits = max(2, (len(palette) - 1).bit_length())
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", (2 if clear else 1) << 2 | clear, delay, 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x80 | (bits - 1)) + palette.astype(np.uint8).tobytes().ljust(3 << bits, b"\0") + bytes([bits])
        packed = lzw_encode(index.tobytes(), bits)
        out += b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0"
    return out + b"\x3b"


def decode(data: bytes, most: int | None = None) -> list[tuple[np.ndarray, int]]:
    """(RGBA canvas, duration in ms, 10 at least) of each frame, disposals applied in between."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
        at += shared.size
    canvas, frames = np.zeros((h, w, 4), np.uint8), []
    dispose, delay, key = 0, 0, None

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    while at < len(data) and data[at] != 0x3B and (most is None or len(frames) < most):
        if data[at] == 0x21:
            kind, at = data[at + 1], at + 2
            part = blocks()
            if kind == 0xF9 and len(part) >= 4:
                dispose, delay, key = part[0] >> 2 & 7, struct.unpack_from("<H", part, 1)[0], part[3] if part[0] & 1 else None
        elif data[at] == 0x2C:
            x, y, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                palette = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
                at += palette.size
            bits, at = data[at], at + 1
            index = np.frombuffer(lzw_decode(blocks(), bits, fw * fh), np.uint8).reshape(fh, fw)
            if flags & 0x40:
                order = [r for first, step in PASSES for r in range(first, fh, step)]
                straight = np.zeros_like(index)
                straight[order] = index
                index = straight
            before = canvas.copy()
            seen = index[: max(0, h - y), : max(0, w - x)]
            paint = (seen < len(palette)) & (seen != (-1 if key is None else key))
            there = canvas[y : y + fh, x : x + fw]
            there[paint] = np.concatenate([palette[seen[paint]], np.full((int(paint.sum()), 1), 255, np.uint8)], axis=1)
            frames.append((canvas.copy(), max(10, delay * 10)))
            if dispose == 2:
                there[:] = 0
            elif dispose == 3:
                canvas = before
            dispose, delay, key = 0, 0, None
        else:
            raise ValueError("unknown GIF block")
    return frames
