"""JPEG after ITU-T T.81: baseline out; baseline and progressive of 8 bits in, one, three or four components.

Coefficients of all scans are gathered in one array per component, in zig-zag order; a baseline file is one with a single
pass over each. Transforms, upsampling (nearest) and colours then work on whole planes.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from pixelloom.operators.dct import INTEGER_BASIS, LUMA
from pixelloom.operators.raster import oriented

#: More pixels than this aren't decoded, whatever a header says.
MOST_PIXELS = 1 << 28
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
PLACES = np.argsort(ZIGZAG)
WHOLE = np.array(INTEGER_BASIS, np.int64)
COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

# Fixed values of the specification: the chrominance table, and for the Huffman tables the number of codes of each length and the symbols.
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
DC_SYMBOLS = bytes(range(12))
HUFFMAN = {
    (0, 0): (bytes.fromhex("00010501010101010100000000000000"), DC_SYMBOLS),
    (0, 1): (bytes.fromhex("00030101010101010101010000000000"), DC_SYMBOLS),
    (1, 0): (bytes.fromhex("0002010303020403050504040000017d"), bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f0"
        "2433627282090a161718191a25262728292a3435363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a83848586878889"
        "8a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8"
        "f9fa")),
    (1, 1): (bytes.fromhex("00020102040403040705040400010277"), bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0"
        "156272d10a162434e125f11718191a262728292a35363738393a434445464748"
        "494a535455565758595a636465666768696a737475767778797a828384858687"
        "88898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3"
        "c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8"
        "f9fa")),
}


def codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length): codes count up within a length and double from one to the next."""
    out, code, k = [], 0, 0
    for length, n in enumerate(lengths, 1):
        for symbol in symbols[k : k + n]:
            out.append((symbol, code, length))
            code += 1
        if code > 1 << length:
            raise ValueError("Huffman table has too many codes")
        k, code = k + n, code << 1
    return out


#: The encoder's codes as bits, by symbol.
WORDS = {key: {s: format(c, f"0{n}b") for s, c, n in codes(*spec)} for key, spec in HUFFMAN.items()}


def table_at(base: tuple[int, ...], quality: int) -> np.ndarray:
    """A quantisation table at a quality from 1 to 100, in natural order."""
    q = min(100, max(1, quality))
    share = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * share + 50) // 100, 1, 255)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    levels: np.ndarray | None = None
    width: int = 0
    height: int = 0


# Encoder.


def blocks_of(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """A plane as (rows, columns, 8, 8), its last row and column repeated where it ends early."""
    h, w = plane.shape
    full = np.pad(plane, ((0, rows * 8 - h), (0, columns * 8 - w)), mode="edge")
    return full.reshape(rows, 8, columns, 8).swapaxes(1, 2)


def rounded(v: np.ndarray, shift: int) -> np.ndarray:
    return (v + (1 << (shift - 1))) >> shift


def quantised(blocks: np.ndarray, table: np.ndarray, integer: bool = True) -> np.ndarray:
    """Levels in zig-zag order: by whole numbers, rows first, as the queries have it, or by exact cosines."""
    if integer:
        found = rounded(WHOLE @ rounded((blocks.astype(np.int64) - 128) @ WHOLE.T, 11), 15)
        levels = np.sign(found) * rounded(np.abs(found) * (1048576 // (8 * table.reshape(8, 8).astype(np.int64))), 20)
    else:
        found = COSINES @ (blocks - 128.0) @ COSINES.T / table.reshape(8, 8)
        levels = np.sign(found) * np.floor(np.abs(found) + 0.5)
    return np.clip(levels, -1023, 1023).astype(int).reshape(*blocks.shape[:2], 64)[..., ZIGZAG]


def samples_of(found: np.ndarray, integer: bool = True) -> np.ndarray:
    """Blocks of samples, 0 to 255, of dequantised blocks."""
    if integer:
        back = rounded(WHOLE.T @ rounded(found.astype(np.int64) @ WHOLE, 11), 18)
    else:
        back = np.round(COSINES.T @ found @ COSINES)
    return np.clip(back + 128, 0, 255).astype(np.int32)


def magnitude(v: int) -> tuple[int, str]:
    """The category of a value and its bits."""
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def dc_bits(value: int, before: int, dc: dict[int, str]) -> str:
    n, bits = magnitude(value - before)
    return dc[n] + bits


def ac_bits(levels: np.ndarray, first: int, final: int, ac: dict[int, str]) -> str:
    """The levels at places ``first`` to ``final`` of a block, with an end mark where the last are zero."""
    out, last = [], first - 1
    for k in (np.flatnonzero(levels[first : final + 1]) + first).tolist():
        run = k - last - 1
        out.append(ac[0xF0] * (run // 16))
        n, bits = magnitude(int(levels[k]))
        out += (ac[run % 16 << 4 | n], bits)
        last = k
    if last < final:
        out.append(ac[0])
    return "".join(out)


def packed(out: list[str]) -> bytes:
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


#: Scans of the progressive form: first and last place, bits that came before, bits that are left. Lower bits of DC come last.
PROGRESSION = ((0, 0, 0, 1), (1, 5, 0, 0), (6, 63, 0, 0), (0, 0, 1, 0))


def scan_bytes(parts: list[Component], chosen: list[int], words: dict, first: int, final: int, high: int, low: int) -> bytes:
    """One scan with its header, over the blocks of the chosen components."""
    out, before = [], [0] * len(chosen)
    for unit in units([parts[i] for i in chosen]):
        for i, y, x in unit:
            one, table = parts[chosen[i]].levels[y, x], min(chosen[i], 1)
            dc = int(one[0]) >> low
            if first == 0 and high:
                out.append(str(dc & 1))
            elif first == 0:
                out.append(dc_bits(dc, before[i], words[0, table]))
                before[i] = dc
            if final:
                out.append(ac_bits(one, max(first, 1), final, words[1, table]))
    head = bytes([len(chosen)]) + b"".join(bytes([i + 1, min(i, 1) * 17]) for i in chosen) + bytes([first, final, high << 4 | low])
    return segment(0xDA, head) + packed(out)


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def planes_of(image: np.ndarray, subsample: bool) -> list[np.ndarray]:
    r, g, b = (image[:, :, i].astype(int) for i in range(3))
    out = [(77 * r + 150 * g + 29 * b) >> 8, ((-43 * r - 85 * g + 128 * b) >> 8) + 128, ((128 * r - 107 * g - 21 * b) >> 8) + 128]
    if subsample:
        h, w = r.shape
        for i in (1, 2):
            even = np.pad(out[i], ((0, h % 2), (0, w % 2)), mode="edge")
            out[i] = (even[::2, ::2] + even[1::2, ::2] + even[::2, 1::2] + even[1::2, 1::2] + 2) >> 2
    return out


def encode(image: np.ndarray, quality: int = 75, subsample: bool = True, exif: bytes = b"", icc: bytes = b"", progressive: bool = False, integer: bool = True) -> bytes:
    """Gray of two dimensions or RGB (further channels are dropped); ``exif`` begins with its TIFF header, ``integer`` is that of ``quantised``."""
    h, w = image.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError("size not between 1 and 65535")
    gray = image.ndim == 2 or image.shape[2] == 1
    planes = [image.reshape(h, w)] if gray else planes_of(image, subsample)
    factor = 1 if gray or not subsample else 2
    factors = [factor, 1, 1][: len(planes)]
    tables = [table_at(LUMA, quality), table_at(CHROMA, quality)][: 1 if gray else 2]
    mcu_rows, mcu_columns = -(-h // (8 * factor)), -(-w // (8 * factor))
    parts = []
    for i, (p, f) in enumerate(zip(planes, factors, strict=True)):
        levels = quantised(blocks_of(p, mcu_rows * f, mcu_columns * f), tables[min(i, 1)], integer)
        parts.append(Component(i + 1, f, f, min(i, 1), levels, p.shape[1], p.shape[0]))
    every = list(range(len(parts)))
    if progressive:
        body = b"".join(scan_bytes(parts, chosen, WORDS, *scan) for scan in PROGRESSION for chosen in ([[i] for i in every] if scan[0] else [every]))
    else:
        body = scan_bytes(parts, every, WORDS, 0, 63, 0, 0)
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    if exif:
        head += segment(0xE1, b"Exif\0\0" + exif)
    profile = [icc[k : k + 65519] for k in range(0, len(icc), 65519)]
    head += b"".join(segment(0xE2, b"ICC_PROFILE\0" + bytes([k, len(profile)]) + p) for k, p in enumerate(profile, 1))
    head += b"".join(segment(0xDB, bytes([i]) + t[ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(tables))
    head += segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, f * 17, min(i, 1)]) for i, f in enumerate(factors)))
    head += b"".join(segment(0xC4, bytes([kind << 4 | i]) + lengths + symbols) for (kind, i), (lengths, symbols) in HUFFMAN.items() if i < len(tables))
    return head + body + b"\xff\xd9"


# Decoder.


@dataclass
class Header:
    width: int = 0
    height: int = 0
    progressive: bool = False
    orientation: int = 1
    exif: bytes = b""
    icc: bytes = b""
    adobe: int | None = None
    interval: int = 0
    components: list[Component] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, list] = field(default_factory=dict)


class Bits:
    """Bits of one stretch between restarts, highest first; zeros for a little beyond its end, then an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\0", b"\xff") + bytes(8), 0
        self.end = 8 * len(self.data) - 32

    def take(self, n: int) -> int:
        if self.at > self.end:
            raise ValueError("scan ends early")
        i = self.at >> 3
        value = int.from_bytes(self.data[i : i + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, table: list) -> int:
        symbol, length = table[self.take(16)]
        if not length:
            raise ValueError("no such Huffman code")
        self.at += length - 16
        return symbol

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@lru_cache(maxsize=16)
def lookup(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) by the next 16 bits; kept for the next file, as most files have the same few tables."""
    out = [(0, 0)] * 65536
    for symbol, code, n in codes(lengths, symbols):
        out[code << (16 - n) : (code + 1) << (16 - n)] = [(symbol, n)] * (1 << (16 - n))
    return out[:65536]


def orientation_of(exif: bytes) -> int:
    """Tag 0x0112 of the first directory of a TIFF header; 1 where it is missing or broken."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    try:
        start = struct.unpack_from(f"{order}I", exif, 4)[0] if order else len(exif)
        for k in range(struct.unpack_from(f"{order}H", exif, start)[0] if order else 0):
            tag, kind, n, value = struct.unpack_from(f"{order}HHIH", exif, start + 2 + 12 * k)
            if (tag, kind, n) == (0x0112, 3, 1):
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def set_upright(exif: bytes) -> bytes:
    """The same EXIF data with orientation 1, where a directory gives one."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    out = bytearray(exif)
    try:
        if order and struct.unpack_from(f"{order}H", exif, 2)[0] == 42:
            start = struct.unpack_from(f"{order}I", exif, 4)[0]
            for at in range(start + 2, start + 2 + 12 * struct.unpack_from(f"{order}H", exif, start)[0], 12):
                tag, kind, n = struct.unpack_from(f"{order}HHI", exif, at)
                if tag == 0x0112 and kind == 3 and n:
                    struct.pack_into(f"{order}H", out, at + 8, 1)
                    break
    except struct.error:
        pass
    return bytes(out)


def metadata(data: bytes) -> dict:
    """``exif`` and ``icc`` where the file has them, up to its first scan."""
    head = parse(data, scans=False)
    return {k: v for k, v in (("exif", head.exif), ("icc", head.icc)) if v}


def read_frame(head: Header, data: bytes) -> None:
    if head.components:
        raise ValueError("more than one frame")
    bits, head.height, head.width, n = struct.unpack_from(">BHHB", data)
    if bits != 8 or n not in (1, 3, 4) or len(data) < 6 + 3 * n or not head.width or not head.height:
        raise ValueError("unsupported frame")
    if head.width * head.height > MOST_PIXELS:
        raise ValueError("image too large")
    head.components = [Component(data[k], data[k + 1] >> 4, data[k + 1] & 15, data[k + 2]) for k in range(6, 6 + 3 * n, 3)]
    if len({c.ident for c in head.components}) < n or not all(1 <= f <= 4 for c in head.components for f in (c.h, c.v)):
        raise ValueError("broken components")


def make_room(head: Header) -> None:
    hmax, vmax = max(c.h for c in head.components), max(c.v for c in head.components)
    columns, rows = -(-head.width // (8 * hmax)), -(-head.height // (8 * vmax))
    for c in head.components:
        c.width, c.height = -(-head.width * c.h // hmax), -(-head.height * c.v // vmax)
        c.levels = np.zeros((rows * c.v, columns * c.h, 64), np.int32)


def units(parts: list[Component]) -> list[tuple[tuple[int, int, int], ...]]:
    """The blocks (component, row, column) of a scan, unit by unit."""
    if len(parts) == 1:
        c = parts[0]
        return [((0, y, x),) for y in range(-(-c.height // 8)) for x in range(-(-c.width // 8))]
    rows, columns = parts[0].levels.shape[0] // parts[0].v, parts[0].levels.shape[1] // parts[0].h
    return [tuple((i, y * c.v + j, x * c.h + k) for i, c in enumerate(parts) for j in range(c.v) for k in range(c.h)) for y in range(rows) for x in range(columns)]


class Scan:
    """One scan's way to read a block: what is left of a run of empty blocks, and the last DC of each component."""

    def __init__(self, bits: Bits, first: int, last: int, high: int, low: int, n: int):
        self.bits, self.first, self.last, self.high, self.low = bits, first, last, high, low
        self.empty, self.dc = 0, [0] * n

    def read(self, block: list[int], i: int, dc: list | None, ac: list | None) -> None:
        if self.first == 0:
            if self.high:
                block[0] |= self.bits.take(1) << self.low
            else:
                self.dc[i] += self.bits.signed(min(16, self.bits.symbol(dc)))
                block[0] = self.dc[i] << self.low
        if self.last:
            (self.refine if self.high else self.fill)(block, ac)

    def fill(self, block: list[int], ac: list) -> None:
        if self.empty:
            self.empty -= 1
            return
        k = max(1, self.first)
        while k <= self.last:
            run, n = divmod(self.bits.symbol(ac), 16)
            if n:
                k += run
                if k > self.last:
                    raise ValueError("coefficient out of range")
                block[k] = self.bits.signed(n) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.empty = (1 << run) + (self.bits.take(run) if run else 0) - 1
                return

    def sharpen(self, block: list[int], k: int) -> None:
        if self.bits.take(1) and not abs(block[k]) >> self.low & 1:
            block[k] += (1 if block[k] > 0 else -1) << self.low

    def refine(self, block: list[int], ac: list) -> None:
        k = max(1, self.first)
        while not self.empty and k <= self.last:
            run, n = divmod(self.bits.symbol(ac), 16)
            new = (1 if self.bits.take(1) else -1) << self.low if n else 0
            if not n and run < 15:
                self.empty = (1 << run) + (self.bits.take(run) if run else 0)
                break
            while k <= self.last and (block[k] or run):
                if block[k]:
                    self.sharpen(block, k)
                else:
                    run -= 1
                k += 1
            if k <= self.last:
                block[k] = new
                k += 1
        if self.empty:
            for at in range(k, self.last + 1):
                if block[at]:
                    self.sharpen(block, at)
            self.empty -= 1


def read_scan(head: Header, data: bytes, body: bytes) -> None:
    n = data[0]
    by_id = {c.ident: c for c in head.components}
    chosen = [(by_id.get(data[1 + 2 * k]), data[2 + 2 * k]) for k in range(n)]
    first, last, approx = data[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if not chosen or any(c is None for c, _ in chosen) or first > last or last > 63 or low > 13 or (first and n > 1) or (head.progressive and not first and last) or (not head.progressive and (first, last, approx) != (0, 63, 0)):
        raise ValueError("broken scan")
    if head.components[0].levels is None:
        make_room(head)
    parts = [c for c, _ in chosen]
    tables = [(head.huffman.get(t >> 4), head.huffman.get(16 | t & 15)) for _, t in chosen]
    if any((first == 0 and not high and dc is None) or (last and ac is None) for dc, ac in tables):
        raise ValueError("Huffman table missing")
    todo = units(parts)
    step = head.interval or len(todo)
    pieces = re.split(rb"\xff[\xd0-\xd7]", body)
    if len(pieces) < -(-len(todo) // step):
        raise ValueError("scan ends early")
    for k in range(0, len(todo), step):
        scan = Scan(Bits(pieces[k // step]), first, last, high, low, n)
        for unit in todo[k : k + step]:
            for i, y, x in unit:
                block = parts[i].levels[y, x].tolist()
                scan.read(block, i, *tables[i])
                parts[i].levels[y, x] = block


def read_tables(head: Header, data: bytes) -> None:
    while data:
        wide, ident = data[0] >> 4, data[0] & 15
        n = 128 if wide else 64
        if len(data) <= n:
            raise ValueError("quantisation table ends early")
        head.tables[ident] = np.frombuffer(data[1 : n + 1], ">u2" if wide else np.uint8).astype(np.int32)
        data = data[n + 1 :]


def read_huffman(head: Header, data: bytes) -> None:
    while data:
        n = sum(data[1:17])
        if len(data) < 17 + n or n > 256:
            raise ValueError("Huffman table ends early")
        head.huffman[data[0]] = lookup(bytes(data[1:17]), bytes(data[17 : 17 + n]))
        data = data[17 + n :]


def parse(data: bytes, scans: bool = True) -> Header:
    """All segments; without ``scans`` those up to the first scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    head, at = Header(), 2
    while found := re.compile(rb"\xff+([^\x00\xff])").search(data, at):
        marker, at = found[1][0], found.end()
        if marker == 0xD9:
            break
        if marker in (0x01, *range(0xD0, 0xD9)):
            continue
        if at + 2 > len(data):
            raise ValueError("segment ends early")
        size = struct.unpack_from(">H", data, at)[0]
        part = data[at + 2 : at + size]
        if size < 2 or len(part) < size - 2:
            raise ValueError("segment ends early")
        at += size
        try:
            if marker in (0xC0, 0xC1, 0xC2):
                head.progressive = marker == 0xC2
                read_frame(head, part)
            elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("unsupported kind of frame")
            elif marker == 0xC4:
                read_huffman(head, part)
            elif marker == 0xDB:
                read_tables(head, part)
            elif marker == 0xDD:
                head.interval = struct.unpack(">H", part)[0]
            elif marker == 0xE1 and part[:6] == b"Exif\0\0":
                head.exif, head.orientation = part[6:], orientation_of(part[6:])
            elif marker == 0xE2 and part[:12] == b"ICC_PROFILE\0":
                head.icc += part[14:]
            elif marker == 0xEE and part[:5] == b"Adobe" and len(part) >= 12:
                head.adobe = part[11]
            elif marker == 0xDA:
                if not scans:
                    break
                end = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]").search(data, at)
                stop = end.start() if end else len(data)
                read_scan(head, part, data[at:stop])
                at = stop
        except (struct.error, IndexError) as e:
            raise ValueError("broken segment") from e
    if not head.components:
        raise ValueError("no frame")
    return head


def doubled(samples: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Samples of a halved plane at ``n`` places: three parts of the nearest one, one of the next nearest."""
    at = np.arange(n)
    near = at // 2
    far = np.clip(near + np.where(at % 2, 1, -1), 0, (n - 1) // 2)
    return (samples.take(near, axis) * 192 + samples.take(far, axis) * 64 + 128) >> 8


def plane(head: Header, c: Component, linear: bool = False, integer: bool = True) -> np.ndarray:
    """A component's samples at the size of the image; those that stand for several pixels repeated, or put between if halved."""
    if c.table not in head.tables:
        raise ValueError("quantisation table missing")
    rows, columns = c.levels.shape[:2]
    found = (c.levels * head.tables[c.table])[..., PLACES].reshape(rows, columns, 8, 8)
    samples = samples_of(found, integer).swapaxes(1, 2).reshape(rows * 8, columns * 8)
    hmax, vmax = max(d.h for d in head.components), max(d.v for d in head.components)
    if linear and hmax == 2 * c.h:
        samples = doubled(samples, head.width, 1)
    else:
        samples = samples[:, np.arange(head.width) * c.h // hmax]
    return doubled(samples, head.height, 0) if linear and vmax == 2 * c.v else samples[np.arange(head.height) * c.v // vmax]


def ordered(components: list[Component]) -> list[Component]:
    """Components by the names 1, 2, 3, 4, or R, G, B, or C, M, Y, K, if all are there; else as they come."""
    named, n = {c.ident: c for c in components}, len(components)
    for names in (bytes(range(1, n + 1)), {3: b"RGB", 4: b"CMYK"}.get(n, b"")):
        if names and all(i in named for i in names):
            return [named[i] for i in names]
    return components


def colours(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    cb, cr = cb - 128, cr - 128
    return [np.clip(v, 0, 255) for v in (y + (91881 * cr >> 16), y - (22554 * cb + 46802 * cr >> 16), y + (116130 * cb >> 16))]


def decode(data: bytes, upright: bool = False, linear: bool = False, integer: bool = True) -> np.ndarray:
    """RGB, on request turned as its EXIF segment says, with halved chroma put between linearly, and by exact cosines instead of whole numbers. Three components are luma and chroma unless an Adobe segment or the names R, G, B say otherwise; four are inks, stored inverted."""
    head = parse(data)
    if head.components[0].levels is None:
        raise ValueError("no scan")
    planes = [plane(head, c, linear, integer) for c in ordered(head.components)]
    if len(planes) == 1:
        planes = planes * 3
    elif len(planes) == 3 and head.adobe != 0 and {c.ident for c in head.components} != set(b"RGB"):
        planes = colours(*planes)
    elif len(planes) == 4:
        inks = colours(*planes[:3]) if head.adobe == 2 else planes[:3]
        planes = [(p * planes[3] + 127) // 255 for p in inks]
    image = np.stack(planes, axis=2).astype(np.uint8)
    return oriented(image, head.orientation) if upright else image


class Feed:
    """The bytes of one file as they come, and where it ends: after its end mark, passed segment by segment."""

    marker = re.compile(rb"\xff+([^\x00\xff])")

    def __init__(self) -> None:
        self.data, self.at = bytearray(), 0

    def add(self, part: bytes) -> int | None:
        self.data += part
        while found := self.marker.search(self.data, self.at):
            kind, at = found[1][0], found.end()
            if kind == 0xD9:
                return at
            if kind != 0x01 and not 0xD0 <= kind <= 0xD8:
                if at + 2 > len(self.data) or at + (size := struct.unpack_from(">H", self.data, at)[0]) > len(self.data):
                    self.at = found.start()
                    return None
                at += size
            self.at = at
        self.at = max(self.at, len(self.data.rstrip(b"\xff")))
        return None


def decode_stream(stream, block: int = 1 << 16, **options) -> np.ndarray:
    """``decode`` of what a stream that can't be sought gives, read block by block up to the end of the first file."""
    feed, end = Feed(), None
    while end is None and (part := stream.read(block)):
        end = feed.add(part)
    return decode(bytes(feed.data[:end]), **options)
