"""Palettes of at most 256 colours, by splitting boxes of colour space where that takes away most variance (Wu, 1991)."""

from __future__ import annotations

import heapq

import numpy as np

CELLS = 32


def moments(pixels: np.ndarray) -> np.ndarray:
    """Count, sums and sum of squares of all colours up to each cell, five bits a channel."""
    p = pixels.reshape(-1, 3).astype(np.int64)
    at = tuple((p >> 3).T + 1)
    cube = np.zeros((5, CELLS + 1, CELLS + 1, CELLS + 1))
    for i, weight in enumerate((np.ones(len(p)), *p.T, (p * p).sum(axis=1))):
        np.add.at(cube[i], at, weight)
    return cube.cumsum(axis=1).cumsum(axis=2).cumsum(axis=3)


def inside(m: np.ndarray, box: tuple) -> np.ndarray:
    """The moments within a box (low, high per axis, low excluded), by inclusion and exclusion."""
    (a, b), (c, d), (e, f) = box
    return sum(s * m[:, x, y, z] for x, sx in ((b, 1), (a, -1)) for y, sy in ((d, 1), (c, -1)) for z, sz in ((f, 1), (e, -1)) for s in (sx * sy * sz,))


def spread(v: np.ndarray) -> float:
    return float(v[4] - (v[1:4] ** 2).sum() / v[0]) if v[0] else 0.0


def best_cut(m: np.ndarray, box: tuple) -> tuple[float, tuple, tuple] | None:
    """The cut of a box that leaves least variance, as the variance and the two parts."""
    found = None
    for axis in range(3):
        low, high = box[axis]
        for at in range(low + 1, high):
            parts = tuple(tuple((low, at) if k == axis and side == 0 else (at, high) if k == axis else box[k] for k in range(3)) for side in (0, 1))
            sums = [inside(m, part) for part in parts]
            if sums[0][0] and sums[1][0] and (found is None or spread(sums[0]) + spread(sums[1]) < found[0]):
                found = (spread(sums[0]) + spread(sums[1]), *parts)
    return found


def palette(pixels: np.ndarray, most: int = 256) -> np.ndarray:
    """At most ``most`` colours: the box of largest variance is cut until there are enough or none can be cut."""
    m = moments(pixels)
    whole = ((0, CELLS),) * 3
    queue, done = [(-spread(inside(m, whole)), 0, whole)], []
    made = 1
    while queue and len(queue) + len(done) < most:
        worst, _, box = heapq.heappop(queue)
        cut = best_cut(m, box) if worst < 0 else None
        if cut is None:
            done.append(box)
            continue
        for part in cut[1:]:
            heapq.heappush(queue, (-spread(inside(m, part)), made, part))
            made += 1
    sums = [inside(m, box) for box in [*done, *(box for _, _, box in queue)]]
    return np.array([np.floor(v[1:4] / v[0] + 0.5) for v in sums if v[0]], np.uint8).reshape(-1, 3)


def nearest(colours: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """The index of the nearest colour of each pixel, the first of equals; looked up once for each distinct colour."""
    distinct, at = np.unique(pixels.reshape(-1, 3), axis=0, return_inverse=True)
    found = np.empty(len(distinct), np.uint8)
    for k in range(0, len(distinct), 4096):
        d = distinct[k : k + 4096, None].astype(np.int32) - colours[None].astype(np.int32)
        found[k : k + 4096] = (d * d).sum(axis=2).argmin(axis=1)
    return found[at.reshape(-1)].reshape(pixels.shape[:-1])


def dithered(colours: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Indices by error diffusion, 7, 3, 5 and 1 sixteenths to the pixels that follow (Floyd and Steinberg, 1976)."""
    h, w = image.shape[:2]
    left = np.zeros((h + 1, w + 2, 3))
    left[:h, 1 : w + 1] = image
    table, out = colours.astype(float), np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(1, w + 1):
            want = np.clip(left[y, x], 0, 255)
            i = int(((table - want) ** 2).sum(axis=1).argmin())
            out[y, x - 1] = i
            error = (want - table[i]) / 16
            left[y, x + 1] += 7 * error
            left[y + 1, x - 1] += 3 * error
            left[y + 1, x] += 5 * error
            left[y + 1, x + 1] += error
    return out
