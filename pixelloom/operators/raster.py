"""The pixel operators on whole rasters (rows, columns, three channels), for images too large to take apart."""

from __future__ import annotations

import re

import numpy as np

from pixelloom.operators.geometry import ORIENTATIONS


def grayscale(image: np.ndarray) -> np.ndarray:
    v = (image[:, :, :3].astype(np.int32) @ np.array([77, 150, 29], np.int32)) >> 8
    return np.repeat(v[:, :, None], 3, axis=2).astype(np.uint8)


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """An EXIF orientation applied; values but 2 to 8 change nothing."""
    if orientation not in ORIENTATIONS or orientation == 1:
        return image
    out = image.swapaxes(0, 1) if orientation >= 5 else image
    if orientation in (2, 3, 6, 7):
        out = out[:, ::-1]
    if orientation in (3, 4, 7, 8):
        out = out[::-1]
    return out


def overlaps(source: int, target: int) -> np.ndarray:
    """How far each source cell lies in each target cell, in units of 1 / (source * target)."""
    s, t = np.arange(source), np.arange(target)[:, None]
    return np.maximum(0, np.minimum((t + 1) * source, (s + 1) * target) - np.maximum(t * source, s * target))


def area(image: np.ndarray, w: int, h: int) -> np.ndarray:
    sh, sw = image.shape[:2]
    total = np.einsum("ya,abc,xb->yxc", overlaps(sh, h), image.astype(np.int64), overlaps(sw, w), optimize=True)
    return ((2 * total + sw * sh) // (2 * sw * sh)).astype(np.uint8)


def taps(source: int, target: int) -> np.ndarray:
    """Keys' kernel at a = -1/2 with half-pixel centres, taps clamped to the edge."""
    centre = (np.arange(target) + 0.5) * source / target - 0.5
    out = np.zeros((target, source))
    for k in range(-1, 3):
        at = np.floor(centre).astype(int) + k
        t = np.abs(centre - at)
        weight = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
        np.add.at(out, (np.arange(target), np.clip(at, 0, source - 1)), weight)
    return out


def resize(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Nothing for equal or no size; cubic if either side grows, else the mean by area."""
    sh, sw = image.shape[:2]
    if w <= 0 or h <= 0 or (w, h) == (sw, sh):
        return image
    if w <= sw and h <= sh:
        return area(image, w, h)
    exact = np.einsum("ya,abc,xb->yxc", taps(sh, h), image.astype(float), taps(sw, w), optimize=True)
    return np.clip(np.floor(exact + 0.5), 0, 255).astype(np.uint8)


def resize_to_fit(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """The largest size within w x h of the same shape, which may be larger; halves go to the even number."""
    sh, sw = image.shape[:2]
    scale = min(w / sw, h / sh)
    return resize(image, max(1, round(sw * scale)), max(1, round(sh * scale)))


def operation(said: str):
    """``grayscale``, ``resize:WxH``, ``resizefit:WxH`` or ``orient:N`` as a function of an image."""
    name, _, rest = said.lower().partition(":")
    if name in ("grayscale", "gray"):
        return grayscale
    if name == "orient" and rest.isdigit():
        return lambda image: oriented(image, int(rest))
    size = re.fullmatch(r"(\d+)[x*](\d+)", rest)
    if name in ("resize", "resizefit") and size:
        w, h = int(size[1]), int(size[2])
        return lambda image: (resize if name == "resize" else resize_to_fit)(image, w, h)
    raise ValueError(f"unknown operation: {said}")
