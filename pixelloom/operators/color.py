"""Formulas per pixel, as expressions that both engines read alike. ``r g b`` stand for the three input channels."""

#: Weights of the gray level and of the colour spaces.
GRAY = "((77 * r + 150 * g + 29 * b) >> 8)"
K = "((r + b) DIV 2)"


def clamp(e: str) -> str:
    return f"greatest(0, least(255, {e}))"


def ycc(y: str, cb: str, cr: str) -> dict[str, str]:
    return {
        "r2": clamp(f"{y} + ((91881 * ({cr} - 128)) >> 16)"),
        "g2": clamp(f"{y} - ((22554 * ({cb} - 128) + 46802 * ({cr} - 128)) >> 16)"),
        "b2": clamp(f"{y} + ((116130 * ({cb} - 128)) >> 16)"),
    }


def ycc_float(y: str, cb: str, cr: str) -> dict[str, str]:
    d = "CAST(({}) AS DOUBLE)"
    return {
        "r2": clamp(f"CAST(bround({d.format(y)} + 1.402E0 * ({cr} - 128), 0) AS INT)"),
        "g2": clamp(f"CAST(bround({d.format(y)} - 0.344136E0 * ({cb} - 128) - 0.714136E0 * ({cr} - 128), 0) AS INT)"),
        "b2": clamp(f"CAST(bround({d.format(y)} + 1.772E0 * ({cb} - 128), 0) AS INT)"),
    }


def ink(c: str, k: str) -> str:
    return f"((255 - {c}) * (255 - {k}) + 127) DIV 255"


def ink_float(c: str, k: str) -> str:
    return f"CAST(bround(CAST((255 - {c}) AS DOUBLE) * (255 - {k}) / 255.0E0, 0) AS INT)"


def masked(v: str, shift: int, top: int) -> str:
    return f"((({v} >> {shift}) & {top}) * 255 + {top >> 1}) DIV {top}"


V16 = "(r * 256 + g)"

PROJECTIONS = {
    "grayscale": {"r2": GRAY, "g2": GRAY, "b2": GRAY},
    "to_gray8": {"v": GRAY},
    "rgba_drop_alpha": {"r2": "r", "g2": "g", "b2": "b"},
    "rgb_to_rgba": {"r2": "r", "g2": "g", "b2": "b", "a": "255"},
    "gray_expand": {"r2": "r", "g2": "r", "b2": "r"},
    "rgb_to_ycbcr": {"yy": GRAY, "cb": "((-43 * r - 85 * g + 128 * b) >> 8) + 128", "cr": "((128 * r - 107 * g - 21 * b) >> 8) + 128"},
    "ycbcr_to_rgb": ycc("r", "g", "b"),
    "ycbcr_to_rgb_float": ycc_float("r", "g", "b"),
    "cmyk_to_rgb_fast": {c + "2": ink(c, K) for c in "rgb"},
    "cmyk_to_rgb_float": {c + "2": ink_float(c, K) for c in "rgb"},
    "ycck_to_rgb_fast": {k: f"(({e}) * (255 - {K}) + 127) DIV 255" for k, e in ycc("r", "g", "b").items()},
    "ycck_to_rgb_float": {k: f"CAST(bround(CAST(({e}) AS DOUBLE) * (255 - {K}) / 255.0E0, 0) AS INT)" for k, e in ycc_float("r", "g", "b").items()},
    "cmyk_invert": {c + "2": f"255 - {c}" for c in "rgb"},
    "clamp_byte": {"v": clamp("r + g - 128")},
    "png_depth_scale": {"v1": "(r >> 7) * 255", "v2": "(r >> 6) * 85", "v4": "(r >> 4) * 17"},
    "png_16_to_8": {"v": f"{V16} >> 8"},
    "png_subbyte_unpack": {"v1": "(r >> (7 - x % 8)) & 1", "v2": "(r >> (6 - 2 * (x % 4))) & 3", "v4": "(r >> (4 - 4 * (x % 2))) & 15"},
    "png_trns_key": {"a": "CASE WHEN r = 85 AND g = 127 AND b = 106 THEN 0 ELSE 255 END", "ag": "CASE WHEN r = 127 THEN 0 ELSE 255 END"},
    "bmp555_expand": {"r2": f"((({V16} >> 10) & 31) << 3) | ((({V16} >> 10) & 31) >> 2)", "g2": f"((({V16} >> 5) & 31) << 3) | ((({V16} >> 5) & 31) >> 2)", "b2": f"(({V16} & 31) << 3) | (({V16} & 31) >> 2)"},
    "bmp_mask_extract": {"r2": masked(V16, 11, 31), "g2": masked(V16, 5, 63), "b2": masked(V16, 0, 31)},
    "bmp_bgr_swap": {"r2": "b", "g2": "g", "b2": "r"},
    "alpha_threshold": {"opaque": "CASE WHEN a >= 128 THEN 1 ELSE 0 END"},
    "jpeg_level_shift": {"down": "r - 128", "up": clamp("g - 128 + 128")},
    "magnitude_bits": {"category": "CASE WHEN r = 128 THEN 0 ELSE CAST(floor(log2(CAST(abs(r - 128) AS DOUBLE))) AS INT) + 1 END", "bits": "CASE WHEN r < 128 THEN r - 129 + (1 << (CAST(floor(log2(CAST(abs(r - 128) AS DOUBLE))) AS INT) + 1)) ELSE r - 128 END"},
    "zlib_header": {"ok": "CASE WHEN (r & 15) = 8 AND (g & 32) = 0 AND (r * 256 + g) % 31 = 0 THEN 1 ELSE 0 END"},
}
