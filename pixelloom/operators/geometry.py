"""Maps of coordinates: where the pixel at (x, y) of a w x h image goes."""

#: EXIF orientations; those from 5 on swap width and height.
ORIENTATIONS = {
    1: ("x", "y"),
    2: ("w - 1 - x", "y"),
    3: ("w - 1 - x", "h - 1 - y"),
    4: ("x", "h - 1 - y"),
    5: ("y", "x"),
    6: ("h - 1 - y", "x"),
    7: ("h - 1 - y", "w - 1 - x"),
    8: ("y", "w - 1 - x"),
}
MAPS = {f"orient_{n}": xy for n, xy in ORIENTATIONS.items()} | {
    "bottom_up_flip": ("x", "h - 1 - y"),
}

#: The interlace pass of a pixel in PNG (Adam7) and GIF, its 8x8 block and its place in it.
PLACES = {
    "adam7": "CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 0 WHEN x % 8 = 4 AND y % 8 = 0 THEN 1 WHEN x % 4 = 0 AND y % 8 = 4 THEN 2 WHEN x % 4 = 2 AND y % 4 = 0 THEN 3 WHEN x % 2 = 0 AND y % 4 = 2 THEN 4 WHEN x % 2 = 1 AND y % 2 = 0 THEN 5 ELSE 6 END",
    "gif_pass": "CASE WHEN y % 8 = 0 THEN 0 WHEN y % 8 = 4 THEN 1 WHEN y % 4 = 2 THEN 2 ELSE 3 END",
    "block_x": "x DIV 8",
    "block_y": "y DIV 8",
    "k": "(y % 8) * 8 + x % 8",
}
