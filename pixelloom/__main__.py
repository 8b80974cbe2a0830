"""``python -m pixelloom SOURCE OUT [OPERATION ...]``: converts a directory, or a file, of images."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pixelloom.plans.convert import EXTENSIONS, convert

NAMES = {v: k for k, v in EXTENSIONS.items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pixelloom", description=__doc__)
    p.add_argument("source")
    p.add_argument("out", help="the table of (path, source, content) that results are added to")
    p.add_argument("operations", nargs="*", help="grayscale, resize:WxH, resizefit:WxH, orient:N")
    p.add_argument("--to", "--out-ext", default="png", type=lambda s: NAMES.get(s.lower().lstrip("."), s.lower().lstrip(".")), choices=["jpeg", "png", "bmp", "gif", "webp"])
    p.add_argument("--files", help="a folder that image files are written to as well")
    p.add_argument("--quality", "-q", type=int, help="of JPEG and WebP")
    p.add_argument("--subsample", choices=["420", "444"], help="colour of JPEG")
    p.add_argument("--lossless", action="store_true", help="for WebP")
    p.add_argument("--dithering", action="store_true", help="for GIF")
    p.add_argument("--frames", choices=["first", "each", "all"], default="first", help="of animations")
    p.add_argument("--linear-chroma", action="store_true", help="halved colour of JPEG files is put between, not repeated")
    p.add_argument("--idct", choices=["int", "float"], default="int", help="the inverse transform for JPEG files")
    p.add_argument("--check-crc", action="store_true", help="of the chunks of PNG files")
    p.add_argument("--parallel", type=int, help="number of partitions")
    for flag in ("gray", "recursive", "skip-existing", "keep-metadata"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def encoder_options(said: argparse.Namespace) -> dict:
    """Those of the chosen format; others would be refused by its encoder."""
    options: dict = {}
    if said.quality is not None:
        options["quality"] = said.quality
    if said.subsample is not None:
        options["subsample"] = said.subsample == "420"
    if said.lossless:
        options["lossless"] = True
    if said.dithering:
        options["dither"] = True
    taken = {"jpeg": ("quality", "subsample"), "webp": ("quality", "lossless"), "gif": ("dither",)}.get(said.to, ())
    return {k: v for k, v in options.items() if k in taken}


def reader_options(said: argparse.Namespace) -> dict[str, dict]:
    options: dict[str, dict] = {}
    jpeg = {k: v for k, v, given in (("linear", True, said.linear_chroma), ("integer", False, said.idct == "float")) if given}
    if jpeg:
        options["jpeg"] = jpeg
    if said.check_crc:
        options["png"] = {"check": True}
    return options


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """How many files failed, 1 at most."""
    said = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("pixelloom").getOrCreate()
    told = convert(spark, said.source, said.out, said.to, tuple(said.operations), said.recursive, said.skip_existing, said.gray, said.files, said.keep_metadata, said.frames, reader_options(said) or None, said.parallel, **encoder_options(said)).collect()
    for row in told:
        print(f"{row.status}: {row.n}")
    return min(1, sum(row.n for row in told if row.status != "ok"))


if __name__ == "__main__":
    raise SystemExit(main())
