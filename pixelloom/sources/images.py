"""Images as DataFrames: scan a directory, tell formats by their first bytes, decode, encode, write."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.codecs import bmp, gif, jpeg, png, webp
from pixelloom.operators import raster

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "gif")
#: First bytes by format, in the order in which formats are tried.
MAGIC = {"jpeg": "FFD8", "png": "89504E470D0A1A0A", "bmp": "424D", "webp": "52494646", "gif": "474946"}
DECODERS: dict[str, Callable[..., np.ndarray]] = {
    "png": lambda d, **options: png.decode(d, alpha=True, **options),
    "bmp": bmp.decode,
    "webp": webp.decode,
    "gif": lambda d: gif.decode(d, 1)[0][0],
    "jpeg": lambda d, **options: jpeg.decode(d, upright=True, **options),
}
ENCODERS: dict[str, Callable[..., bytes]] = {"png": png.encode, "bmp": bmp.encode, "webp": webp.encode, "gif": lambda image, **options: gif.encode([image], **options), "jpeg": jpeg.encode}
#: (canvas, duration in ms) of each frame, and frames put together, of the formats that have animations.
FRAMES: dict[str, Callable[[bytes], list]] = {"gif": gif.decode, "webp": webp.decode_frames}
ANIMATIONS: dict[str, Callable[..., bytes]] = {"gif": gif.encode, "webp": webp.animation}
#: What a format tells besides its pixels, and which of it others can store.
METADATA: dict[str, Callable[[bytes], dict]] = {"png": png.metadata, "bmp": bmp.metadata, "jpeg": jpeg.metadata}
STORES = {"png": ("exif", "icc", "srgb"), "jpeg": ("exif", "icc"), "bmp": ("ppm", "ppm_y")}
META = {"exif": pa.binary(), "icc": pa.binary(), "srgb": pa.bool_(), "ppm": pa.int32(), "ppm_y": pa.int32()}
RASTER = "path string, fmt string, width int, height int, channels int, buf binary, status string, error string"
TOLD = "exif binary, icc binary, srgb boolean, ppm int, ppm_y int"


def register(fmt: str, decoder: Callable | None = None, encoder: Callable | None = None) -> None:
    """Puts another codec in the place of a format's."""
    if decoder:
        DECODERS[fmt] = decoder
    if encoder:
        ENCODERS[fmt] = encoder


def sniffed(content: Column) -> Column:
    """The format by the first bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    found: Column = F.lit(None).cast("string")
    for fmt, magic in reversed(MAGIC.items()):
        fits = head.startswith(magic)
        found = F.when(fits & (F.substring(head, 17, 8) == "57454250") if fmt == "webp" else fits, F.lit(fmt)).otherwise(found)
    return found


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content, fmt) of the files under ``path`` that have an image's extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))
    return named.select("path", "content", sniffed(F.col("content")).alias("fmt"))


def told_by(fmt: str, content: bytes) -> dict:
    """Metadata of a file whose pixels are upright by now; none if it can't be read."""
    try:
        found = METADATA[fmt](content) if fmt in METADATA else {}
    except Exception:
        return {}
    return found | {"exif": jpeg.set_upright(found["exif"])} if "exif" in found else found


def decoded(files: DataFrame, metadata: bool = False, options: dict[str, dict] | None = None) -> DataFrame:
    """Rasters of (path, content, fmt); a file that can't be read gets an error and no raster, and stops nothing.

    With ``metadata`` the columns of ``TOLD`` follow: EXIF with orientation 1, as pixels are turned upright, ICC profile, the
    mark of sRGB and pixels a metre, null where a file doesn't give them. ``options`` go to decoders by format, as
    ``{"png": {"check": True}, "jpeg": {"linear": True}}``.
    """
    decoders, chosen = dict(DECODERS), options or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, fmt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if fmt not in decoders:
                        raise ValueError("unknown format" if fmt is None else f"no codec for {fmt}")
                    image = decoders[fmt](content, **chosen.get(fmt, {}))
                    rows.append((path, fmt, image.shape[1], image.shape[0], image.shape[2], image.astype(np.uint8).tobytes(), "ok", None))
                except Exception as e:
                    rows.append((path, fmt, None, None, None, None, "failed", f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            names = ["path", "fmt", "width", "height", "channels", "buf", "status", "error"]
            if metadata:
                told = [told_by(row[1], content) if row[6] == "ok" else {} for row, content in zip(rows, batch.column(1).to_pylist(), strict=True)]
                columns += [pa.array([t.get(k) for t in told], kind) for k, kind in META.items()]
                names += META
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("path", "content", "fmt").mapInArrow(run, f"{RASTER}, {TOLD}" if metadata else RASTER)


def frames(files: DataFrame) -> DataFrame:
    """One row per frame of (path, content, fmt), disposals applied: a raster and its frame, duration_ms and name.

    Files that aren't animated have one frame. The name is that of the file with the frame's number, of three digits at
    least. A file that can't be read has one row with an error.
    """
    decoders = dict(DECODERS)
    kinds = [("path", pa.string()), ("fmt", pa.string()), ("frame", pa.int32()), ("duration_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("buf", pa.binary()), ("status", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, fmt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if fmt not in decoders:
                        raise ValueError("unknown format" if fmt is None else f"no codec for {fmt}")
                    found = FRAMES[fmt](content) if fmt in FRAMES else [(decoders[fmt](content), 0)]
                    rows = [(path, fmt, k, ms, image.shape[1], image.shape[0], image.shape[2], image.astype(np.uint8).tobytes(), "ok", None) for k, (image, ms) in enumerate(found)]
                except Exception as e:
                    rows = [(path, fmt, *[None] * 6, "failed", f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in kinds), row, strict=True)) for row in rows], schema=pa.schema(kinds))

    made = files.select("path", "content", "fmt").mapInArrow(run, "path string, fmt string, frame int, duration_ms int, width int, height int, channels int, buf binary, status string, error string")
    digits = F.when(F.col("frame") < 1000, F.lpad(F.col("frame").cast("string"), 3, "0")).otherwise(F.col("frame").cast("string"))
    return made.withColumn("name", F.concat(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1), F.lit("_"), digits))


def animated(files: DataFrame, fmt: str, **options) -> DataFrame:
    """(path, content, status, error): files (path, content, fmt) as animations of a format that has them, frame by frame as
    they are shown; files that aren't animated become stills. A file is one task's work from end to end."""
    join, decoders = ANIMATIONS[fmt], dict(DECODERS)

    def one(content: bytes, kind: str | None) -> bytes:
        if kind not in decoders:
            raise ValueError("unknown format" if kind is None else f"no codec for {kind}")
        found = FRAMES[kind](content) if kind in FRAMES else [(decoders[kind](content), 0)]
        return join([image for image, _ in found], [ms for _, ms in found], **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for content, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    made.append((one(content, kind), "ok", None))
                except Exception as e:
                    made.append((None, "failed", f"{type(e).__name__}: {e}"))
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["path", "content", "status", "error"])

    return files.select("path", "content", "fmt").mapInArrow(run, "path string, content binary, status string, error string")


def encoded(rasters: DataFrame, fmt: str, gray: bool = False, **options) -> DataFrame:
    """(path, content) of those that ``encoded_or_not`` could encode."""
    return encoded_or_not(rasters, fmt, gray, **options).where("status = 'ok'").select("path", "content")


def encoded_or_not(rasters: DataFrame, fmt: str, gray: bool = False, **options) -> DataFrame:
    """(path, content, status, error), and source where the rasters have it: rasters as files of a format; formats without alpha drop it.

    A raster that can't be encoded, or was none, has no content and an error, and stops nothing. With ``gray`` the gray level
    is stored, in one channel where the format has that. ``options`` go to the encoder, as ``quality`` and ``subsample`` of
    JPEG. Metadata that the rasters carry, and that the format can store, goes into the file, but not with ``gray``.
    """
    encoder = ENCODERS[fmt]
    stored = [] if gray else [k for k in STORES.get(fmt, ()) if k in rasters.columns]
    origin = ["source"] if "source" in rasters.columns else []

    def file_of(told: dict, w: int, h: int, n: int, buf: bytes) -> bytes:
        image = np.frombuffer(buf, np.uint8).reshape(h, w, n)
        if gray:
            image = raster.grayscale(image)
            image = image[:, :, 0] if fmt in ("bmp", "png", "jpeg") else image
        elif fmt == "bmp":
            image = image[:, :, :3]
        return encoder(image, **{k: v for k, v in told.items() if v is not None}, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for *shape, status, error, told in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), batch.select(stored).to_pylist() if stored else [{}] * len(batch), strict=True):
                try:
                    made.append((file_of(told, *shape), "ok", None) if status == "ok" else (None, status, error))
                except Exception as e:
                    made.append((None, "failed", f"{type(e).__name__}: {e}"))
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *(batch.column(c) for c in origin)], names=["path", "content", "status", "error", *origin])

    return rasters.select("path", "width", "height", "channels", "buf", "status", "error", *stored, *origin).mapInArrow(run, "path string, content binary, status string, error string" + ", source string" * len(origin))


def output_names(files: DataFrame, taken: DataFrame, extension: str) -> DataFrame:
    """``files`` with name: that of the path with another extension, numbered ``name (1)`` and so on where it is taken.

    ``taken`` holds the names in the folder. Files that would share a name are numbered in the order of their paths, from
    past the highest number in use.
    """
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    numbered = r"^(.*?)( \((\d{1,9})\))?\.[^.]*$"
    used = taken.where(F.col("name").endswith("." + extension)).select(F.regexp_extract("name", numbered, 1).alias("stem"), F.coalesce(F.expr(r"try_cast(regexp_extract(name, '^(.*?)( \\((\\d{1,9})\\))?\\.[^.]*$', 3) AS INT)"), F.lit(0)).alias("n"))
    highest = used.groupBy("stem").agg(F.max("n").alias("highest"))
    placed = files.withColumn("stem", stem).join(highest, "stem", "left")
    n = F.row_number().over(Window.partitionBy("stem").orderBy("path")) - 1 + F.coalesce(F.col("highest") + 1, F.lit(0))
    return placed.withColumn("name", F.concat("stem", F.when(n > 0, F.format_string(" (%d)", n)).otherwise(""), F.lit("." + extension))).drop("stem", "highest")


def names_in(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "name string")
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def saved(files: DataFrame, folder: str, extension: str) -> DataFrame:
    """(path, name, status, error): content written as image files into a folder that executors share, none of them overwritten.

    Each is written under a name of its own and then put in its place, so that a task that is run again leaves no half file;
    a name that is there with the same bytes is its own earlier run. A file that can't be written has an error and stops
    nothing.
    """
    spark = files.sparkSession
    folder = folder.removeprefix("file://")
    named = output_names(files.where("status = 'ok'"), names_in(spark, folder), extension).select("path", "name", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, part = os.path.join(folder, name), os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                try:
                    with open(part, "xb") as f:
                        f.write(content)
                    try:
                        os.link(part, at)  # fails where a file is, as a rename doesn't
                    except FileExistsError:
                        with open(at, "rb") as f:
                            if f.read() != content:
                                raise
                    finally:
                        os.unlink(part)
                    out.append((path, name, "ok", None))
                except OSError as e:
                    out.append((path, name, "failed", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(4)], names=["path", "name", "status", "error"])

    return named.mapInArrow(run, "path string, name string, status string, error string")


def round_trip(pixels: DataFrame, through: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pixels (image_id, w, h, x, y, r, g, b) put together to images, sent through a codec and taken apart again."""
    images = pixels.groupBy("image_id", "w", "h").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p")).select("image_id", "w", "h", *(F.col(f"p.{c}").alias(c) for c in "rgb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, w, h, *planes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = through(np.stack([np.array(p, np.uint8) for p in planes], axis=1).reshape(h, w, 3)).reshape(h * w, -1)
                at = np.arange(h * w, dtype=np.int32)
                columns = [pa.array([image_id] * (h * w), pa.int64()), pa.array(at % w), pa.array(at // w), *(pa.array(got[:, i].astype(np.int32)) for i in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "x", "y", "r", "g", "b"])

    return images.mapInArrow(run, "image_id long, x int, y int, r int, g int, b int")
