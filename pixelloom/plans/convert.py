"""A directory of images converted: scanned, decoded, changed, encoded and written, with errors file by file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import raster
from pixelloom.sources import images

#: Extensions of files where they aren't the format's name.
EXTENSIONS = {"jpeg": "jpg"}


def applied(rasters: DataFrame, operations: list[str]) -> DataFrame:
    """Operations on decoded rasters, in order; none, and nothing is run. They work on three channels, so alpha is dropped."""
    steps = [raster.operation(o) for o in operations]
    if not steps:
        return rasters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["status"] == "ok":
                    try:
                        image = np.frombuffer(row["buf"], np.uint8).reshape(row["height"], row["width"], row["channels"])[:, :, :3]
                        for step in steps:
                            image = step(image)
                        row |= {"width": image.shape[1], "height": image.shape[0], "channels": 3, "buf": np.ascontiguousarray(image).tobytes()}
                    except Exception as e:
                        row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return rasters.mapInArrow(run, rasters.schema)


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def by_frame(files: DataFrame) -> DataFrame:
    """Rasters of every frame, under the path of its file with the frame's number; files without animation keep theirs."""
    found = images.frames(files)
    several = F.col("fmt").isin(*images.FRAMES) & F.col("name").isNotNull()
    folder, extension = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    return found.withColumn("source", F.col("path")).withColumn("path", F.when(several, F.concat(folder, "name", extension)).otherwise(F.col("path"))).drop("frame", "duration_ms", "name")


def convert(
    spark: SparkSession,
    source: str,
    out: str,
    fmt: str = "png",
    operations: tuple[str, ...] = (),
    recursive: bool = False,
    skip_existing: bool = False,
    gray: bool = False,
    files: str | None = None,
    keep_metadata: bool = False,
    frames: str = "first",
    reading: dict[str, dict] | None = None,
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """Writes (path, source, content) in ``fmt`` to the table ``out``, a partition a run, and returns (status, n) of this run.

    Sources that are in ``out`` can be skipped; ``gray`` and ``options`` are those of ``images.encoded_or_not``. Files are read,
    decoded and encoded once; what fails is counted on the way. With ``files`` the contents go to image files in that folder
    too, see ``images.saved``. ``keep_metadata`` carries over what both formats can store, the orientation as 1. Of animations
    ``frames`` takes the "first", "each" as an image of its own under a numbered path, or "all" as an animation, where the
    format has that; "all" takes no operations, "each" and "all" no metadata. ``reading`` holds options of decoders by format,
    ``partitions`` deals the files out anew.
    """
    if frames not in ("first", "each", "all"):
        raise ValueError(f"unknown choice of frames: {frames}")
    if frames == "all" and (fmt not in images.ANIMATIONS or operations or gray):
        raise ValueError("animations go to GIF or WebP, without operations")
    if frames != "first" and (keep_metadata or reading):
        raise ValueError("metadata and options of decoders are for first frames")
    found = images.scan(spark, source, recursive)
    if skip_existing and there(spark, out):
        found = found.join(spark.read.parquet(out).select(F.col("source").alias("path")), "path", "left_anti")
    if partitions:
        found = found.repartition(partitions)
    run, seen = uuid.uuid4().hex, Observation()
    if frames == "all":
        made = images.animated(found, fmt, **options)
    else:
        rasters = images.decoded(found, keep_metadata, reading) if frames == "first" else by_frame(found)
        made = images.encoded_or_not(applied(rasters, list(operations)), fmt, gray, **options)
    counted = made.observe(seen, F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
    counted.where("status = 'ok'").select("path", F.col("source") if "source" in made.columns else F.col("path").alias("source"), "content", F.lit(run).alias("run")).write.mode("append").partitionBy("run").parquet(out)
    told = dict(seen.get)
    if files is not None and told["ok"]:
        made = spark.read.parquet(out).where(F.col("run") == run).withColumn("status", F.lit("ok"))
        saved = {r.status: r.n for r in images.saved(made, files, EXTENSIONS.get(fmt, fmt)).groupBy("status").agg(F.count("*").alias("n")).collect()}
        told = {"ok": saved.get("ok", 0), "failed": told["failed"] + saved.get("failed", 0)}
    return spark.createDataFrame([(k, n) for k, n in told.items() if n], "status string, n long")
