"""Deterministic images made from the driver tables: one row per image, or one row per pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explode_grid(images: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """One row per (x, y) of each image, made row by row inside the task that holds the image: no shuffle."""
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col(h) - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col(w) - 1)))


def ramp(pos: Column, size: Column) -> Column:
    return F.when(size <= 1, F.lit(0)).otherwise(F.expr("0") + F.floor(pos * 255 / F.greatest(size - 1, F.lit(1)))).cast("int")


def gradient_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        (4 + F.col("p_size") % 13).cast("int").alias("w"),
        (3 + F.col("p_size") % 7).cast("int").alias("h"),
    )


#: Alpha by image: none, the left half transparent, a diagonal pattern of two levels.
ALPHA = "CASE image_id % 3 WHEN 0 THEN 255 WHEN 1 THEN CASE WHEN x < w DIV 2 THEN 0 ELSE 255 END ELSE CASE WHEN (x + y) % 3 = 0 THEN 100 ELSE 200 END END"


def pixels_of(images: DataFrame) -> DataFrame:
    """Gradient fixture: red along x, green along y, blue their mean; alpha as ALPHA says."""
    p = explode_grid(images)
    p = p.withColumns({"r": F.expr("CAST(x * 255 DIV (w - 1) AS INT)"), "g": F.expr("CAST(y * 255 DIV (h - 1) AS INT)")})
    return p.withColumns({"b": F.expr("CAST((r + g) DIV 2 AS INT)"), "a": F.expr(ALPHA)})


def gradient_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels_of(gradient_images(spark, sf_dir))


def planes(image_id: np.ndarray, w: int, h: int) -> np.ndarray:
    """The pixels of images of one size as whole numbers by (channel, image, y, x), channels as in ``pixels_of``."""
    y, x = np.indices((h, w))
    r, g = x * 255 // (w - 1), y * 255 // (h - 1)
    kinds = np.stack([np.full((h, w), 255), np.where(x < w // 2, 0, 255), np.where((x + y) % 3 == 0, 100, 200)])
    shape = (len(image_id), h, w)
    kind = np.where(np.fmod(image_id, 3) < 0, 2, np.fmod(image_id, 3))
    return np.stack([*(np.broadcast_to(c, shape) for c in (r, g, (r + g) // 2)), kinds[kind]])


def dealt(images: DataFrame) -> DataFrame:
    """Images dealt out by id, not their pixels, into a fixed number of parts: their pixels are many times what the engine takes
    them for, so parts must not be joined because they look small."""
    spark = images.sparkSession
    return images.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "image_id")


def told_apart(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images that alone have their id and are two pixels wide and high at least, and the others: few or none, as ids are keys."""
    counted = dealt(images).withColumn("copies", F.count("*").over(Window.partitionBy("image_id")))
    alone = F.coalesce(F.expr("image_id IS NOT NULL AND copies = 1 AND w >= 2 AND h >= 2"), F.lit(False))
    return counted.where(alone).drop("copies"), counted.where(~alone).drop("copies")


def channels_of(pixels: DataFrame) -> DataFrame:
    """The pixels by channel: c from 0 to 2, v."""
    return pixels.select("image_id", "w", "h", "x", "y", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))


def frames_of(pixels: DataFrame) -> DataFrame:
    """Animations of one to four frames: red moves on by 20 a frame, and a pattern of pixels that moves along is transparent."""
    p = pixels.withColumn("frame", F.explode(F.expr("sequence(0, CAST(image_id % 4 AS INT))")))
    return p.select("image_id", "frame", "w", "h", "x", "y", F.expr("(r + 20 * frame) % 256").alias("r"), "g", "b", F.expr("(x + y + frame) % 3 <> 0").alias("visible"))


GRADIENT_SQL = f"""
WITH im AS MATERIALIZED (SELECT p_partkey AS image_id, CAST(4 + p_size % 13 AS INT) AS w, CAST(3 + p_size % 7 AS INT) AS h FROM part),
xy AS (SELECT image_id, w, h, CAST(x AS INT) AS x, CAST(y AS INT) AS y
       FROM im, LATERAL (SELECT unnest(range(w)) AS x), LATERAL (SELECT unnest(range(h)) AS y)),
rg AS (SELECT *, CAST(x * 255 // (w - 1) AS INT) AS r, CAST(y * 255 // (h - 1) AS INT) AS g FROM xy),
px AS MATERIALIZED (SELECT *, CAST((r + g) // 2 AS INT) AS b, CAST({ALPHA.replace(" DIV ", " // ")} AS INT) AS a FROM rg),
pc AS (SELECT image_id, w, h, x, y, 0 AS c, r AS v FROM px UNION ALL SELECT image_id, w, h, x, y, 1, g FROM px UNION ALL SELECT image_id, w, h, x, y, 2, b FROM px),
fr AS (SELECT image_id, CAST(f AS INT) AS frame, w, h, x, y, CAST((r + 20 * f) % 256 AS INT) AS r, g, b, (x + y + f) % 3 <> 0 AS visible FROM px, LATERAL (SELECT unnest(range(CAST(image_id % 4 AS INT) + 1)) AS f))
"""
