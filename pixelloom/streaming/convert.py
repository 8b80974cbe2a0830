"""A folder that images are dropped into, converted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelloom.sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def convert(spark: SparkSession, drop: str, out: str, checkpoint: str, fmt: str = "png") -> StreamingQuery:
    """Each new file is decoded and written to ``out`` as Parquet (path, content) in ``fmt``; stateless, so no watermark."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(drop).select("path", "content", images.sniffed(F.col("content")).alias("fmt"))

    def one(batch: DataFrame, number: int) -> None:
        images.encoded(images.decoded(batch), fmt).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
