"""Shared helpers: tables in the shared folder, text columns, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: While a table is written: what was shuffled for it goes as soon as it is there, and few texts at a time go to Python.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests in local mode) a temporary one, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="pixelloom-"))
    return "file://" + _own_folder[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    held = {key: spark.conf.get(key) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones can't clash with those an operator adds."""
    return docs.select(*names)


def aside(docs: DataFrame) -> list:
    """All columns under names of their place, which clash with none that an operator makes."""
    return [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]


def with_text(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, put aside in ``made``, with the new text ``said`` and its length as n_chars, whatever its type."""
    new = {"text": F.col("said"), "n_chars": F.length("said").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return made.select(*((new[c] if c in new else F.col(f"__{i}")).alias(c) for i, c in enumerate(docs.columns)))


#: Bits of the map that keeps most rows out of a shuffle: 2 MB, as at most 2^18 rows of 64 bits, at any size of corpus.
MAP_BITS = 1 << 24


def rows_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those rows whose ``key`` is in ``ids``, with the further columns of ``ids``.

    The ids grow with the corpus and aren't broadcast at any size, whatever Spark would choose for a small one. What is, is
    a bit map of fixed size of their hashes; it lets few other rows into the shuffle as long as the ids are far fewer than
    its bits, and never keeps a wanted row out.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    bits = ids.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    some = rows.withColumn("__at", place).join(F.broadcast(bits), F.shiftright("__at", 6) == F.col("word")).where("getbit(bits, CAST(__at & 63 AS INT)) = 1")
    return some.select(*rows.columns).join(ids.hint("merge"), key)


#: A key is hot from LEAST_HOT rows on, and from this part of all rows on; so there are at most so many hot keys.
LEAST_HOT, MOST_HOT = 1000, 100_000


def matched(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``table``, which is written, has one row a key, and says in ``n`` how many rows have that key.

    Rows of a hot key meet its entry in many tasks: the entry is repeated once a slice, as many slices as hold LEAST_HOT
    rows or more each. What is broadcast are the hot keys, at most MOST_HOT of them for any size of corpus.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    share = max(LEAST_HOT, total // MOST_HOT)
    hot = F.broadcast(table.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("__slices")))
    dealt = rows.join(hot, keys, "left").select(*rows.columns, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__slices")), F.lit(0)).cast("int").alias("__slice"))
    each = table.join(hot, keys, "left").select(*table.columns, F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1)).alias("__slice"))
    more = [c for c in table.columns if c not in keys]
    return dealt.join(each.hint("merge"), [*keys, "__slice"]).select(*rows.columns, *more)


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the two columns of ``edges``.

    Alternates large-star and small-star steps until the edges stay the same. Each step is a minimum per node, which is
    summed up before the shuffle, and a join on that node, whose large partitions Spark can split: no task has to hold a
    node's neighbours. Nothing but one count a round comes to the driver.
    """
    a, b = edges.columns
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = written(small, tag)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(e)
        e = after
        if mark == before:
            break
        before = mark
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
