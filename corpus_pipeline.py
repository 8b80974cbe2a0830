"""The corpus pipeline: quality rules, near-dedup, removal of repeated passages, redaction of secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import minhash, packing, quality, secrets, suffixes
from pixelloom.llm.common import rows_of, written
from pixelloom.llm.vocabulary import default_vocabulary


#: The column that names a row within a stage.
ROW = "__row"


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of all columns, nulls told apart: only rows that are equal throughout share it."""
    return docs.withColumn(ROW, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. A verdict depends on text, language and source, so equal rows share theirs.

    Null and empty texts have no words and go; null ids, languages and sources are values like others. Repeated rows stay or
    go together; further columns stay, whatever their names; an empty table gives no rows.
    """
    rows = named(docs)
    gone = quality.judge(rows.withColumn("doc_id", F.col(ROW)).drop(ROW)).where("not kept").select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id; rows without words are alone and stay.

    Of repeated rows one stays, as they are copies; of rows with equal ids that of the least row hash; a null id stands after
    all others. Rows of null or empty text all stay. Further columns stay, whatever their names; an empty table gives no rows.
    """
    rows = named(docs)
    found = minhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).where("n_shingles > 0")
    members = written(found.groupBy(F.col("doc_id").alias(ROW), "component_id").agg(F.count("*").alias("copies")), "members")
    ids = rows.select(ROW, "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))[ROW]
    heads = written(members.join(ids, ROW).groupBy("component_id").agg(first.alias(ROW)).select(ROW), "heads")
    again = written(members.where("copies > 1").join(heads, ROW, "left_semi").select(ROW), "again")
    gone = members.select(ROW).join(heads, ROW, "left_anti").union(again)
    once = written(rows_of(rows, again, ROW), "copies").dropDuplicates([ROW])
    return rows.join(gone, ROW, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; null texts stay null, see ``suffixes.removed``."""
    return suffixes.removed(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced; rows without any stay as they are, see ``secrets.redacted``."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; null and empty texts are one end id each, repeated rows are packed each, see ``packing.pack``."""
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: The outlier estimates, the links and the tokens can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
