"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pixelloom.llm import bpe, embeddings, licences, minhash, packing, quality, secrets, suffixes, toxicity, warc
from pixelloom.llm.vocabulary import default_vocabulary


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_quality(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(documents(spark, sf_dir), default_vocabulary()))


def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_suffixes(spark, sf_dir):
    return suffixes.digests(documents(spark, sf_dir))


def op6_secrets(spark, sf_dir):
    return secrets.digests(documents(spark, sf_dir))


def op7_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), default_vocabulary())


def op8_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_warc(spark, sf_dir):
    return warc.derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_licences(spark, sf_dir):
    return licences.scan(documents(spark, sf_dir))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_minhash, op2_quality, op3_bpe, op4_toxicity, op5_suffixes, op6_secrets, op7_packing, op8_embeddings, op9_warc, op10_licences, pipeline)}


def oracle_sql():
    return {}
