"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastelake.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from tastelake.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The target is the documents rated good, the raw corpus all of ``docs``."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
    return quality_rules.quality(docs, trusted).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that stand earlier; n_chars is that of the text left."""
    left = line_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents: doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text."""
    done = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded", keep=["doc_id", "source", "lang"])
    return done.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near), ("decontamination", benchmark), ("encoding", encoded)]

#: the near-duplicate and encoding stages are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
