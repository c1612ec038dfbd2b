"""The registered queries of the training-data operators: each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastelake.llm import (bpe, chat, classifier, decontamination, html_text, jaccard_join, line_dedup, quality_rules, suffix_dedup, token_counts,
                           url_reputation, vector_codes, whitening)

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: the conversation that shows the escaping (fixed value)
PROBE = "\\### Assistant: </turn> ok"


@query
def op3_chat_formatting(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns.unionByName(probe))
    read = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.parse(F.col("formatted")).alias("turns"),
                       chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
                       "formatted_chars")


@query
def op4_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, classifier.graded(_table(spark, sf_dir, "labels")), 3)
    return classifier.score(docs, model, good=2, keep=["doc_id"])


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


@query
def op5_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality(docs, _trusted(spark, sf_dir), keep=["doc_id"]).drop("log_ratio")


@query
def op6_bpe(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded", keep=["doc_id"])
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op7_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="first")


#: host, path prefix, verdict (fixed values)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]


#: public suffixes of two labels (fixed values)
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")


@query
def op8_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    outcomes = pages.join(labels, "page_id").select(url_reputation.host_of(F.col("url")).alias("host"), "good")
    return url_reputation.judged(pages, outcomes, RULES, SUFFIXES).drop("bound")


@query
def op1_decontamination(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontamination.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.without_repeats(docs)
    return done.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query
def op10_suffix_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = suffix_dedup.without_repeated_bytes(docs, keep=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")


@query
def op11_vector_codes(spark, sf_dir):
    done, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return done.withColumn("codebooks_sha256", F.lit(vector_codes.books_digest(books)))


@query
def op12_embedding_whitening(spark, sf_dir):
    done, model = whitening.whiten(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return whitening.by_component(done, model, ["vec_id"]).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_html_text(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
