"""Benchmark decontamination by winnowed fingerprints (operator 1). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastelake.llm.winnowing import (gram_hashes, hashes, merged, places, plain_words, runs, text_key, total_length, window_minima)
from tastelake.session import materialise

WINDOW = 10     # words of a shared span that must be found
GRAM = 5        # words of a fingerprint; WINDOW - GRAM + 1 neighbouring ones make a window
BROADCAST_ROWS = 1_000_000


def _probes(words: DataFrame, window: int, gram: int, lengths: list[int]) -> DataFrame:
    """``words`` with ``_probes``: (start, run, fp, len) of all selected fingerprints.

    ``run`` windows of ``len`` words from ``start`` select the fingerprint ``fp``. Windows of ``window`` words select the
    least hash of their ``gram``-word grams, so equal windows select alike wherever they stand. The few lengths below
    ``window`` that short items have use the whole window as gram.
    """
    hashed = words.withColumn("_h", hashes(F.col("_words")))
    selected = hashed.withColumn("_g", gram_hashes("_h", gram)).withColumn("_m", window_minima("_g", window - gram + 1))
    found = [F.transform(runs("_m"), lambda r: F.struct(r["start"].alias("start"), r["run"].alias("run"), r["fp"].alias("fp"), F.lit(window).alias("len")))]
    for n in lengths:
        whole = F.transform(places(F.size("_h") - (n - 1)), lambda i: F.struct(
            i.alias("start"), F.lit(1).alias("run"), F.xxhash64(*[F.get("_h", i + k) for k in range(n)]).alias("fp"), F.lit(n).alias("len")))
        found.append(whole)
    return selected.withColumn("_probes", F.concat(*found)).drop("_h", "_g", "_m")


def _windows(probes: DataFrame) -> DataFrame:
    """One row per exploded probe window: start, len, and its words as one string."""
    each = probes.withColumn("_at", F.explode_outer(F.sequence(F.col("_p.start"), F.col("_p.start") + F.col("_p.run") - 1)))
    return each.select(*[c for c in probes.columns if c not in ("_p", "_words")], F.col("_at").alias("start"), F.col("_p.len").alias("len"),
                       F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_p.len")), " ").alias("win"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id, len, fp, win: the windows of all items. An item of fewer words than ``window``, but not none, is one."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("_words"))
    n = F.size("_words")
    long = _probes(words.filter(n >= window), window, gram, [])
    long = _windows(long.select("item_id", "_words", F.explode_outer("_probes").alias("_p")).withColumn("fp", F.col("_p.fp")))
    short = words.filter((n > 0) & (n < window)).withColumn("_h", hashes(F.col("_words")))
    by_length = F.coalesce(*[F.when(F.size("_h") == k, F.xxhash64(*[F.get("_h", F.lit(i)) for i in range(k)])) for k in range(1, window)])
    short = short.select("item_id", F.size("_words").alias("len"), by_length.alias("fp"), F.array_join("_words", " ").alias("win"))
    return long.select("item_id", "len", "fp", "win").unionByName(short).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, key, start, len, item_id: every occurrence of an item's window in a document, as word positions.

    Fingerprints of documents meet those of the benchmark; around each meeting all windows that select the
    fingerprint are compared word by word. Every shared span of ``window`` words is found. The benchmark's windows
    are broadcast while they are at most ``broadcast_rows``, else shuffled; then documents send fingerprints, and
    words of the met ones only.
    """
    items = materialise(item_windows(benchmark, window, gram), "benchmark-windows")
    lengths = [r[0] for r in items.filter(F.col("len") < window).select("len").distinct().orderBy("len").collect()]  # window - 1 at most
    small = items.count() <= broadcast_rows
    near = F.broadcast if small else (lambda df: df)
    prints = near(items.select(F.col("fp").alias("_fp"), F.col("len").alias("_len")).distinct())
    words = docs.select("doc_id", text_key().alias("key"), plain_words(F.col("text")).alias("_words"))
    probes = _probes(words, window, gram, lengths)

    def met(df: DataFrame) -> DataFrame:
        return df.join(prints, (F.col("_p.fp") == F.col("_fp")) & (F.col("_p.len") == F.col("_len"))).drop("_fp", "_len")

    if small:
        candidates = met(probes.select("doc_id", "key", "_words", F.explode_outer("_probes").alias("_p")))
    else:
        places_met = met(probes.select("doc_id", "key", F.explode_outer("_probes").alias("_p"))).distinct()
        mine = places_met.groupBy("doc_id", "key").agg(F.collect_list("_p").alias("_ps")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "_ps")
        candidates = words.join(mine, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select(
            "doc_id", "key", "_words", F.explode_outer("_ps").alias("_p"))
    found = _windows(candidates)
    wins = near(items.select(F.col("win").alias("_win"), F.col("len").alias("_len"), "item_id").distinct())
    return found.join(wins, (F.col("win") == F.col("_win")) & (F.col("len") == F.col("_len"))).select("doc_id", "key", "start", "len", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, spans (word positions from start to before end), items (sorted).

    :param docs: doc_id, text; other columns are ignored, whatever their names.
    :param benchmark: item_id, text.

    A word inside any occurrence of an item's window is hit. Null or empty texts have no words and no hits; null or
    empty items have no windows; an item with a null id has hits but no name in ``items``. Repeated rows of documents
    stay, each with the same result, and repeated items count once. Empty tables give no rows, or no hits. Long texts
    are read whole.
    """
    found = materialise(hits(docs, benchmark, window, gram, broadcast_rows), "hits")
    spans = merged(found.withColumn("end", F.col("start") + F.col("len")), ["doc_id", "key"])
    named = found.select("doc_id", "key", "item_id").distinct().groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    per_doc = spans.join(named.withColumnsRenamed({"doc_id": "_d", "key": "_k"}),
                         F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).drop("_d", "_k")
    per_doc = per_doc.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    base = docs.select("doc_id", text_key().alias("key"), F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return joined.select("doc_id", "key", "n_words", F.coalesce(total_length(F.col("spans")), F.lit(0)).alias("n_hit"),
                         F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item."""
    bad = hits(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_d")) & (text_key() == F.col("_k")), "left_anti")
