"""Column expressions for winnowing, and the key that names a row's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_key() -> Column:
    """Tells rows of one doc_id apart by their text; exact repeats of a row share it."""
    return F.xxhash64("doc_id", "text")


def plain_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z; none of a null text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def places(count: Column) -> Column:
    """0 .. count - 1 as an array; empty for count <= 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def hashes(values: Column) -> Column:
    return F.transform(values, lambda v: F.xxhash64(v))


def gram_hashes(of: str, n: int) -> Column:
    """Hashes of ``n`` consecutive entries of the hash column ``of``."""
    return F.transform(places(F.size(of) - (n - 1)), lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(n)]))


def window_minima(of: str, window: int) -> Column:
    """The least of ``window`` consecutive entries, for every window."""
    if window == 1:
        return F.col(of)
    return F.transform(places(F.size(of) - (window - 1)), lambda i: F.least(*[F.get(of, i + k) for k in range(window)]))


def runs(of: str) -> Column:
    """(start, run, fp) of the runs of equal entries: a selected fingerprint, and the windows that select it."""
    starts = F.filter(places(F.size(of)), lambda i: (i == 0) | (F.get(of, i) != F.get(of, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(of)))
    return F.zip_with(starts, F.slice(ends, 1, F.size(starts)),
                      lambda s, e: F.struct(s.alias("start"), (e - s).alias("run"), F.get(of, s).alias("fp")))


def merged(spans: DataFrame, by: list[str], shown: tuple[str, str] = ("start", "end")) -> DataFrame:
    """``by`` and spans: the union of the rows' (start, end) as maximal spans in order, one row per ``by``. The spans hold the least and the
    greatest of the columns ``shown``.

    A running maximum over the sorted rows, so the work grows with their number times its logarithm. The spans of one ``by`` meet
    in one task: they lie in one text.
    """
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select(*by, *{"start": 0, "end": 0, shown[0]: 0, shown[1]: 0}).distinct().withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy(*by, "_run").agg(F.min(shown[0]).alias("start"), F.max(shown[1]).alias("end"))
    return whole.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def total_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
