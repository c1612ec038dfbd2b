"""Deletion of repeated runs of lines by winnowed line hashes (operator 9). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastelake.llm.winnowing import hashes, merged, places, runs, text_key, total_length
from tastelake.session import materialise

RUN_CHARS = 50      # characters a repeated run of whole lines needs; every such run is found


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, _at (numbers of the lines that are not blank), _lines (these lines)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: F.trim(x["line"]) != "")
    return docs.select("doc_id", text_key().alias("key"), kept.alias("_l")).select(
        "doc_id", "key", F.col("_l.i").alias("_at"), F.col("_l.line").alias("_lines"))


def _steps(at: Column, sign: int, run_chars: int) -> Column:
    """How many lines behind (sign 1) or before (-1) line ``at`` a run of ``run_chars`` characters takes; null if the text ends first."""
    size = F.get("_n", at)
    start = F.struct(size.alias("sum"), F.lit(0).alias("steps"))

    def take(done: Column, k: Column) -> Column:
        more = F.struct((done["sum"] + F.coalesce(F.get("_n", at + sign * k), F.lit(0))).alias("sum"), k.alias("steps"))
        return F.when(done["sum"] >= run_chars, done).otherwise(more)

    # a line that is not blank has a character, so run_chars lines are enough
    far = F.aggregate(F.sequence(F.lit(1), F.lit(max(run_chars - 1, 1))), start, take, lambda x: F.when(x["sum"] >= run_chars, x["steps"]))
    return F.when(size >= run_chars, F.lit(0)).otherwise(far)


def _fingerprints(lines: DataFrame, run_chars: int) -> DataFrame:
    """doc_id, key, at, fp, _reach: the selected line hashes with their positions, one row each.

    The windows are the shortest runs of lines with ``run_chars`` characters from a line on, and up to a line. Each selects its least line
    hash (the first of equal ones); neighbours mostly select the same. ``_reach`` holds the windows that select the
    line, as it extends to both sides: start, end (among the lines that are not blank), first, stop (line numbers) and a, b (hash of the text).
    """
    sized = lines.withColumns({"_h": hashes(F.col("_lines")), "_n": F.transform("_lines", lambda x: F.length(F.trim(x)))})
    steps = sized.withColumns({"_e": F.transform(places(F.size("_n")), lambda i: i + _steps(i, 1, run_chars)),
                               "_s": F.transform(places(F.size("_n")), lambda i: i - _steps(i, -1, run_chars))})
    pair = lambda first, last: F.struct(first.alias("x"), last.alias("y"))
    ahead = F.filter(F.transform("_e", lambda e, i: pair(i, e)), lambda w: w["y"].isNotNull())
    # up to a line, where this is not the shortest run from its first line
    behind = F.filter(F.transform("_s", lambda s, i: pair(s, i)), lambda w: w["x"].isNotNull() & (F.get("_e", w["x"]) < w["y"]))
    windows = steps.withColumn("_w", F.concat(ahead, behind))

    def least(w: Column) -> Column:
        inside = F.slice("_h", w["x"] + 1, w["y"] - w["x"] + 1)
        return F.when(w["x"] == w["y"], w["x"]).otherwise(w["x"] + F.array_position(inside, F.array_min(inside)).cast("int") - 1)

    selected = windows.withColumn("_m", F.transform("_w", least)).withColumn("_runs", runs("_m"))

    def extent(w: Column) -> Column:
        n = w["y"] - w["x"] + 1
        text = F.when(n == 1, F.get("_lines", w["x"])).otherwise(F.array_join(F.slice("_lines", w["x"] + 1, n), "\n"))
        return F.struct(w["x"].alias("start"), (w["y"] + 1).alias("end"), F.get("_at", w["x"]).alias("first"), (F.get("_at", w["y"]) + 1).alias("stop"),
                        F.xxhash64(n, text).alias("a"), F.xxhash64(text, -n).alias("b"))

    rows = F.transform("_runs", lambda r: F.struct(r["fp"].alias("at"), F.get("_h", r["fp"]).alias("fp"),
                                                   F.transform(F.slice("_w", r["start"] + 1, r["run"]), extent).alias("_reach")))
    return selected.select("doc_id", "key", F.explode(rows).alias("_r")).select("doc_id", "key", "_r.*")


def repeated_lines(docs: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """doc_id, key, spans: per document with repeats, the line numbers [start, end) to delete, as maximal spans in order.

    A run of consecutive lines (blank ones left out) with ``run_chars`` characters in all, spaces around lines not counted, is repeated if the same
    lines stand in a row earlier: in a document with a smaller doc_id, or further up in this one. Equal runs select equal fingerprints, so
    fingerprints that stand once are dropped with their surroundings. The others are extended both ways, run by run; of
    equal runs all but the first are marked, and marked runs that meet make one.
    """
    prints = materialise(_fingerprints(_lines(docs), run_chars), "line-fingerprints")
    # counts combine before the shuffle
    place = F.struct("doc_id", "key", "at")
    met = prints.groupBy("fp").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("fp")
    extended = prints.join(met, "fp", "left_semi").select("doc_id", "key", F.inline("_reach"))
    order = F.struct("doc_id", "key", "start")
    firsts = extended.groupBy("a", "b").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = extended.join(firsts, ["a", "b"]).filter(order > F.col("_first"))
    return merged(later, ["doc_id", "key"], ("first", "stop"))


def without_repeats(docs: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``, and n_lines, n_deleted, n_runs.

    The first occurrence of a run stays; order is by doc_id (null first), then text, then place. The blank lines
    between deleted lines go with them; other blank lines stay. A null text stays null and has one empty line, as an empty one has.
    Runs that overlap themselves count: of one short line over and over, the first stays.
    An exact repeat of a row (same doc_id and text) is the same document, so nothing is deleted from either because of the other. A text whose lines all go is empty. Empty tables stay empty; columns
    named like the new ones are replaced; texts are read whole.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "n_runs")]
    spans = repeated_lines(docs, run_chars).withColumnsRenamed({"doc_id": "_d", "key": "_k", "spans": "_spans"})
    joined = docs.select(*names).join(spans, docs["doc_id"].eqNullSafe(F.col("_d")) & (text_key() == F.col("_k")), "left")
    split = joined.withColumn("_l", F.split(F.coalesce("text", F.lit("")), "\n"))
    # what stands between the spans
    zero, end = F.array(F.lit(0)), F.array(F.size("_l"))
    gaps = F.zip_with(F.concat(zero, F.col("_spans.end")), F.concat(F.col("_spans.start"), end), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    left = F.flatten(F.transform(gaps, lambda g: F.slice("_l", g["a"] + 1, g["b"] - g["a"])))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return split.select(*[text.alias("text") if c == "text" else c for c in names], F.size("_l").cast("long").alias("n_lines"),
                        F.coalesce(total_length(F.col("_spans")), F.lit(0)).alias("n_deleted"),
                        F.greatest(F.coalesce(F.size("_spans"), F.lit(0)), F.lit(0)).cast("long").alias("n_runs"))
