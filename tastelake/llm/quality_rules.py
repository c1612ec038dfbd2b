"""Quality rules: plain text measures and a hashed n-gram log-likelihood ratio (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tastelake.llm.textblocks import (LOWER, SPACED, PrimePowers, arrow_rows, blocks, counts, covered, grams, mixed, repeated, running,
                                      salted, spans, table)
from tastelake.session import materialise

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
REPEAT_WINDOW = 5
BUCKET_BITS = 16
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: counts added to a bucket of the target, spread as in the raw corpus: this share of the mean count per bucket, and so many at least
PRIOR_SHARE, PRIOR = 0.27, 10.0
TAIL = 0.001               # share of the trusted documents beyond whose ratio the threshold lies
DEVIATIONS = 4
STEP = 0.001               # ratios are counted in steps of this width
FILTER_WORDS = 1 << 20     # 64-bit words of the bitmap that keeps texts of other documents out of the shuffle


def measures(buf: np.ndarray, offsets: np.ndarray, powers: PrimePowers) -> dict[str, np.ndarray]:
    """The plain measures of each text."""
    n = len(offsets) - 1
    inside = SPACED[buf]
    starts, ends, rows = spans(inside, offsets)
    prefix = powers.prefixes(buf)
    words = powers.between(prefix, starts, ends)
    keys, first = grams(words, rows, REPEAT_WINDOW)
    _, twice = repeated(salted(keys, rows[first]))
    again = covered(first[twice], REPEAT_WINDOW, len(words))
    line_starts, line_ends, line_rows = spans(buf != 10, offsets)
    in_words = running(inside)
    real = in_words[line_ends] > in_words[line_starts]
    later, _ = repeated(salted(powers.between(prefix, line_starts[real], line_ends[real]), line_rows[real]))
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": counts(inside & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": counts(SYMBOLS[buf], offsets),
        "n_dup_lines": np.bincount(line_rows[real][later], minlength=n),
        "n_repeat_words": np.bincount(rows[again], minlength=n),
    }


def buckets(buf: np.ndarray, offsets: np.ndarray, powers: PrimePowers) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, lower-cased in A-Z, and their texts."""
    starts, ends, rows = spans(SPACED[buf], offsets)
    words = powers.between(powers.prefixes(LOWER[buf]), starts, ends)
    pairs, first = grams(words, rows, 2)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([mixed(words) >> shift, pairs >> shift]).astype(np.int64), np.concatenate([rows, rows[first]])


def _target(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """text of all trusted documents, written once.

    Of the other documents' texts a bitmap of the trusted ids, of at most FILTER_WORDS rows whatever the input, keeps most out of
    the shuffle; the join alone decides.
    """
    ids = trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_id")).filter("_id IS NOT NULL").distinct()

    def place(column: str) -> tuple[Column, Column]:
        h = F.xxhash64(column)
        return F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    word, bit = place("_id")
    bitmap = ids.select(word.alias("_w"), bit.alias("_bit")).groupBy("_w").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = place("doc_id")
    likely = docs.select("doc_id", "text", word.alias("_word"), bit.alias("_bit")).join(F.broadcast(bitmap), F.col("_word") == F.col("_w"))
    likely = likely.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select("doc_id", "text")
    # inner, as the ids are distinct: a semi join would be pushed below the bitmap; shuffled at every size
    return materialise(likely.join(ids.hint("merge"), F.col("doc_id") == F.col("_id")).select("text"), "trusted-texts")


def _counted(texts: DataFrame) -> np.ndarray:
    """Words and word pairs per bucket. Each task adds up its texts; the driver gets 2^BUCKET_BITS rows at most."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = PrimePowers(), np.zeros(size, np.int64)
        for batch in batches:
            for _, _, buf, offsets in blocks(batch.column(0)):
                total += np.bincount(buckets(buf, offsets, powers)[0], minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    total = np.zeros(size)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def _prior(target: np.ndarray) -> float:
    return max(PRIOR, PRIOR_SHARE * target.sum() / len(target))


def _ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    expected, prior = raw * target.sum() / max(raw.sum(), 1), _prior(target)
    return np.log((target + prior) / (expected + prior))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | all), the first shrunk to the second by some counts per bucket.

    These are PRIOR_SHARE of the target's mean count per bucket, PRIOR at least. Buckets too rare to tell have a ratio near
    zero, so a text is not marked down for words that the trusted documents do not have.

    :param trusted: doc_id of good documents; all of them make the target. The counts of the raw corpus are those of all documents.
    """
    return _ratios(_counted(docs), _counted(_target(docs, trusted)))


def _failed(measured: dict[str, np.ndarray], least_words: int, repeat_percent: int) -> np.ndarray:
    return (measured["n_words"] < least_words) | (100 * measured["n_repeat_words"] > repeat_percent * measured["n_words"])


def relative_threshold(texts: DataFrame, raw: np.ndarray, target: np.ndarray, least_words: int = LEAST_WORDS,
                       repeat_percent: int = REPEAT_PERCENT) -> float:
    """The log ratio from which a document is like the trusted ones, whose ``texts`` are given.

    Each of them that passes the plain rules is rated with its own counts taken off the target and the others' scaled up for them, as
    a document would be that is not in it. The threshold is half the way from their median to their TAIL quantile below that quantile, and DEVIATIONS
    standard deviations below the median at least, as few documents have no such tail. So it moves with the ratios, whatever
    the number of trusted documents. With fewer than two it is minus infinity.
    """
    size, prior, total = len(target), _prior(target), target.sum()
    rate_of_all = raw / max(raw.sum(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = PrimePowers()
        for batch in batches:
            for i, j, buf, offsets in blocks(batch.column(0)):
                found, rows = buckets(buf, offsets, powers)
                n = np.bincount(rows, minlength=j - i)
                keys, own = np.unique(rows.astype(np.int64) * size + found, return_counts=True)
                row, bucket = keys // size, keys % size
                others = np.log(((target[bucket] - own) * (total / np.maximum(total - n[row], 1)) + prior) / (rate_of_all[bucket] * total + prior))
                ratio = np.bincount(row, others * own, j - i) / np.maximum(n, 1)
                passed = ratio[~_failed(measures(buf, offsets, powers), least_words, repeat_percent)]
                steps, times = np.unique(np.floor(passed / STEP).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(times, pa.int64())], names=["step", "n"])

    found = sorted(texts.select("text").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n")).collect())
    steps, times = (np.array([r[k] for r in found]) for k in range(2))
    if times.sum() < 2:
        return -np.inf
    tail, middle = (steps[np.searchsorted(np.cumsum(times), share * times.sum())] * STEP for share in (TAIL, 0.5))
    spread = STEP * np.sqrt(np.average((steps - np.average(steps, weights=times)) ** 2, weights=times) * times.sum() / (times.sum() - 1))
    few = 1 + 4 / (times.sum() - 1)  # a spread found from few is uncertain
    return float(min(tail - (middle - tail) / 2, middle - DEVIATIONS * few * spread))


def rate(docs: DataFrame, ratios: np.ndarray, threshold: float, least_words: int = LEAST_WORDS, repeat_percent: int = REPEAT_PERCENT,
         keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measures, log_ratio (mean per word and word pair), base_failed and kept.

    base_failed: fewer than ``least_words`` words, or more than ``repeat_percent`` percent of the words in repeated
    windows. kept: not base_failed, and log_ratio at or above ``threshold``; the same for every document alike.

    A null text has no words and fails. Repeated rows are rated alike. Columns named like the new ones are replaced.
    """
    types = {m: T.LongType() for m in MEASURES} | {"log_ratio": T.DoubleType(), "base_failed": T.BooleanType(), "kept": T.BooleanType()}
    names = [c for c in (docs.columns if keep is None else keep) if c not in types]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, t) for c, t in types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = PrimePowers()
        for batch in batches:
            for i, j, buf, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
                out = measures(buf, offsets, powers)
                found, rows = buckets(buf, offsets, powers)
                total = np.bincount(rows, ratios[found], j - i)
                ratio = total / np.maximum(np.bincount(rows, minlength=j - i), 1)
                failed = _failed(out, least_words, repeat_percent)
                new = {m: pa.array(out[m], pa.int64()) for m in MEASURES}
                new |= {"log_ratio": pa.array(ratio), "base_failed": pa.array(failed), "kept": pa.array(~failed & (ratio >= threshold))}
                yield arrow_rows(batch, names, i, j, new)

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def quality(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """:func:`rate` with the log ratios of the trusted documents against all of ``docs``, and without a ``threshold`` with
    :func:`relative_threshold`.

    Without trusted documents, or with an empty table, all ratios are zero and the plain measures alone decide.
    """
    texts = _target(docs, trusted)
    raw, target = _counted(docs), _counted(texts)
    return rate(docs, _ratios(raw, target), relative_threshold(texts, raw, target) if threshold is None else threshold, keep=keep)
