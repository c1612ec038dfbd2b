"""Quality classifier: cumulative-link regression on hashed text and graded ratings (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tastelake.llm.textblocks import ALNUM, LOWER, SPACED, Powers, arrow_rows, blocks, mixed, spans

BITS = 20
#: A bucket has a weight if it is in LEAST_ROWS rated texts or more, and the share of these above some grade is LEAST_Z
#: standard errors or more from that of all; other weights are zero, so words that only a few texts have add no noise.
LEAST_ROWS, LEAST_Z = 5, 4.0
#: Most labelled rows the model is fitted on, those with the smallest hashes of doc_id.
FIT_ROWS = 10_000


def _features(column: pa.Array, powers: Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, rows) per block: the distinct words and symbol runs of each text, hashed."""
    shift = np.uint64(64 - BITS)
    for i, j, buf, offsets in blocks(column):
        low = LOWER[buf]
        prefix = powers.prefixes(low)
        found = [spans(inside, offsets) for inside in (ALNUM[low], SPACED[low] & ~ALNUM[low])]
        keys = np.concatenate([powers.between(prefix, starts, ends) for starts, ends, _ in found])
        rows = np.concatenate([rows for _, _, rows in found])
        both = np.unique(rows << BITS | (mixed(keys) >> shift).astype(np.int64))
        yield i, j, both & ((1 << BITS) - 1), both >> BITS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """P(grade <= k | x) = sigmoid(cut_k - w.x): one weight vector for all grades, ordered cuts."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        return _sigmoid(score[:, None] - self.cuts)

    @classmethod
    def fit(cls, buckets: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 150, ridge: float = 1e-4,
            rate: float = 0.05) -> "OrdinalModel":
        """Whole-batch gradient steps with momentum and a scale per weight; the same for the same rows."""
        n, k, texts = len(buckets), n_grades - 1, np.arange(len(buckets))
        row = np.repeat(texts, [len(b) for b in buckets])
        bucket = np.concatenate(buckets) if n else np.zeros(0, np.int64)
        rows_with = np.bincount(bucket, minlength=1 << BITS)
        if n:
            tells = np.zeros(1 << BITS, bool)
            for cut in range(k):
                above = (grades > cut) - np.mean(grades > cut)
                away = np.bincount(bucket, above[row], 1 << BITS)
                tells |= np.abs(away) >= LEAST_Z * max(above.std(), 1e-9) * np.sqrt(np.maximum(rows_with, 1))
            chosen = tells & (rows_with >= LEAST_ROWS)
            row, bucket = row[chosen[bucket]], bucket[chosen[bucket]]
        share = np.cumsum((np.bincount(grades, minlength=n_grades) + 1) / (n + n_grades))[:-1]
        start = np.log(share / (1 - share))
        # the cuts are the first one and logs of the gaps behind it, so they stay in order
        params = np.concatenate([np.zeros(1 << BITS), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, rounds + 1 if n else 1):
            w, gaps = params[:1 << BITS], np.exp(params[(1 << BITS) + 1:])
            cuts = params[1 << BITS] + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.bincount(row, w[bucket], n)
            below = np.column_stack([np.zeros(n), _sigmoid(cuts - score[:, None]), np.ones(n)])
            p = np.maximum(below[texts, grades + 1] - below[texts, grades], 1e-9) * n
            slope = below * (1 - below)
            up, down = slope[texts, grades + 1] / p, slope[texts, grades] / p
            by_cut = np.zeros((n, k + 2))
            by_cut[texts, grades + 1] -= up
            by_cut[texts, grades] += down
            by_cut = by_cut[:, 1:-1].sum(axis=0)
            g = np.concatenate([np.bincount(bucket, (up - down)[row], 1 << BITS) + ridge * w, [by_cut.sum()],
                                np.array([by_cut[i:].sum() for i in range(1, k)]) * gaps])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
        gaps = np.exp(params[(1 << BITS) + 1:])
        return cls(params[:1 << BITS], params[1 << BITS] + np.concatenate([[0.0], np.cumsum(gaps)]))


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on a bounded sample of rated documents.

    :param grades: doc_id, grade (0 is the worst). Of several grades of a document the lowest holds; null ids, grades
        and grades out of range are not used.
    :param rows: bound of the sample; their hashed words, not their texts, come to the driver.
    """
    chosen = (grades.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id")
              .agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, j, bucket, row in _features(batch.column(1), powers):
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                packed = [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary()), batch.column(2).slice(i, j - i)],
                                                 names=["doc_id", "buckets", "grade"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("buckets", T.BinaryType()), T.StructField("grade", T.IntegerType())])
    # one row per document before the driver sees any; repeats combine before the shuffle
    single = texts.select("doc_id", "text", "grade").mapInArrow(hashed, schema).groupBy("doc_id", "grade").agg(F.min("buckets").alias("buckets"))
    found = single.toPandas().sort_values("doc_id")
    return OrdinalModel.fit([np.frombuffer(b, np.uint32).astype(np.int64) for b in found.buckets], found.grade.to_numpy(np.int64), n_grades)


def score(docs: DataFrame, model: OrdinalModel, good: int, threshold: float = 0.35, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of grade ``good`` or better) and kept (tail >= threshold).

    A null or empty text is rated by the cuts alone. Repeated rows are rated alike; an empty table stays empty.
    Whole texts are read. Columns named like the new ones are replaced.
    """
    types = {"expected_grade": T.DoubleType(), "tail_probability": T.DoubleType(), "kept": T.BooleanType()}
    names = [c for c in (docs.columns if keep is None else keep) if c not in types]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, t) for c, t in types.items()])
    weights, cuts = model.weights.astype(np.float32), model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, own = Powers(), OrdinalModel(weights, cuts)
        for batch in batches:
            for i, j, bucket, row in _features(batch.column(batch.schema.get_field_index("text")), powers):
                tails = own.tails(np.bincount(row, own.weights[bucket], j - i))
                yield arrow_rows(batch, names, i, j, {
                    "expected_grade": pa.array(tails.sum(axis=1)), "tail_probability": pa.array(tails[:, good - 1]),
                    "kept": pa.array(tails[:, good - 1] >= threshold)})

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of ratings: 0 toxic, 1 neither toxic nor good, 2 good. Null ratings give no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & F.col("quality").isNotNull(),
                                                                      F.col("quality") + 1).alias("grade"))
