"""Whitening of vectors by the covariance of their distinct values (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tastelake.llm.vectors import LARGEST, common_width, usable
from tastelake.session import materialise

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
DEVIATION = T.DecimalType(38, 0)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def totals(df: DataFrame, vec: str, weight: str, width: int, number: str) -> tuple[int, np.ndarray]:
    """Sum of the weights and the weighted sums of all places; exact for whole numbers (``number`` long)."""
    schema = f"place int, total {number}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width + 1, np.int64 if number == "long" else np.float64)
        for batch in batches:
            x, w = _matrix(batch, vec, width), batch.column(batch.schema.get_field_index(weight)).to_numpy()
            found += np.append((x * w[:, None]).sum(axis=0), w.sum())
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(width + 1), pa.int32()), "total": pa.array(found)})

    rows = dict(df.select(vec, weight).mapInArrow(run, schema).groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)") if number == "long" else "total")).collect())
    kind = int if number == "long" else float
    return int(rows.get(width, 0)), np.array([kind(rows.get(d, 0)) for d in range(width)], object if number == "long" else float)


def covariance(df: DataFrame, vec: str, weight: str, centre: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance, divisor ``n``: rows are centred, then multiplied as blocks; a task returns one matrix."""
    width = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            x, w = _matrix(batch, vec, width) - centre, batch.column(batch.schema.get_field_index(weight)).to_numpy()
            gram += (x * w[:, None]).T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(gram[i, j])})

    out = np.zeros((width, width))
    # width * (width + 1) / 2 numbers, whatever the number of rows
    for r in df.select(vec, weight).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"] / n
    return out


@dataclass
class Whitening:
    """Components by falling eigenvalue; whitened = (x - sums / n) @ axes / sqrt(values)."""

    n: int
    sums: np.ndarray        # whole numbers
    axes: np.ndarray        # column = unit eigenvector
    values: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)  # one rounding each


def fit(distinct: DataFrame, vec: str, weight: str, width: int, components: int) -> Whitening:
    """Eigenvectors of the weighted covariance. Directions without variance (up to rounding) are no components."""
    n, sums = totals(distinct, vec, weight, width, "long")
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    if n:
        matrix = covariance(distinct, vec, weight, model.centre, n)
        values, axes = np.linalg.eigh(matrix)
        values, axes = values[::-1], axes[:, ::-1]
        k = min(components, int((values > max(values[0], 0) * width * 1e-12).sum()))
        model.axes, model.values, model.explained = axes[:, :k], values[:k], values[:k] / max(np.trace(matrix), np.finfo(float).tiny)
    return model


def _whitened(distinct: DataFrame, model: Whitening, vec: str, weight: str) -> DataFrame:
    """Every distinct vector once: vec, weight, deviation (exact), whitened."""
    width, k = model.axes.shape
    centre, axes = model.centre, model.axes / np.sqrt(model.values)
    n, sums = model.n, model.sums
    schema = T.StructType([distinct.schema[vec], distinct.schema[weight], T.StructField("deviation", DEVIATION), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, vec, width).astype(np.int64)
            away = x.astype(object) * n - sums if n * 2 * (LARGEST + SHIFT) >= 1 << 62 else x * n - sums.astype(np.int64)
            if len(x) and away.dtype != object and int(np.abs(away).max()) ** 2 * width >= 1 << 63:
                away = away.astype(object)
            squares = (away * away).sum(axis=1)
            kind = pa.decimal128(38, 0)
            deviation = pa.array([Decimal(int(s)) for s in squares], kind) if away.dtype == object else pa.array(squares).cast(kind)
            z = (x - centre) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in (vec, weight)), deviation, lists],
                                             names=[vec, weight, "deviation", "whitened"])

    return distinct.select(vec, weight).mapInArrow(run, schema)


def whiten(df: DataFrame, vec: str = "embedding", keep: list[str] | None = None, weights: str = "one", components: int = COMPONENTS,
           dim: int | None = None) -> tuple[DataFrame, Whitening]:
    """Rows with ``deviation`` (decimal), ``whitened`` (array) and ``identity_error``, and the fitted model.

    Components become whole numbers floor(64 x) + 1000000. Identical vectors are grouped, combined before the shuffle. The fit
    takes every distinct vector with weight one (``weights="one"``) or as often as it stands (``weights="counts"``). Every distinct
    vector is whitened once and joined back on all its numbers; a hot vector is one row of that side, and adaptive execution splits
    the rows of the other. ``identity_error`` is the largest entry of the fit list's whitened covariance minus the identity.

    :param keep: columns to return besides the new ones; all but the vector if None. New columns replace columns of their name.
    :param dim: length of the vectors; the most frequent length if None.

    Rows whose vector is null, empty, of another length, or holds a null, NaN or infinity are dropped; repeated rows stay. Equal
    eigenvalues leave the choice of axes open. There are fewer components where the vectors span fewer dimensions; a single
    distinct vector has none, and ``whitened`` is empty. An empty table gives an empty table. Components beyond 2^26 / 64 are
    an error of the job.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights are 'one' or 'counts'")
    new = ("deviation", "whitened", "identity_error")
    names = [c for c in (df.columns if keep is None else keep) if c not in (vec, *new)]
    parted = df.select(F.struct(*names).alias("kept"), F.col(vec).alias("vec"))
    width = dim or common_width(parted, "vec")

    def whole(c):
        scaled = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(scaled) > LARGEST, F.raise_error(F.lit("component out of range")).cast("long")).otherwise(scaled).cast("int") + SHIFT

    rows = parted.filter(usable("vec", width)).select("kept", F.transform("vec", whole).alias("x"))
    # the weight column is what the fit counts
    distinct = materialise(rows.groupBy("x").agg((F.count("*") if weights == "counts" else F.lit(1)).cast("long").alias("w")), "distinct-vectors")
    model = fit(distinct, "x", "w", width, components)
    done = materialise(_whitened(distinct, model, "x", "w"), "whitened-vectors")
    k = model.axes.shape[1]
    wrong = 0.0
    if k:
        _, sums = totals(done, "whitened", "w", k, "double")
        wrong = float(np.abs(covariance(done, "whitened", "w", sums / model.n, model.n) - np.eye(k)).max())
    hashed = F.xxhash64("x").alias("h")
    found = rows.select("kept", "x", hashed).join(done.select("x", hashed, "deviation", "whitened"), ["h", "x"])
    return found.select("kept.*", "deviation", "whitened", F.lit(wrong).alias("identity_error")), model


def by_component(found: DataFrame, model: Whitening, names: list[str]) -> DataFrame:
    """One row per row and component, numbered from 1 by falling eigenvalue: names, component, n, deviation, whitened, explained, identity_error."""
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return found.select(*names, F.lit(model.n).cast("long").alias("n"), "deviation", "identity_error",
                        F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("at", "one")).select(
        *names, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("one.whitened").alias("whitened"),
        F.col("one.explained").alias("explained"), "identity_error")
