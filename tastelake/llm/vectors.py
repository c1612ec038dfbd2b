"""Arrow lists of numbers as matrices; used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: integers up to here keep squares and sums over a vector exact in 64 bits
LARGEST = 1 << 26


def usable(vec: str, width: int | None = None) -> Column:
    """The vector is not null, not empty, holds no null, NaN or infinity, and has ``width`` components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (F.size(vec) == width if width else F.size(vec) > 0), F.lit(False))


def common_width(df: DataFrame, vec: str) -> int:
    """The most frequent length of the usable vectors, the larger of equally frequent ones; 0 if there are none."""
    sizes = df.filter(usable(vec)).groupBy(F.size(vec).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return sizes["w"] if sizes else 0


def usable_rows(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the rows that are usable vectors of ``width``, and those vectors as doubles."""
    starts = column.offsets.to_numpy()
    good = np.diff(starts) == width
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    at = starts[:-1][good]
    if len(at) == len(good) and len(at):
        found = values[starts[0]:starts[-1]].reshape(-1, width)
    else:
        found = values[at[:, None] + np.arange(width)]
    finite = np.isfinite(found).all(axis=1)
    good[np.flatnonzero(good)[~finite]] = False
    return good, found[finite]


def floors(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers; a ValueError where results would leave exact arithmetic."""
    x = np.floor(vectors * float(scale))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g} are not supported")
    return x.astype(np.int64)
