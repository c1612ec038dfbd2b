"""Vector codes and whitening against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastelake.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rows int, n long"


def vectors(n=700, width=32, seed=3):
    """(vec_id, vector, label): clusters, a hot vector, repeated rows, null labels."""
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((12, width))[rng.integers(0, 12, n)] + rng.standard_normal((n, width)) * 0.3).astype(np.float32)
    x[n // 2:n // 2 + n // 4] = x[5]
    out = [(int(3 * i + 1), v.tolist(), None if i % 7 == 0 else int(i % 5)) for i, v in enumerate(x)]
    return out + out[40:43]


def table(spark, rows, extra=()):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in [*rows, *extra]], SCHEMA).repartition(5)


UNUSABLE = [(900_001, None, 1), (0, [1.0] * 31 + [None], 1), (900_002, [float("nan")] * 32, 2), (900_003, [float("inf")] + [0.0] * 31, 2), (900_004, [], 1),
            (900_005, [0.5] * 16, 1)]


def plain_codes(rows, rounds=2):
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    points = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64).reshape(len(rows), 16, -1)
    books = points[:64].transpose(1, 0, 2).copy()

    def nearest():
        far = ((points[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        entry, _ = nearest()
        for p in range(16):
            for e in range(len(books[p])):
                mine = points[entry[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    entry, error = nearest()
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return sorted((r[0], bytes(c.astype(np.uint8)).hex(), int(e), by_label[r[2]]) for r, c, e in zip(rows, entry, error)), books


@pytest.mark.parametrize("chunk,block", [(1 << 16, 128), (50, 7)])
def test_codes(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rows = vectors()
    df = table(spark, rows, UNUSABLE)
    done, books = vector_codes.compress(df)
    want, plain_books = plain_codes(rows)
    assert done.columns == ["vec_id", "label", "rows", "n", "code", "error", "label_error"]
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in done.collect()) == want
    assert (books == plain_books).all()
    assert vector_codes.books_digest(books) == hashlib.sha256(",".join(str(v) for p in plain_books for e in p for v in e).encode()).hexdigest()


def test_codes_of_few_rows_wide_numbers_and_none(spark):
    rows = [(i, [float(300 * i - k) for k in range(32)], None) for i in range(5)]
    done, books = vector_codes.compress(table(spark, rows), keep=["vec_id"])
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in done.collect()) == plain_codes(rows)[0] and books.shape == (16, 5, 2)
    for df in (table(spark, rows).limit(0), table(spark, UNUSABLE[:2])):
        done, books = vector_codes.compress(df)
        assert done.count() == 0 and done.columns[-3:] == ["code", "error", "label_error"] and books.size == 0
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0] * 17, 1)]))
    nameless = spark.createDataFrame([(None, [1.0] * 16, 1), (7, [2.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    done, books = vector_codes.compress(nameless)
    assert sorted(((r["vec_id"] or 0), r["code"]) for r in done.collect()) == [(0, "01" * 16), (7, "00" * 16)]


def test_label_sums_with_many_labels(spark):
    df = spark.range(500).select((F.col("id") % 9).alias("label"), F.col("id").alias("v")).withColumn("label", F.when(F.col("label") < 8, F.col("label")))
    few, many = (vector_codes.with_label_sum(df, "label", "v", "s", broadcast_bytes=b) for b in (1 << 20, 0))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and many.count() == 500


def test_hilbert_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        walk = grid[np.argsort(vector_codes.hilbert(grid, bits))]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points, book = rng.integers(-9, 10, (20, 3)), rng.integers(-12, 13, (30, 3))
        flags = vector_codes.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
        assert flags[((points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)].all()


def plain_whitening(rows, k, counts=False):
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit, number = np.unique(x, axis=0, return_counts=True)
    w = number if counts else np.ones(len(fit), np.int64)
    n, s = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    centred = fit - s / n
    v = (centred * w[:, None]).T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening(spark, weights):
    rows = sorted(vectors(), key=lambda r: r[0])
    done, model = whitening.whiten(table(spark, rows, UNUSABLE), weights=weights)
    assert done.columns == ["vec_id", "label", "code", "rows", "n", "deviation", "whitened", "identity_error"]
    got = sorted(done.collect(), key=lambda r: r["vec_id"])
    n, deviation, whitened, explained = plain_whitening(rows, 16, weights == "counts")
    assert model.n == n and [int(r["deviation"]) for r in got] == deviation.tolist()
    z = np.array([r["whitened"] for r in got])
    np.testing.assert_allclose(z * np.sign((z * whitened).sum(axis=0)), whitened, atol=1e-9)
    np.testing.assert_allclose(model.explained, explained, rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
    long = whitening.by_component(done, model, ["vec_id"])
    assert long.count() == 16 * len(rows) and long.agg(F.min("component"), F.max("component")).first()[:] == (1, 16)
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_flat_and_empty_tables(spark):
    line = [(i, [float(i), 2.0 * i, 5.0], 1) for i in range(6)]
    done, model = whitening.whiten(table(spark, line))
    assert model.axes.shape == (3, 1) and {len(r["whitened"]) for r in done.collect()} == {1}
    alone, model = whitening.whiten(table(spark, line[:1] * 3))
    assert model.n == 1 and [(int(r["deviation"]), r["whitened"]) for r in alone.collect()] == [(0, [])] * 3
    assert whitening.by_component(alone, model, ["vec_id"]).count() == 0
    none, model = whitening.whiten(table(spark, line).limit(0))
    assert none.count() == 0 and model.n == 0 and whitening.by_component(none, model, ["vec_id"]).count() == 0


def test_deviation_beyond_64_bits_is_exact(spark):
    rows = [(i, [float((-1) ** i * 1_000_000 - i), float(i * i)], 1) for i in range(300)]
    done, model = whitening.whiten(table(spark, rows), components=2)
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(rows), [int(v) for v in x.sum(axis=0)]
    want = {r[0]: sum((n * int(v) - t) ** 2 for v, t in zip(xs, s)) for r, xs in zip(rows, x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in done.collect()} == want and max(want.values()) > 1 << 63
