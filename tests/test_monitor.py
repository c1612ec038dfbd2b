import pytest
from pyspark.sql import functions as F

from tastelake.operators import monitor, rolling
from tests.conftest import rows

INF = float("inf")


def test_bounds_are_inclusive_and_cumulative(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 1.5), ("a", 9.0), ("b", 0.1)], "l string, v double")
    got = rows(monitor.histogram(df, "v", (1.0, 2.0), ["l"]), "l", "le", "cum", "count", "sum")
    assert got == [("a", 1.0, 2, 4, 12.0), ("a", 2.0, 3, 4, 12.0), ("a", INF, 4, 4, 12.0),
                   ("b", 1.0, 1, 1, 0.1), ("b", 2.0, 1, 1, 0.1), ("b", INF, 1, 1, 0.1)]


@pytest.mark.parametrize("values,q,expected", [
    ([0.5] * 4, 0.5, 0.5),          # first bucket starts at 0
    ([1.5] * 4, 0.5, 1.5),          # second bucket, half of it
    ([0.5, 1.5], 0.5, 1.0),         # rank on a bound
    ([0.5, 9.0, 9.0], 0.99, 2.0),   # beyond the last bound
    ([1.5], 0.0, 0.0),              # rank 0 is the lower end of the empty first bucket
])
def test_quantile_interpolates_inside_the_bucket(spark, values, q, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = monitor.histogram_quantile(monitor.histogram(df, "v", (1.0, 2.0)), [q]).first()["value"]
    assert got == pytest.approx(expected)


def test_rates_and_errors(spark):
    df = spark.createDataFrame([(5, "a", "200"), (59, "a", "500"), (60, "a", "503"), (61, "b", "404")], "s long, endpoint string, status string")
    log = df.withColumn("ts", F.timestamp_seconds("s"))
    assert rows(monitor.rate_per_minute(log, ["endpoint"])) == [(0, "a", 2, 2 / 60), (60, "a", 1, 1 / 60), (60, "b", 1, 1 / 60)]
    assert rows(monitor.error_rate(log)) == [(0, 1, 1 / 60), (60, 1, 1 / 60)]


def test_request_log(spark):
    calls = spark.createDataFrame([("/metrics", "200", False), ("/rate", "200", True), ("/rate", "201", False)], "endpoint string, status string, raised boolean")
    assert rows(monitor.request_log(calls)) == [("/rate", "201"), ("/rate", "500")]


def test_error_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "reason string")
    assert rows(monitor.error_counts(df, "reason")) == [("x", 2), ("y", 1)]


def test_rolling_average_against_brute_force(spark):
    import random
    rng = random.Random(4)
    data = [(rng.randrange(3), rng.randrange(200), float(rng.randrange(1, 10))) for _ in range(300)]
    df = spark.createDataFrame(data, "user_id long, timestamp long, rating double")
    got = {(r["user_id"], r["timestamp"]): (r["rating_count"], r["avg_rating"]) for r in rolling.rolling_average(df, seconds=17).collect()}
    for u, t in {(u, t) for u, t, _ in data}:
        near = [r for u2, t2, r in data if u2 == u and t - 17 <= t2 <= t]
        assert got.pop((u, t)) == (len(near), pytest.approx(sum(near) / len(near)))
    assert not got


def test_genre_affinity(spark, ratings, movies):
    got = {(r[0], r[1]): r[2:] for r in rows(rolling.genre_affinity(ratings, movies))}
    assert got[(1, "Comedy")] == (2, 4.0, 0.4)
    assert got[(3, "(no genres listed)")] == (1, 3.0, pytest.approx(1 / 3))


def test_quantile_series_looks_back_some_minutes(spark):
    data = [(5, "a", 0.5), (10, "a", 1.5), (65, "a", 1.5), (400, "a", 9.0), (70, "b", None), (None, "b", 0.1)]
    log = spark.createDataFrame(data, "s long, endpoint string, v double").withColumn("ts", F.timestamp_seconds("s"))
    one = rows(monitor.quantile_series(log, "v", (1.0, 2.0), [0.5], ["endpoint"]), "endpoint", "minute", "n", "value")
    assert one == [("a", 0, 2, 1.0), ("a", 60, 1, 1.5), ("a", 360, 1, 2.0)]
    three = rows(monitor.quantile_series(log, "v", (1.0, 2.0), [0.5], [], 3), "minute", "n", "value")
    assert three == [(0, 2, 1.0), (60, 3, 1.25), (120, 3, 1.25), (180, 1, 1.5), (360, 1, 2.0), (420, 1, 2.0), (480, 1, 2.0)]
    assert monitor.quantile_series(log.limit(0), "v", (1.0, 2.0), [0.5]).count() == 0
