import json

import pytest
from pyspark.sql import functions as F

from tastelake.operators import events
from tests.conftest import rows

NOW = 1_700_000_000


def lines(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def outcome(spark, **event):
    base = {"user_id": 1, "movie_id": 1, "rating": 3.0, "timestamp": 5}
    parsed = events.parse_events(lines(spark, {**base, **event}))
    bad = events.quarantined_events(parsed).collect()
    return bad[0]["reasons"] if bad else []


@pytest.mark.parametrize("event,reasons", [
    ({}, []), ({"user_id": 0}, ["user_id"]), ({"user_id": -1}, ["user_id"]), ({"movie_id": 0}, ["movie_id"]),
    ({"rating": 0.0}, ["rating"]), ({"rating": 5.5}, ["rating"]), ({"rating": 6.0}, ["rating"]),
    ({"rating": 0.5}, []), ({"rating": 5.0}, []), ({"rating": float("nan")}, ["rating"]), ({"rating": None}, ["rating"]),
    ({"user_id": "7"}, []), ({"user_id": 7.0}, []), ({"user_id": 7.5}, ["user_id"]), ({"user_id": "x"}, ["user_id"]),
    ({"timestamp": None}, []), ({"timestamp": 0}, []), ({"timestamp": "soon"}, ["timestamp"]),
    ({"user_id": 0, "movie_id": 0, "rating": 9}, ["user_id", "movie_id", "rating"]),
])
def test_bounds(spark, event, reasons):
    assert outcome(spark, **event) == reasons


def test_malformed_lines_are_kept_aside(spark):
    parsed = events.parse_events(lines(spark, "{not json", "", "[]", {"user_id": 1, "movie_id": 2, "rating": 3}))
    assert events.quarantined_events(parsed).count() == 3
    assert events.valid_events(parsed, F.lit(NOW)).select("user_id", "movie_id", "rating", "timestamp").collect() == [(1, 2, 3.0, NOW)]


def test_default_timestamp(spark):
    df = spark.createDataFrame([(None,), (0,), (9,)], "timestamp long")
    assert [r[0] for r in df.select(events.default_timestamp(now=F.lit(NOW))).collect()] == [NOW, NOW, 9]
    assert df.limit(1).select(events.default_timestamp() > NOW).first()[0]


def test_event_json(spark):
    df = spark.createDataFrame([(1, 2, 4.5, 964982703), (1, 2, 4.0, None)], "user_id long, movie_id long, rating double, timestamp long")
    first, second = (json.loads(r["value"]) for r in events.to_event_json(df, now=F.lit(NOW)).collect())
    assert first == {"event_type": "rating", "user_id": 1, "movie_id": 2, "rating": 4.5, "timestamp": 964982703,
                     "datetime": "2000-07-30T18:45:03+00:00"}
    assert list(first) == ["event_type", "user_id", "movie_id", "rating", "timestamp", "datetime"]
    assert second["timestamp"] == NOW and second["datetime"] == "2023-11-14T22:13:20+00:00"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_text_does_not_depend_on_the_session_zone(spark, zone):
    from tastelake.functions.columns import epoch_micros, epoch_seconds, iso_utc
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.sql("select timestamp_ntz'1999-03-28 02:30:15.25' t, 922588215L e, -1L before").select(
            epoch_seconds("t"), epoch_micros("t"), iso_utc("e"), iso_utc("before")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == (922588215, 922588215250000, "1999-03-28T02:30:15+00:00", "1969-12-31T23:59:59+00:00")


def test_outcomes(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True)], "up boolean, taken boolean").select(
        events.outcome_status(F.col("up"), F.col("taken")).alias("status"), F.timestamp_seconds(F.lit(65)).alias("ts"))
    assert rows(events.outcome_counts(df)) == [(60, "failed", 1), (60, "logged", 1), (60, "published", 1)]
