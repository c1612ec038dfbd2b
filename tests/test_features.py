import pytest
from pyspark.sql import functions as F

from tastelake import schemas
from tastelake.operators import explore, features
from tests.conftest import rows


@pytest.fixture(scope="module")
def edge(spark):
    """A single rating, a missing rating value, and a user whose movies are all unknown."""
    data = [(1, 1, 4.0, 10), (2, 1, 3.0, 10), (2, 2, None, 20), (2, 3, 5.0, 30), (3, 99, 2.0, 40)]
    return spark.createDataFrame(data, "user_id long, movie_id long, rating double, timestamp long")


def test_user_stats_edges(edge, movies):
    got = {r[0]: r[1:] for r in rows(features.user_stats(edge, movies))}
    assert got[1] == (4.0, 1, 0.0, 2)
    assert got[2] == (4.0, 2, pytest.approx(2 ** 0.5), 4)
    assert got[3] == (2.0, 1, 0.0, 0)


def test_movie_without_metadata_gets_the_label(edge, movies):
    got = {r["movie_id"]: r["genres"] for r in features.movie_stats(edge, movies).collect()}
    assert got[99] == "(no genres listed)" and got[1] == "Adventure|Comedy"


def test_stamps_and_schema(edge):
    df = features.with_schema(features.stamped(features.interactions(edge), F.timestamp_seconds(F.lit(7))), schemas.INTERACTIONS)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.INTERACTIONS]
    assert df.select(F.unix_seconds("event_timestamp")).distinct().collect()[0][0] == 7
    assert df.filter("created_timestamp is null").count() == 0


def test_history_never_sees_later_ratings(spark, movies):
    day = 86_400
    data = [(1, 1, 5.0, 0), (1, 2, 1.0, 10 * day), (1, 3, 3.0, 40 * day)]
    df = spark.createDataFrame(data, "user_id long, movie_id long, rating double, timestamp long")
    got = rows(features.user_history(df, movies), "event_timestamp", "avg_rating", "rating_count", "unique_genres_rated")
    assert got == [(31 * day, 3.0, 2, 3), (59 * day, 3.0, 3, 4)]


def test_overview_and_distribution(ratings):
    o = explore.dataset_overview(ratings).first()
    assert (o["ratings"], o["users"], o["movies"], o["cells"]) == (10, 3, 4, 12)
    assert o["sparsity_pct"] == pytest.approx(100 * (1 - 10 / 12))
    assert (o["first_date"], o["last_date"]) == ("1970-01-12", "1970-01-12")
    bars = {r["rating"]: r["bar"] for r in explore.rating_distribution(ratings).collect()}
    assert bars[4.5] == 30 and bars[0.5] == bars[3.0] == 15


def test_moments_and_activity(ratings):
    m = explore.rating_moments(ratings).first()
    assert m["mean_rating"] == pytest.approx(3.1) and m["median_rating"] == 3.25
    a = explore.activity_per_user(ratings).first()
    assert (a["min_n"], a["max_n"], a["median_n"], a["few_n"], a["few_pct"]) == (3, 4, 3.0, 3, 100.0)


def test_genre_breakdown(movies):
    got = {r["genre"]: r for r in explore.genre_breakdown(movies).collect()}
    assert got["Comedy"]["n"] == 2 and got["Comedy"]["bar"] == 30 and got["Romance"]["bar"] == 15
    assert got["Comedy"]["movies_total"] == 3 and got["Comedy"]["genres_total"] == 4
