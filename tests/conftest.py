import pytest

from tastelake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ratings(spark):
    """Ten ratings of three users and four movies: user 1 rated all, users 2 and 3 left out one each."""
    users = [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    movies = [1, 2, 3, 4, 1, 2, 4, 1, 3, 4]
    values = [3.5, 4.5, 2.0, 5.0, 2.5, 1.5, 4.0, 4.5, 3.0, 0.5]
    rows = [(u, m, r, 1_000_000 + 100 * i) for i, (u, m, r) in enumerate(zip(users, movies, values))]
    return spark.createDataFrame(rows, "user_id long, movie_id long, rating double, timestamp long")


@pytest.fixture(scope="session")
def movies(spark):
    rows = [(1, "One", "Adventure|Comedy"), (2, "Two", "Comedy|Romance"), (3, "Three", "(no genres listed)")]
    return spark.createDataFrame(rows, "movie_id long, title string, genres string")


def rows(df, *order):
    """Collected rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.select(*order).collect()) if order else (tuple(r) for r in df.collect()),
                  key=lambda r: tuple((v is not None, v) for v in r))
