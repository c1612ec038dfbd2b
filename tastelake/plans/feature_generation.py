"""Feature generation: ratings and movies in, three stamped feature tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tastelake.operators import features
from tastelake.session import together
from tastelake.sources import catalog, tables


def feature_frames(ratings: DataFrame, movies: DataFrame, as_of: Column | None = None):
    """(view, frame) of the three tables, all stamped ``as_of`` (default now)."""
    frames = [(catalog.USER_STATS, features.user_stats(ratings, movies)),
              (catalog.MOVIE_STATS, features.movie_stats(ratings, movies)),
              (catalog.INTERACTIONS, features.interactions(ratings))]
    return [(view, features.with_schema(features.stamped(df, as_of), view.schema)) for view, df in frames]


def generate_features(ratings: DataFrame, movies: DataFrame, root: str, as_of: Column | None = None) -> dict[str, str]:
    """Write the three tables under ``root``; returns their paths by view."""
    frames = feature_frames(ratings, movies, as_of)
    paths = together(ratings.sparkSession, [lambda v=v, df=df: tables.write_features(df, root, v) for v, df in frames])
    return {view.name: path for (view, _), path in zip(frames, paths)}
