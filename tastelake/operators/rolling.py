"""Time-windowed features. Our own rules: event time, one hour of allowed lateness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tastelake.functions.columns import genre_tokens, sample_std
from tastelake.session import dealt

WEEK_SECONDS = 7 * 86_400
LATENESS = "1 hour"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def windowed_stats(events: DataFrame, key: str | Sequence[str], width: str = "1 hour", slide: str | None = None,
                   ts: str = "ts") -> DataFrame:
    """Count, mean and deviation of ratings per key (or keys) and time window; runs on batch and stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *_keys(key)).agg(
        F.count("rating").alias("rating_count"), F.avg("rating").alias("avg_rating"),
        sample_std("rating").alias("rating_stddev"),
    ).select(F.unix_seconds("w.start").alias("window_start"), *_keys(key), "rating_count", "avg_rating", "rating_stddev")


def running_stats(events: DataFrame, key: str | Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Totals per key (or keys) over everything seen so far, stamped with its latest event."""
    return events.groupBy(*_keys(key)).agg(
        F.count("rating").alias("rating_count"), F.avg("rating").alias("avg_rating"),
        sample_std("rating").alias("rating_stddev"), F.max(ts).alias("event_timestamp"))


def rolling_average(ratings: DataFrame, key: str = "user_id", seconds: int = WEEK_SECONDS) -> DataFrame:
    """Mean rating of a key over the ``seconds`` up to each time it rated, ends included.

    Ratings first shrink to one row per (key, time). A row adds its rating when it comes and takes it
    back once it is too old, so the mean is a running sum and its cost does not grow with the window.
    Time is cut into slices one window long; rows of the slice before are repeated in the next, so a
    slice is complete on its own and the rows of one busy key spread over many tasks.
    """
    moments = ratings.groupBy(key, "timestamp").agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
    ts, slice_ = F.col("timestamp"), F.floor(F.col("timestamp") / seconds)

    def change(slice_, at, sign, own):
        return F.struct(slice_.alias("slice"), at.alias("at"), (F.col("s") * sign).alias("ds"),
                        (F.col("n") * sign).alias("dn"), F.lit(own).alias("own"))

    changes = moments.select(key, F.inline(F.array(
        change(slice_, ts, 1, True), change(slice_ + 1, ts, 1, False), change(slice_ + 1, ts + seconds + 1, -1, False))))
    so_far = Window.partitionBy(key, "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    summed = changes.withColumns({"total": F.sum("ds").over(so_far), "rating_count": F.sum("dn").over(so_far)})
    return summed.filter("own").select(
        key, F.col("at").alias("timestamp"), "rating_count", F.try_divide("total", "rating_count").alias("avg_rating"))


def genre_events(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """The ratings, once per genre of the movie, with all columns and ``genre``; runs on batch and stream."""
    joined = ratings.join(movies.select("movie_id", "genres"), "movie_id")
    return joined.select(*ratings.columns, F.explode(genre_tokens("genres")).alias("genre"))


def with_share(totals: DataFrame) -> DataFrame:
    """Totals per user and genre with the ``share`` of the user's genre labels."""
    total = F.sum("rating_count").over(Window.partitionBy("user_id"))  # a row per genre
    return totals.withColumn("share", F.try_divide("rating_count", total))


def genre_affinity(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Per user and genre: ratings, their mean and the share of the user's genre labels.

    The ratings are counted first, so pass a table and not a long plan.
    """
    n = ratings.count()
    tagged = genre_events(dealt(ratings.select("user_id", "movie_id", "rating"), n, "movie_id"), movies)
    per_genre = (dealt(tagged.select("user_id", "genre", "rating"), n, "user_id", "genre")
                 .groupBy("user_id", "genre").agg(F.count("rating").alias("rating_count"), F.avg("rating").alias("avg_rating")))
    return with_share(dealt(per_genre, n, "user_id"))
