"""Feature tables: user and movie statistics, interactions, and their stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastelake.functions.columns import NO_GENRES, genre_tokens, sample_std
from tastelake.session import dealt, materialise, tasks_for


def rating_stats(ratings: DataFrame, key: str) -> DataFrame:
    """Mean, count of non-null ratings and sample deviation per key, in double."""
    return ratings.groupBy(key).agg(
        F.avg("rating").alias("avg_rating"),
        F.count("rating").alias("rating_count"),
        sample_std("rating").alias("rating_stddev"))


def unique_genres(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Distinct genre labels over all movies a user rated; ratings without a movie drop out.

    Labels are exploded before the shuffle and (user, genre) pairs combine in each task, so a busy
    user sends at most one row per genre and task.
    """
    pairs = ratings.select("user_id", "movie_id").join(movies.select("movie_id", "genres"), "movie_id")
    return (pairs.select("user_id", F.explode(genre_tokens("genres")).alias("genre")).distinct()
            .groupBy("user_id").agg(F.count("*").alias("unique_genres_rated")))


def user_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """One row per user; a user whose movies are all unknown has 0 genres."""
    genres = unique_genres(ratings, movies)
    return rating_stats(ratings, "user_id").join(genres, "user_id", "left").withColumn(
        "unique_genres_rated", F.coalesce("unique_genres_rated", F.lit(0)))


def movie_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """One row per rated movie; a movie without metadata gets the no-genres label."""
    labels = movies.select("movie_id", "genres")
    return rating_stats(ratings, "movie_id").join(labels, "movie_id", "left").withColumn(
        "genres", F.coalesce("genres", F.lit(NO_GENRES)))


def interactions(ratings: DataFrame) -> DataFrame:
    return ratings.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("movie_id").cast("long").alias("movie_id"),
        F.col("rating").cast("float").alias("rating"),
        F.col("timestamp").cast("long").alias("timestamp"))


def stamped(features: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add event and creation time; ``as_of`` defaults to now."""
    created = F.current_timestamp()
    return features.withColumns({
        "event_timestamp": (created if as_of is None else as_of).cast("timestamp"),
        "created_timestamp": created})


def with_schema(features: DataFrame, schema) -> DataFrame:
    """Cast to a table schema; floats narrow here and nowhere earlier."""
    return features.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _running(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    from pyspark.sql import Window

    # one row per key and month, so a window holds at most the number of months
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({m: F.sum(m).over(w) for m in measures})


def _month(ts: str = "timestamp") -> Column:
    """Months since 1970 of epoch seconds."""
    day = F.date_from_unix_date(F.floor(F.col(ts) / 86400).cast("int"))
    return (F.year(day) - 1970) * 12 + F.month(day) - 1


def _month_start(month: str | Column) -> Column:
    """Epoch seconds at which a month begins."""
    m = F.col(month) if isinstance(month, str) else month
    year = (F.lit(1970) + F.floor(m / 12)).cast("int")
    return F.unix_date(F.make_date(year, (m % 12 + 1).cast("int"), F.lit(1))).cast("long") * 86400


def monthly_history(ratings: DataFrame, key: str) -> DataFrame:
    """Statistics of ``key`` over all its ratings up to the end of each month it was active in.

    The row of a month is stamped with the first second of the following month, so a row never
    describes ratings later than its own time. Ratings shrink to one row per (key, month) before
    any window runs. They are counted first, so pass a table and not a long plan.
    """
    rows = ratings.count()
    monthly = dealt(ratings.select(key, _month().alias("month"), "rating"), rows, key, "month").groupBy(key, "month").agg(
        F.count("rating").alias("n"), F.sum("rating").alias("s"),
        F.sum(F.col("rating") * F.col("rating")).alias("ss"))
    variance = F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    return _running(dealt(monthly, rows, key), key, ["n", "s", "ss"]).select(
        key, _month_start(F.col("month") + 1).alias("event_timestamp"),
        F.try_divide("s", "n").alias("avg_rating"),
        F.col("n").alias("rating_count"),
        F.when(F.col("n") > 1, F.sqrt(variance)).otherwise(0.0).alias("rating_stddev"),
        "month")


def user_history(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Monthly user statistics with the number of genres seen so far."""
    rows = ratings.count()
    stats = monthly_history(ratings, "user_id")
    tagged = dealt(ratings.select("user_id", "movie_id", _month().alias("month")), rows, "movie_id").join(
        movies.select("movie_id", "genres"), "movie_id")
    by_label = (dealt(tagged.select("user_id", "genres", "month"), rows, "user_id", "genres")
                .groupBy("user_id", "genres").agg(F.min("month").alias("month"))
                .select("user_id", "month", F.explode(genre_tokens("genres")).alias("genre")))
    first_seen = dealt(by_label, rows, "user_id").groupBy("user_id", "genre").agg(F.min("month").alias("month"))
    # one row per user, with at most a field per month
    new_genres = (first_seen.groupBy("user_id", "month").agg(F.count("*").alias("n"))
                  .groupBy("user_id").agg(F.collect_list(F.struct("month", "n")).alias("_new")))
    if tasks_for(ratings.sparkSession, rows) is not None:  # the shuffle files of its large steps go before the statistics begin
        new_genres = materialise(new_genres, "new-genres")
    so_far = F.aggregate(F.filter("_new", lambda g: g["month"] <= F.col("month")), F.lit(0).cast("long"), lambda s, g: s + g["n"])
    return stats.join(new_genres, "user_id", "left").select(
        *[c for c in stats.columns if c != "month"], F.coalesce(so_far, F.lit(0)).alias("unique_genres_rated"))


def movie_history(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Monthly movie statistics with the genre labels."""
    return monthly_history(ratings, "movie_id").drop("month").join(
        movies.select("movie_id", "genres"), "movie_id", "left").fillna(NO_GENRES, ["genres"])
