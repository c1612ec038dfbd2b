"""Dataset exploration as aggregates. One-row values enter as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastelake.functions.columns import genre_tokens

BAR_WIDTH = 30
FEW_RATINGS = 20


def _activity(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.count("*").alias("n"))


def dataset_overview(ratings: DataFrame) -> DataFrame:
    """Rows, users, movies, first and last date, matrix cells and sparsity in percent.

    Distinct users and movies come from one grouped pass each, which combines before the shuffle;
    a single aggregate with two distinct counts would send every row through the shuffle twice.
    """
    movies = _activity(ratings, "movie_id").agg(F.count("*").alias("movies"))
    per_user = ratings.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    day = lambda c: F.date_from_unix_date(F.floor(c / 86400).cast("int")).cast("string")
    base = per_user.agg(
        F.sum("n").alias("ratings"), F.count("*").alias("users"),
        day(F.min("lo")).alias("first_date"), day(F.max("hi")).alias("last_date"),
    ).withColumn("movies", movies.scalar())
    cells = F.col("users") * F.col("movies")
    return base.select(
        "ratings", "users", "movies", "first_date", "last_date", cells.alias("cells"),
        ((1 - F.col("ratings") / cells) * 100).alias("sparsity_pct"))


def _with_bar(counts: DataFrame) -> DataFrame:
    top = counts.agg(F.max("n")).scalar()
    return counts.withColumn("bar", (F.col("n") / top * BAR_WIDTH).cast("int"))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    return _with_bar(_activity(ratings, "rating"))


def rating_moments(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.avg("rating").alias("mean_rating"),
        F.median("rating").alias("median_rating"),
        F.stddev_samp("rating").alias("std_rating"))


def activity_summary(ratings: DataFrame, key: str) -> DataFrame:
    """Spread of the number of ratings per key; the exact median keeps one entry per distinct count."""
    few = F.count_if(F.col("n") < FEW_RATINGS)
    return _activity(ratings, key).agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"),
        F.avg("n").alias("mean_n"), F.median("n").alias("median_n"),
        few.alias("few_n"), (few / F.count("*") * 100).alias("few_pct"))


def activity_per_user(ratings: DataFrame) -> DataFrame:
    return activity_summary(ratings, "user_id")


def activity_per_movie(ratings: DataFrame) -> DataFrame:
    return activity_summary(ratings, "movie_id").drop("few_n", "few_pct")


def genre_breakdown(movies: DataFrame) -> DataFrame:
    """Movies per genre with bar length, plus the total of movies and genres."""
    per_genre = (movies.select(F.explode(genre_tokens("genres")).alias("genre"))
                 .groupBy("genre").agg(F.count("*").alias("n")))
    return _with_bar(per_genre).withColumns({
        "movies_total": movies.agg(F.count("*")).scalar(),
        "genres_total": per_genre.agg(F.count("*")).scalar()})


def prerequisite_report(ratings: DataFrame, feature_tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct keys and range of the ratings; rows and column names of each feature table."""
    per_user = ratings.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    movies = _activity(ratings, "movie_id").agg(F.count("*")).scalar()
    report = per_user.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_users"),
        F.min("lo").alias("min_rating"), F.max("hi").alias("max_rating"),
    ).select(F.lit("ratings").alias("table_name"), "n_rows", "n_users", movies.alias("n_movies"),
             "min_rating", "max_rating", F.lit(None).cast("string").alias("columns"))
    for name, df in feature_tables.items():
        row = df.agg(F.count("*").alias("n_rows")).withColumns(
            {"table_name": F.lit(name), "columns": F.lit(",".join(df.columns))})
        report = report.unionByName(row, allowMissingColumns=True)
    return report
