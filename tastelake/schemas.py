"""Fixed schemas of the tables that are read or written."""

from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("movie_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

MOVIES = T.StructType([
    T.StructField("movie_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

# names in the CSV header -> names in the tables
CSV_NAMES = {"userId": "user_id", "movieId": "movie_id"}

_STAMPS = [
    T.StructField("event_timestamp", T.TimestampType()),
    T.StructField("created_timestamp", T.TimestampType()),
]

USER_STATS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("avg_rating", T.FloatType()),
    T.StructField("rating_count", T.IntegerType()),
    T.StructField("rating_stddev", T.FloatType()),
    T.StructField("unique_genres_rated", T.IntegerType()),
    *_STAMPS,
])

MOVIE_STATS = T.StructType([
    T.StructField("movie_id", T.LongType()),
    T.StructField("avg_rating", T.FloatType()),
    T.StructField("rating_count", T.IntegerType()),
    T.StructField("rating_stddev", T.FloatType()),
    T.StructField("genres", T.StringType()),
    *_STAMPS,
])

INTERACTIONS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("movie_id", T.LongType()),
    T.StructField("rating", T.FloatType()),
    T.StructField("timestamp", T.LongType()),
    *_STAMPS,
])

# ids and numbers are parsed as strings and cast, so "1" is accepted like 1
EVENT_JSON = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("movie_id", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("datetime", T.StringType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("logged_at", T.TimestampType()),
])
