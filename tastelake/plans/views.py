"""Ratings, movies, events and requests as views over the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastelake.functions.columns import epoch_micros, epoch_seconds
from tastelake.session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per order line: user_id, movie_id, rating (0.5 to 5.0), timestamp, two tie-break keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = lines.count()  # from the file footers
    lines, orders = dealt(lines, n, "l_orderkey"), dealt(orders, n, "o_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("o_custkey") + 1).alias("user_id"),
        (F.col("l_partkey") + 1).alias("movie_id"),
        (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"),
        epoch_seconds("o_orderdate").alias("timestamp"),
        "l_orderkey", "l_linenumber")


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("movie_id"),
        F.col("p_name").alias("title"),
        F.replace(F.concat_ws(" ", "p_type", "p_name"), F.lit(" "), F.lit("|")).alias("genres"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("user_id"))


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rating events, valid and invalid ones alike."""
    return as_rating_events(table(spark, sf_dir, "events")).drop("ts")


def as_rating_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "event_type", "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("movie_id"),
        (F.col("value") / 20).alias("rating"),
        epoch_seconds("ts").alias("timestamp"), "ts")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("value") / 100).alias("duration_s"),
        F.timestamp_micros(epoch_micros("ts")).alias("ts"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
