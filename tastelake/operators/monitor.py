"""Service metrics computed from request and event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# fixed values: upper bounds of the histogram buckets
REQUEST_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RECOMMEND_SECONDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
LOOKUP_SECONDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
CANDIDATE_COUNTS = (1, 5, 10, 25, 50, 100, 200)
RESULT_COUNTS = (1, 5, 10, 25, 50, 100)
METRICS_ENDPOINT = "/metrics"


def request_log(calls: DataFrame) -> DataFrame:
    """Calls without those of the metrics endpoint; a call that raised counts as status 500."""
    return calls.filter(F.col("endpoint") != METRICS_ENDPOINT).withColumn(
        "status", F.when(F.col("raised"), "500").otherwise(F.col("status"))).drop("raised")


def histogram(log: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts per bound ``le`` with +Inf as infinity, plus count and sum, per label.

    All bounds are counted in one aggregate, so a hot label shrinks to one row per task.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    one = log.groupBy(*labels).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))
    buckets = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cum")) for i, b in enumerate(bounds)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cum")))
    return one.select(*labels, "count", "sum", F.inline(buckets))


def histogram_quantile(buckets: DataFrame, quantiles: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation inside the bucket that holds rank q * count.

    The first bucket starts at 0, a rank in the +Inf bucket gives the last finite bound. A label has as
    many rows as bounds.
    """
    w = Window.partitionBy(*labels).orderBy("le")
    lower = F.coalesce(F.lag("le").over(w), F.lit(0.0))
    before = F.coalesce(F.lag("cum").over(w), F.lit(0))
    steps = buckets.withColumns({"lo": lower, "below": before})
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("quantile")
    ranked = steps.select("*", q).withColumn("rank", F.col("quantile") * F.col("count"))
    # an empty bucket holds only a rank of 0
    part = F.coalesce(F.try_divide(F.col("rank") - F.col("below"), F.col("cum") - F.col("below")), F.lit(0.0))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * part
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)
    return (ranked.filter(F.col("cum") >= F.col("rank"))
            .groupBy(*labels, "quantile").agg(F.min_by(value, "le").alias("value")))


def quantile_series(log: DataFrame, value: str, bounds: Sequence[float], quantiles: Sequence[float], labels: Sequence[str] = (),
                    minutes: int = 1, ts: str = "ts") -> DataFrame:
    """Quantiles of ``value`` at each minute over the ``minutes`` up to it: minute (start, in seconds), labels, quantile, value, n.

    The buckets of a minute are the increase of cumulative counters in it; those of the last ``minutes`` are added, then the
    quantile is interpolated. Rows are counted once into minutes, so wider ranges only repeat the counts. A minute without a
    row in its range has no value. Rows without a time or value are not counted.
    """
    minute = F.unix_seconds(F.date_trunc("minute", ts))
    timed = log.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*labels, minute.alias("minute"), value)
    counts = histogram(timed, value, bounds, [*labels, "minute"])
    steps = F.transform(F.sequence(F.lit(0), F.lit(minutes - 1)), lambda k: F.col("minute") + 60 * k)
    ranges = counts.withColumn("minute", F.explode(steps)).groupBy(*labels, "minute", "le").agg(F.sum("cum").alias("cum"), F.sum("count").alias("count"))
    found = histogram_quantile(ranges, quantiles, [*labels, "minute", "count"])
    return found.withColumnRenamed("count", "n")


def rate_per_minute(log: DataFrame, labels: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Events per second in each minute, by label."""
    return log.groupBy(F.window(ts, "1 minute").alias("w"), *labels).agg(F.count("*").alias("n")).select(
        F.unix_seconds("w.start").alias("minute"), *labels, "n", (F.col("n") / 60.0).alias("per_second"))


def error_rate(log: DataFrame, labels: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Server errors per second in each minute."""
    return rate_per_minute(log.filter(F.col("status").rlike("^5..$")), labels, ts)


def error_counts(errors: DataFrame, label: str) -> DataFrame:
    """Errors per reason or entity type."""
    return errors.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
