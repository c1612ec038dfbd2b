"""Rating events: build, parse, validate, default and count. The same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastelake import schemas
from tastelake.functions.columns import iso_utc

# fixed values: inclusive bounds
MIN_ID = 1
MIN_RATING, MAX_RATING = 0.5, 5.0


def default_timestamp(ts: str | Column = "timestamp", now: Column | None = None) -> Column:
    """Missing or 0 becomes now."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    now = F.unix_timestamp() if now is None else now
    return F.when(ts.isNull() | (ts == 0), now).otherwise(ts)


def event_struct() -> Column:
    return F.struct(
        F.lit("rating").alias("event_type"),
        F.col("user_id").cast("long").alias("user_id"),
        F.col("movie_id").cast("long").alias("movie_id"),
        F.col("rating").cast("double").alias("rating"),
        F.col("timestamp").cast("long").alias("timestamp"),
        iso_utc("timestamp").alias("datetime"))


def to_event_json(ratings: DataFrame, out: str = "value", now: Column | None = None) -> DataFrame:
    """Ratings as JSON event lines."""
    filled = ratings.withColumn("timestamp", default_timestamp(now=now))
    return filled.withColumn(out, F.to_json(event_struct()))


def _whole_number(c: str) -> Column:
    """A long from its text; '3.0' counts as 3, '3.5' does not."""
    number = F.col(c).try_cast("double")
    return F.coalesce(F.col(c).try_cast("long"), F.when(number == F.floor(number), number.cast("long")))


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to typed columns; what does not parse becomes NULL and is caught by the checks."""
    parsed = F.from_json(value, schemas.EVENT_JSON, {"mode": "PERMISSIVE"})
    e = lines.withColumn("_e", parsed).select(
        "*", *[F.col(f"_e.{n}").alias(n) for n in schemas.EVENT_JSON.names]).drop("_e")
    return e.withColumns({
        "_bad_timestamp": F.col("timestamp").isNotNull() & _whole_number("timestamp").isNull(),
        "user_id": _whole_number("user_id"), "movie_id": _whole_number("movie_id"),
        "rating": F.col("rating").try_cast("double"), "timestamp": _whole_number("timestamp")})


def with_reasons(events: DataFrame) -> DataFrame:
    """Add ``reasons``: the names of the fields that break a rule, empty for a valid event."""
    def broken(rule: Column, name: str) -> Column:
        return F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name))

    checks = [broken(F.col("user_id") >= MIN_ID, "user_id"), broken(F.col("movie_id") >= MIN_ID, "movie_id"),
              broken(F.col("rating").between(MIN_RATING, MAX_RATING), "rating")]
    if "_bad_timestamp" in events.columns:
        checks.append(broken(~F.col("_bad_timestamp"), "timestamp"))
    return events.withColumn("reasons", F.array_compact(F.array(*checks))).drop("_bad_timestamp")


def valid_events(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Events that keep all bounds, with a filled timestamp."""
    kept = with_reasons(events).filter(F.size("reasons") == 0).drop("reasons")
    return kept.withColumn("timestamp", default_timestamp(now=now))


def quarantined_events(events: DataFrame) -> DataFrame:
    """Rejected events with the reasons."""
    return with_reasons(events).filter(F.size("reasons") > 0)


def outcome_counts(outcomes: DataFrame, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """Events by status published, logged or failed in each time window."""
    return outcomes.groupBy(F.window(ts, width).alias("w"), "status").agg(F.count("*").alias("n")).select(
        F.unix_seconds("w.start").alias("window_start"), "status", "n")


def outcome_status(broker_up: Column, accepted: Column) -> Column:
    """What becomes of a valid event: logged without a broker, else published, or failed if the broker refused it."""
    return F.when(~broker_up, "logged").when(accepted, "published").otherwise("failed")
