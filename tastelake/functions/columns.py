"""Built-in-only column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_GENRES = "(no genres listed)"
DAY_SECONDS = 24 * 3600


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.unix_date(c.cast("date")).cast("long") * DAY_SECONDS
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))


def epoch_micros(c: str | Column) -> Column:
    """Like :func:`epoch_seconds`, in microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    within_minute = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * 60_000_000 + within_minute


def iso_utc(epoch: str | Column) -> Column:
    """ISO date-time of epoch seconds with the offset ``+00:00``, whatever the session time zone."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    of_day = F.pmod(e, F.lit(DAY_SECONDS))

    def two(n: Column) -> Column:
        return F.lpad(n.cast("int").cast("string"), 2, "0")

    return F.concat(
        F.date_from_unix_date(F.floor(e / DAY_SECONDS).cast("int")).cast("string"), F.lit("T"),
        two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day % 3600 / 60)), F.lit(":"),
        two(of_day % 60), F.lit("+00:00"))


def genre_tokens(c: str | Column) -> Column:
    return F.split(c, r"\|")


def genre_count(c: str | Column) -> Column:
    """Number of pipe-separated tokens; NULL stays NULL."""
    bars = F.length(c) - F.length(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("|"), F.lit("")))
    return bars + 1


def sample_std(c: str | Column) -> Column:
    """Sample standard deviation; a single value gives 0.0."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def l2_normalised(v: str | Column) -> Column:
    """Row scaled to unit length; a zero row stays zero."""
    v = F.col(v) if isinstance(v, str) else v

    def scaled(row: Column) -> Column:
        return F.when(row["norm"] > 0, F.transform(row["v"], lambda x: x / row["norm"])).otherwise(row["v"])

    # the array of one row binds the norm, which would be worked out for every element else
    held = F.transform(F.array(v), lambda a: F.struct(a.alias("v"), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    return F.get(F.transform(held, scaled), F.lit(0))
