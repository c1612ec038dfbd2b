"""Feature lookups by key and the latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

STATS_FIELDS = ("avg_rating", "rating_count", "rating_stddev")


def batch_lookup(features: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Feature rows whose key is among ``ids``; no ids give no rows."""
    return features.join(ids.select(key), key, "left_semi")


def point_lookup(features: DataFrame, key: str, value: int, fields: Sequence[str]) -> DataFrame:
    """Named features of one key as doubles, or no row. The filter reaches the Parquet scan."""
    return features.filter(F.col(key) == value).select(key, *[F.col(f).cast("double").alias(f) for f in fields])


def online_offline_lookup(ids: DataFrame, online: DataFrame, offline: DataFrame, key: str,
                          fields: Sequence[str]) -> DataFrame:
    """Online values first, offline values where online has none; a field missing in both is 0.0 and a
    key missing in both gives no row."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(key, F.lit(True).alias(f"_{tag}"),
                         *[F.col(f).cast("double").alias(f"_{tag}_{f}") for f in fields])

    joined = (ids.select(key).distinct().join(side(online, "on"), key, "left")
              .join(side(offline, "off"), key, "left"))
    return joined.filter(F.col("_on") | F.col("_off")).select(
        key,
        F.when(F.col("_on"), "online").otherwise("offline").alias("source"),
        *[F.coalesce(f"_on_{f}", f"_off_{f}", F.lit(0.0)).alias(f) for f in fields])


def latest_per_key(features: DataFrame, keys: Sequence[str], ts: str = "event_timestamp",
                   created: str = "created_timestamp") -> DataFrame:
    """Latest feature row per key, ties to the latest created. Combines before the shuffle."""
    rest = [c for c in features.columns if c not in keys]
    order = [c for c in (ts, created) if c in features.columns]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return features.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")
