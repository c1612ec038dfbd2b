"""Streaming feature views: windowed statistics, running totals and late rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tastelake.operators import lookup, rolling
from tastelake.session import new_path
from tastelake.sources import versions

PROGRESS_KEPT = 1_000_000
COMPACT_EVERY = 10      # batches of running totals between two compactions
LATENESS_SECONDS = 3600
_WATERMARK = T.StructType([T.StructField("latest", T.LongType())])


def windowed_stream(events: DataFrame, key: str | Sequence[str], width: str = "1 hour", slide: str | None = None,
                    lateness: str = rolling.LATENESS, ts: str = "ts") -> DataFrame:
    """Windowed statistics of a stream; rows later than the watermark are dropped."""
    return rolling.windowed_stats(events.withWatermark(ts, lateness), key, width, slide, ts)


def append_closed_windows(stats: DataFrame, path: str) -> StreamingQuery:
    """Append each window once it can no longer change."""
    return (stats.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start())


def drain_windows(stats: DataFrame) -> tuple[DataFrame, int]:
    """Run to the end of the input: the closed windows, and how many rows came too late."""
    spark = stats.sparkSession
    path = new_path(spark, "windows")
    conf, key = spark.conf, "spark.sql.streaming.numRecentProgressUpdates"
    before = conf.get(key)
    conf.set(key, str(PROGRESS_KEPT))  # the late rows of all batches count, not those of the last hundred
    try:
        query = append_closed_windows(stats, path)
        query.awaitTermination()
        return spark.read.schema(stats.schema).parquet(path), late_rows(query)
    finally:
        conf.set(key, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, from the progress of a query."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def running_totals(events: DataFrame, key: str | Sequence[str], path: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Totals per key (or keys); each batch leaves the totals that changed, in a folder of its own.

    Every ``compact_every`` batches the current totals become a new version of the base table, and folders of batches it covers are used
    again, so the table takes ``2 * compact_every`` such folders and the slots of the base, however many batches there are. A batch that is
    replayed leaves its rows once.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(_folder(path, batch_id, compact_every))
        if (batch_id + 1) % compact_every == 0:
            now = _newest_totals(batch.sparkSession, path, _keys(key), compact_every)
            versions.write_version(now, f"{path}/base", version=batch_id)

    return (rolling.running_stats(events, key).writeStream.outputMode("update").foreachBatch(append)
            .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start())


def _folder(path: str, batch_id: int, compact_every: int) -> str:
    return f"{path}/batch-{batch_id % (2 * compact_every)}"


def _newest_totals(spark: SparkSession, path: str, keys: list[str], compact_every: int) -> DataFrame:
    """The base and the batches after it. A folder among theirs may hold a batch the base covers, to be replaced at any time: its
    rows do not count, and neither does it matter if they vanish."""
    base = versions.newest(spark, f"{path}/base")
    done = -1 if base is None else base[0]
    after = ",".join(str(i % (2 * compact_every)) for i in range(done + 1, done + 1 + compact_every))
    parts = [] if base is None else [spark.read.parquet(f"{path}/base/slot-{base[1]}")]
    try:
        parts.append(spark.read.option("ignoreMissingFiles", "true").parquet(f"{path}/batch-{{{after}}}").filter(F.col("batch_id") > done))
    except AnalysisException as error:
        if base is None or not versions.path_missing(error):
            raise
    return lookup.latest_per_key(reduce(DataFrame.unionByName, parts), keys, "batch_id", "event_timestamp")


def online_table(spark: SparkSession, path: str, key: str | Sequence[str], compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Current totals: the last row per key of the base and the batches since. ``compact_every`` is that of the writer."""
    return _newest_totals(spark, path, _keys(key), compact_every).drop("batch_id")


def part_late(events: DataFrame, root: str, ts: str = "ts", width: int = 0, lateness: int = LATENESS_SECONDS) -> StreamingQuery:
    """Part a stream into rows in time and late rows, so that none is dropped unseen.

    A row is late when the window of ``width`` seconds it lies in had ended at the watermark, with ``width`` 0 when its own time lies before it:
    the latest time of all batches before, less ``lateness`` seconds. Rows without a time are late. Each batch owns a folder of ``timely``, of ``late`` and of ``metrics`` (batch_id, n_rows, n_late,
    watermark in microseconds; null in the first) under ``root``, and replaces it on replay. The watermark is a table of one row, so the driver keeps
    nothing.
    """
    at = F.unix_micros(ts)
    ends = at + 1 if not width else (F.floor(at / (width * 1_000_000)) + 1) * (width * 1_000_000)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = versions.read_version(spark, f"{root}/watermark", _WATERMARK, below=batch_id).first()  # one row
        mark = F.lit(None if before is None else before["latest"]).cast("long") - lateness * 1_000_000
        batch = batch.withColumn("_late", F.coalesce(ends <= mark, F.col(ts).isNull())).persist()
        try:
            for name, rows in (("timely", ~F.col("_late")), ("late", F.col("_late"))):
                batch.filter(rows).drop("_late").write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
            counted = batch.agg(F.count("*").alias("n_rows"), F.count_if("_late").alias("n_late"), F.max(at).alias("latest")).first()
        finally:
            batch.unpersist()
        spark.range(1).select(F.lit(counted["n_rows"]).alias("n_rows"), F.lit(counted["n_late"]).alias("n_late"), mark.alias("watermark")) \
            .write.mode("overwrite").parquet(f"{root}/metrics/batch_id={batch_id}")
        latest = [v for v in (before and before["latest"], counted["latest"]) if v is not None]
        if latest:
            versions.write_version(spark.createDataFrame([(max(latest),)], _WATERMARK).coalesce(1), f"{root}/watermark", version=batch_id)

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
