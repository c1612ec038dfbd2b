"""Replay of rating history as a stream of JSON lines in time order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tastelake.operators import chronology, events
from tastelake.session import new_path, tasks_for
from tastelake.sources.events import write_lines
from tastelake.streaming.ingest import read_lines


def write_replay(ratings: DataFrame, path: str, *, rate: float | None = 10, max_events: int | None = None,
                 chunks: int = 10) -> int:
    """Write the events in ``chunks`` consecutive appends of equal size, oldest first; a folder stream
    picks them up in that order. Returns the number of events. Pacing is the column ``emit_offset_s``
    of the schedule; nothing sleeps here."""
    spark = ratings.sparkSession
    placed = chronology.replay_schedule(chronology.chronological_head(ratings, max_events), rate)
    total = placed.count()
    chunk = F.floor(F.col("pos") * chunks / max(total, 1))
    table = new_path(spark, "replay")
    (events.to_event_json(placed).select("pos", "value", chunk.alias("chunk"))
     .write.partitionBy("chunk").parquet(table))
    for i in range(chunks):
        one = spark.read.parquet(table).filter(F.col("chunk") == i)
        write_lines(one.sortWithinPartitions("pos"), path)
    return total


def read_replay(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    return read_lines(spark, path, files_per_trigger)


def _in_order(df: DataFrame, first: int, n: int) -> DataFrame:
    """The rows of ``n`` consecutive positions from ``first`` on, in order over tasks of equal size; no pass looks for their borders."""
    tasks = tasks_for(df.sparkSession, n) or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionById(tasks, F.floor((F.col("pos") - first) * tasks / n).cast("int")).sortWithinPartitions("pos")


def write_ordered_replay(ratings: DataFrame, path: str, *, rate: float | None = 10, max_events: int | None = None, chunks: int = 10) -> int:
    """As :func:`write_replay`, for a strict order: all events with their positions are written in parallel as ``path/data``, in chunks of consecutive
    positions; then one line per chunk is committed to ``path/commits``, in order. Returns the number of events."""
    spark = ratings.sparkSession
    placed = chronology.replay_schedule(chronology.chronological_head(ratings, max_events), rate)
    total = placed.count()
    chunk = F.floor(F.col("pos") * chunks / max(total, 1)).alias("chunk")
    (events.to_event_json(_in_order(placed, 0, max(total, 1))).select("pos", "value", chunk)
     .write.partitionBy("chunk").parquet(f"{path}/data"))
    for i in range(chunks if total else 0):
        write_lines(spark.range(1).select(F.lit(str(i)).alias("value")).coalesce(1), f"{path}/commits")
    return total


def play_ordered(spark: SparkSession, path: str, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Stream the commits of an ordered replay and hand over each committed chunk: ``deliver(rows, chunk)`` gets ``value`` and ``pos``, partitions and
    the rows within them in order. A chunk that does not follow the one before it is an error. A chunk that is replayed
    after a failure comes again under its number.
    """
    def batch(commits: DataFrame, batch_id: int) -> None:
        for (chunk,) in commits.select(F.col("value").cast("long").alias("chunk")).orderBy("chunk").collect():  # one commit a batch
            if chunk != batch_id:
                raise RuntimeError(f"chunk {chunk} was committed where {batch_id} is due")
            rows = spark.read.parquet(f"{path}/data").filter(F.col("chunk") == chunk).select("pos", "value")
            first, last = rows.agg(F.min("pos"), F.max("pos")).first()
            deliver(rows if first is None else _in_order(rows, first, last - first + 1), chunk)

    return (read_lines(spark, f"{path}/commits", 1).writeStream.foreachBatch(batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
