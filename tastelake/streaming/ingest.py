"""Event ingest as a stream: lines in, valid and quarantined tables out, with publishing."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tastelake.operators import events
from tastelake.session import new_path
from tastelake.sources import events as sinks


def read_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of text lines from a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_topic(spark: SparkSession, servers: str, topic: str = sinks.TOPIC) -> DataFrame:
    """Stream of lines from a topic; needs the Kafka connector on the class path."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).load().select(F.col("value").cast("string").alias("value")))


def batch_writer(root: str, now: Column | None = None, primary=None):
    """foreachBatch function. Each batch owns one folder per output and overwrites it, so a batch that
    is replayed after a failure leaves its rows once. Rejected events are in quarantine and have no outcome."""
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = events.parse_events(batch).persist()
        clock = F.lit(int(time.time())) if now is None else now  # one default time for all outputs of the batch
        try:
            good = events.valid_events(parsed, clock)
            bad = events.quarantined_events(parsed)
            good.drop("value").write.mode("overwrite").parquet(f"{root}/valid/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")
            status = "published"
            if primary is not None:
                lines = good.select(F.to_json(events.event_struct()).alias("value"))
                status = sinks.publish(lines, primary, f"{root}/logged/batch_id={batch_id}")
            good.select(F.lit(status).alias("status"), "timestamp").write.mode("overwrite").parquet(f"{root}/outcomes/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return write


def start_ingest(lines: DataFrame, root: str, now: Column | None = None, primary=None) -> StreamingQuery:
    """Drain what is there and stop. The checkpoint lives beside the outputs, so a restart continues."""
    return (lines.writeStream.foreachBatch(batch_writer(root, now, primary))
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())


def ingest(lines: DataFrame, root: str | None = None, now: Column | None = None, primary=None) -> str:
    """Run the ingest to the end of its input; returns the output root."""
    root = root or new_path(lines.sparkSession, "ingest")
    start_ingest(lines, root, now, primary).awaitTermination()
    return root
