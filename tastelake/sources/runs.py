"""Run log: parameters, metrics, artifacts and tags of training runs as rows of one table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tastelake import schemas

KINDS = ("param", "metric", "artifact", "tag")


def log_run(spark: SparkSession, path: str, run_id: str, run_name: str, *, params: dict, metrics: dict,
            artifacts: dict, tags: dict) -> None:
    now = datetime.now(timezone.utc)
    rows = [(run_id, run_name, kind, key, str(value), now)
            for kind, entries in zip(KINDS, (params, metrics, artifacts, tags)) for key, value in entries.items()]
    spark.createDataFrame(rows, schemas.RUNS).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUNS).parquet(path)
