"""Session defaults and the shared folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TASK_ROWS = 250_000  # rows of a large input in one task, about


def build_session(app: str = "tastelake", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tastelake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, inside the shared folder."""
    return f"{shared_folder(spark)}/tastelake/{name}-{uuid.uuid4().hex}"


_cleanup_lock, _cleaning = Lock(), []


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query that runs in here deletes its shuffle files when it ends, not when the driver happens to collect its garbage.

    Several threads can be in here; the last one out puts the session's setting back.
    """
    with _cleanup_lock:
        _cleaning.append(_cleaning[0] if _cleaning else spark.conf.get(CLEANUP_CONF, None))
        spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        with _cleanup_lock:
            before = _cleaning.pop()
            if not _cleaning:
                spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps file statistics, column pruning and filter
    pushdown for the readers, and survives the loss of any executor. The shuffle files behind it go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_in_turn(frames: Sequence[DataFrame], name: str) -> DataFrame:
    """One table of the rows of all frames, written one after another: the shuffle files of one are gone before the next begins."""
    spark = frames[0].sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        for df in frames:
            df.write.mode("append").parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Number of tasks of about TASK_ROWS rows; None while that leaves cores idle, so that Spark decides."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` (without keys: in turn) over as many tasks as ``rows`` rows call for; as it is while they are few.

    The tasks of a large input follow its rows and not the session's shuffle partitions, so that what one task sorts or
    groups does not grow with the input. Adaptive execution neither merges nor splits them.
    """
    tasks = tasks_for(df.sparkSession, rows)
    return df if tasks is None else df.repartition(tasks, *keys)


def together(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """Run a few independent jobs at the same time, so one's last tasks do not leave executors idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
