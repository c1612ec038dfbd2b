"""Tables that are replaced as a whole while they are read.

A table is a few slots and a mark for each. A new version goes into the slot after that of the newest mark; its mark is written last. Readers follow the
newest mark, so a version that is being written, or that was left half written, is never seen. A slot is reused after ``SLOTS`` versions: until
then a reader of an old version keeps its files, and no version beyond ``SLOTS`` takes space. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

SLOTS = 3
_MARK = "version long"


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _marks(spark: SparkSession, path: str) -> dict[int, int]:
    """The version of each marked slot; a mark that is just being replaced counts as absent."""
    found = {}
    for slot in range(SLOTS):
        try:
            rows = spark.read.schema(_MARK).option("ignoreMissingFiles", "true").parquet(f"{path}/mark-{slot}").collect()  # one row
        except AnalysisException as error:
            if not path_missing(error):
                raise
            continue
        found |= {slot: r["version"] for r in rows}
    return found


def newest(spark: SparkSession, path: str, below: int | None = None) -> tuple[int, int] | None:
    """(version, slot) that readers get, the newest one ``below`` a version if given, or None if there is none."""
    marks = _marks(spark, path)
    return max(((version, slot) for slot, version in marks.items() if below is None or version < below), default=None)


def write_version(df: DataFrame, path: str, version: int | None = None) -> int:
    """Replace the table by ``df``, which may read the table itself. Returns the version.

    With a ``version`` (the number of a batch, say), a write that is repeated after its mark was set does nothing.
    """
    spark = df.sparkSession
    now, slot = newest(spark, path) or (-1, SLOTS - 1)
    version = now + 1 if version is None else version
    if version > now:
        after = (slot + 1) % SLOTS
        df.write.mode("overwrite").parquet(f"{path}/slot-{after}")
        spark.createDataFrame([(version,)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{path}/mark-{after}")
    return version


def read_version(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """The newest complete version, or the newest one ``below`` a version that still has its slot; an empty table if there is none."""
    found = newest(spark, path, below)
    return spark.createDataFrame([], schema) if found is None else spark.read.schema(schema).parquet(f"{path}/slot-{found[1]}")
