"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statlake.session import checkpoint_dir, ensure_defaults

#: Words of every contract: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing document id where ids are compared: later than every id.
NO_ID = (1 << 63) - 1
#: Removes a job's shuffle files once its result is written (the result is read back from the shared folder).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch: texts run to megabytes, and the default of 10,000 would hold them in the JVM and in Python at once.
_BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size to BATCH_ROWS unless the session already has a lower one."""
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_defaults(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage on storage every executor sees."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (in any letter case)."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name += "_"
    return name


def long_id(column: str) -> Column:
    """An id column as long, with missing ids after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def word_count(column: str) -> Column:
    """Words of a text column (0 for null), counted in the JVM."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def binary_column(batch: pa.RecordBatch, name: str) -> list:
    """A string column of an Arrow batch as UTF-8 bytes (None for null)."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def release_memory() -> None:
    """Give memory that a Python task has freed back to the system: workers are reused and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
