"""Intermediate results as tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: With this Spark removes the shuffle files of a query when it ends; a table that was written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []
#: Tables that are still there, by path; those of the scopes that are open, the innermost last.
_MADE: dict[str, DataFrame] = {}
_SCOPES: list[list[DataFrame]] = []


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a temporary folder in local mode, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/tables"
    if spark.sparkContext.master.split("[")[0] != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-tables-"))
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet to the shared folder and read it back, so that what follows starts from the table.

    Executors that are lost later cost no recomputation of `df`. The shuffle
    files that made it go when the write ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    _MADE[path] = table
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables stored within are deleted at its end; results must have been written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        forget(*_SCOPES.pop())


@atexit.register
def _forget_all() -> None:
    """What is left goes when the driver ends, if its session is still there."""
    with contextlib.suppress(Exception):
        forget(*_MADE.values())


def forget(*tables: DataFrame) -> None:
    """Delete tables that `stored` made and that nothing reads any more; those that are gone already are no error."""
    for table in list(tables):
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.pop(table.stored_at, None)
