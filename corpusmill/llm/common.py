"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import forget, stored

__all__ = ["BATCH_ROWS", "arrow_schema", "forget", "per_text", "small_batches", "stored", "table"]

#: Rows in one Arrow batch. Texts may be very long, so batches hold few rows.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory that one Arrow batch of whole texts can take."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def per_text(
    df: DataFrame,
    work: Callable[[list[bytes]], list[tuple]],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Apply `work` to batches of whole texts as UTF-8 bytes; one output row each.

    `schema` names the columns after the key. A null text is an empty one. Only
    the key and the text leave the JVM, so other columns of `df`, whatever their
    names, neither cost anything nor clash.
    """
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    target = arrow_schema(df.sparkSession, f"`{key}` {kind}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = work(batch.column(1).to_pylist())
            columns = list(zip(*rows)) if rows else [()] * (len(target) - 1)
            arrays = [pa.array(c, type=target.field(i + 1).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), *arrays], schema=target)

    source = df.select(
        F.col(f"`{key}`"),
        F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"),
    )
    return source.mapInArrow(run, f"`{key}` {kind}, {schema}")


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
