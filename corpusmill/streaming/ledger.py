"""Structured Streaming over ledgers: windowed volumes, deduplication and the session-change fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with its schema taken from the table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_volumes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type; rows later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    )


def once_per_id(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def usage_fold(events: DataFrame) -> DataFrame:
    """(item, transitions, last_session): how often the session of an item's uses changed so far.

    Counts changes from one use to the next in order of arrival, so A, B, A
    counts three. State is one short row for each item.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for pdf in batches:
            for session in pdf.sort_values(["ts", "event_id"])["session"]:
                n, last = (n + 1, session) if session != last else (n, last)
        state.update((n, last))
        yield pd.DataFrame({"item": [key[0]], "transitions": [n], "last_session": [last]})

    keyed = events.select(
        "event_id", "ts",
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("item"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
    )
    return keyed.groupBy("item").applyInPandasWithState(
        fold, "item string, transitions long, last_session string", "n long, last string", "update", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, mode: str, checkpoint: str, path: str) -> None:
    """Write all rows that are there to a folder, batch after batch, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    query.trigger(availableNow=True).start().awaitTermination()
