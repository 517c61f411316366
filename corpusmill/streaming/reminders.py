"""Reminders within a session's budget, as a stream; see `operators.reminders` for the rules.

Each session keeps two counters, the last row it has seen, and maps of paths
decided, names shown and names seen. Rows of a session are taken in order of
`seq`; a row that doesn't come after the last one is a repeat and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reminders import KEPT, LINES, NOTED, ROWS

#: The state store that processors with several states need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session string, seq bigint, path string, names string, row int, shown array<string>, line int"


class Budget(StatefulProcessor):
    """What a session may still be shown. Rows are (session, seq, kind, path, kept, cited)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "lines int, rows int, last bigint")
        self.paths = handle.getMapState("paths", "path string", "seq bigint")
        self.shown = handle.getMapState("shown", "name string", "seq bigint")
        self.seen = handle.getMapState("seen", "name string", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lines, noted, last = self.counts.get() or (0, 0, None)
        for r in sorted(rows, key=lambda r: r.seq):
            if last is not None and r.seq <= last:
                continue
            last = r.seq
            if r.kind == "seen":
                if r.path is not None:
                    self.seen.updateValue((r.path,), (r.seq,))
                continue
            names = None
            if r.cited and noted < ROWS:
                names, noted = ",".join(r.cited), noted + 1
            new: list[str] = []
            if r.kept and lines < LINES and not self.paths.containsKey((r.path,)):
                self.paths.updateValue((r.path,), (r.seq,))
                for name in r.kept:
                    if lines + len(new) >= LINES:
                        break
                    if self.shown.containsKey((name,)):
                        continue
                    self.shown.updateValue((name,), (r.seq,))
                    if not self.seen.containsKey((name,)):
                        new.append(name)
            if names is not None or new:
                yield Row(session=key[0], seq=r.seq, path=r.path, names=names, row=noted if names is not None else None, shown=new, line=lines + 1 if new else None)
            lines += len(new)
        self.counts.update((lines, noted, last))

    def close(self) -> None:
        pass


def by_path(kept: DataFrame) -> DataFrame:
    """(path, kept, cited) from (path, place, name): the names of a path in order, for showing and for noting."""
    few = kept.where(F.col("name").isNotNull() & (F.col("place") <= max(KEPT, NOTED))).dropDuplicates(["path", "place"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return few.groupBy("path").agg(names.alias("names")).select("path", F.slice("names", 1, KEPT).alias("kept"), F.slice("names", 1, NOTED).alias("cited"))


def reminders(events: DataFrame, kept: DataFrame) -> DataFrame:
    """(session, seq, path, names, row, shown, line) of the touches that note or show anything.

    `events` is a stream of (session, seq, kind, path), kind being `touch` or
    `seen` (then `path` is the name seen); `kept` a table of (path, place, name).
    """
    known = events.where("session IS NOT NULL AND seq IS NOT NULL").join(by_path(kept), "path", "left")
    rows = known.select("session", F.col("seq").cast("bigint").alias("seq"), "kind", "path", "kept", "cited")
    return rows.groupBy("session").transformWithState(Budget(), OUTPUT, "Append", "None")


def run(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Write what is there to a folder and stop; a later call goes on from the checkpoint.

    A batch that is written again after a failure replaces its own folder. The
    session's choice of a state store is as before when this returns.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
