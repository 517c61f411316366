"""Reminders for touched paths within a session's budget, over whole ledgers.

`streaming.reminders` does the same as a stream; both give the same rows.

A touch of a path that names are kept for may show them: once for a path in a
session, each name once in a session, none that the session has seen by itself
before, LINES lines for a session in all. Apart from that, the names that cite the
path are noted on the touch, for ROWS touches of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..sources.scratch import stored
from ..sources.tables import table

#: Lines and noted touches of a session; names kept and noted for a path.
LINES, ROWS, KEPT, NOTED = 3, 40, 8, 16


# --- operators --------------------------------------------------------------------------------------------------------


def reminder_lines(touches: DataFrame, kept: DataFrame, seen: DataFrame) -> DataFrame:
    """(session, seq, path, name, line): the names shown, `line` counting from 1 within the session.

    `touches` has (session, seq, path), `kept` (path, place, name), `seen`
    (session, seq, name); `seq` orders a session. Nothing is sorted but what may
    be shown: first touches and first showings are aggregates.
    """
    first = touches.where("session IS NOT NULL AND path IS NOT NULL").groupBy("session", "path").agg(F.min("seq").alias("seq"))
    offers = stored(first).join(kept.where(F.col("name").isNotNull() & (F.col("place") <= KEPT)).dropDuplicates(["path", "place"]), "path")
    once = offers.groupBy("session", "name").agg(F.min(F.struct("seq", "place", "path")).alias("at")).select("session", "name", "at.*")
    known = seen.groupBy("session", "name").agg(F.min("seq").alias("seen"))
    fresh = stored(once).join(stored(known), ["session", "name"], "left").where("seen IS NULL OR seen > seq")
    line = F.row_number().over(W.partitionBy("session").orderBy("seq", "place"))
    return fresh.withColumn("line", line).where(F.col("line") <= LINES).select("session", "seq", "path", "name", "line")


def noted_touches(touches: DataFrame, cited: DataFrame) -> DataFrame:
    """(session, seq, path, names, row): the first ROWS touches of a session whose path is cited, with NOTED names at most.

    `cited` has (path, place, name).
    """
    few = cited.where(F.col("name").isNotNull() & (F.col("place") <= NOTED)).dropDuplicates(["path", "place"])
    at = F.array_sort(F.collect_list(F.struct("place", "name")))
    names = few.groupBy("path").agg(F.array_join(F.transform(at, lambda x: x["name"]), ",").alias("names"))
    hits = touches.where("session IS NOT NULL").join(stored(names), "path")
    row = F.row_number().over(W.partitionBy("session").orderBy("seq"))
    return hits.withColumn("row", row).where(F.col("row") <= ROWS).select("session", "seq", "path", "names", "row")


# --- queries ----------------------------------------------------------------------------------------------------------


def touch_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(session, seq, kind, path): clicks and errors touch their item, views show it; a session is a user's day."""
    e = table(spark, sf_dir, "events") if events is None else events
    kind = F.when(F.col("event_type").isin("click", "error"), "touch").when(F.col("event_type") == "view", "seen")
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(session.alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("path")).where("kind IS NOT NULL")


def kept_names(spark: SparkSession, sf_dir: str, most: int = KEPT) -> DataFrame:
    """(path, place, name): for an item, the dearest parts of that size; a part's name is its number within its kind."""
    p = table(spark, sf_dir, "part")
    order = W.partitionBy("p_size").orderBy(F.desc("p_retailprice"), "p_partkey")
    placed = p.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.select(F.col("p_size").cast("string").alias("path"), "place", (F.col("p_partkey") % 100).cast("string").alias("name"))


def session_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names shown on touches of the events; a view of an item counts as having seen the name of that number."""
    e = touch_events(spark, sf_dir)
    seen = e.where("kind = 'seen'").select("session", "seq", F.col("path").alias("name"))
    return reminder_lines(e.where("kind = 'touch'"), kept_names(spark, sf_dir), seen)


def session_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited names noted on the touches of the events."""
    return noted_touches(touch_events(spark, sf_dir).where("kind = 'touch'"), kept_names(spark, sf_dir, NOTED))


QUERIES = {f.__name__: f for f in (session_reminders, session_citations)}

_KEPT = r"""e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session, event_id AS seq, event_type IN ('click', 'error') AS touch,
      regexp_extract(props, '"k": *([0-9]+)', 1) AS path FROM events WHERE event_type IN ('click', 'error', 'view')),
    kept AS (SELECT CAST(p_size AS VARCHAR) AS path, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS place,
      CAST(p_partkey % 100 AS VARCHAR) AS name FROM part)"""
ORACLES = {
    "session_reminders": f"""WITH {_KEPT}, f AS (SELECT session, path, min(seq) AS seq FROM e WHERE touch GROUP BY 1, 2),
        o AS (SELECT * FROM f JOIN kept USING (path) WHERE place <= 8 QUALIFY row_number() OVER (PARTITION BY session, name ORDER BY seq, place) = 1),
        x AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE NOT touch AND e.session = o.session AND e.path = o.name AND e.seq <= o.seq))
        SELECT session, seq, path, name, CAST(row_number() OVER (PARTITION BY session ORDER BY seq, place) AS INTEGER) AS line FROM x QUALIFY line <= 3""",
    "session_citations": f"""WITH {_KEPT}, n AS (SELECT path, string_agg(name, ',' ORDER BY place) AS names FROM kept WHERE place <= 16 GROUP BY 1)
        SELECT session, seq, path, names, CAST(row_number() OVER (PARTITION BY session ORDER BY seq) AS INTEGER) AS row FROM e JOIN n USING (path) WHERE touch QUALIFY row <= 40""",
}
