"""A ledger of applied edges whose later rows take back earlier ones, as a table at any moment.

A ledger row is (seq, edge_id, state, pass, source, target, applied_at); rows of an
edge are merged in order of `seq`, and a null field leaves what was known. So an undo
is a sparse row, an edge can be applied again, and nothing is ever rewritten. States
are `active`, `undone` and `expired`; others count as not active. Rows without an
edge id or a place are nothing. `seq` is unique for an edge; of equal ones the greater
value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.tables import table

FIELDS = ("state", "pass", "source", "target", "applied_at")
#: Distinct sessions after which an active edge has aged in.
AGE = 10
#: Places of a ledger that are put in order together; their counts, one row each, are in one task.
BLOCK = 1_000_000


# --- operators --------------------------------------------------------------------------------------------------------


def edge_states(ledger: DataFrame, at: Column | int | None = None) -> DataFrame:
    """(edge_id, state, pass, source, target, applied_at, first_seq, last_seq): every edge as the rows up to `at` leave it.

    One aggregation that combines before it shuffles, so an edge with very many
    rows costs no sort.
    """
    rows = ledger.where("edge_id IS NOT NULL AND seq IS NOT NULL")
    rows = rows if at is None else rows.where(F.col("seq") <= at)
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c) for c in FIELDS]
    return rows.groupBy("edge_id").agg(*last, F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def aged_in(now: Column | int, window: int = AGE) -> Column:
    """Whether an edge has been there for `window` sessions; one without a usable count never has."""
    return F.coalesce((F.col("applied_at") >= 0) & (F.lit(now) - F.col("applied_at") >= window), F.lit(False))


def young_pairs(states: DataFrame, now: Column | int, window: int = AGE) -> DataFrame:
    """(src, dst) of active edges that haven't aged in, for `discovery.pair_distances` to leave out."""
    rows = states.where((F.col("state") == "active") & ~aged_in(now, window)).where("source IS NOT NULL AND target IS NOT NULL")
    return rows.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def edge_intervals(ledger: DataFrame) -> DataFrame:
    """(edge_id, state, since, until): when an edge was in a state; `until` is null where it still is.

    Rows that don't change the state open no interval, so a ledger is a table at
    any moment t: the intervals with since <= t and (until is null or t < until).
    """
    rows = ledger.where("edge_id IS NOT NULL AND seq IS NOT NULL AND state IS NOT NULL")
    # Equal places are one row, before the window.
    rows = rows.groupBy("edge_id", "seq").agg(F.max("state").alias("state"))
    order = W.partitionBy("edge_id").orderBy("seq")
    changes = rows.withColumn("before", F.lag("state").over(order)).where("before IS NULL OR before <> state")
    return changes.select("edge_id", "state", F.col("seq").alias("since"), F.lead("seq").over(order).alias("until"))


def undo_rows(
    ledger: DataFrame, *, edge_ids: DataFrame | None = None, since: int | None = None, sessions: int | None = None, now: int | None = None
) -> DataFrame:
    """The rows (seq, edge_id, state, pass) that an undo appends, the edge that came last first.

    Of the active edges: those of `edge_ids` (edge_id); those applied at place
    `since` or later; those of the last `sessions` sessions before `now`; else
    those of the pass of the edge that came last. Places go on from the last one.
    """
    active = edge_states(ledger).where("state = 'active'")
    if edge_ids is not None:
        chosen = active.join(edge_ids.select("edge_id").distinct(), "edge_id", "left_semi")
    elif since is not None:
        # When it was last applied, not when it was first seen: an edge may have come again.
        applied = edge_intervals(ledger).where("state = 'active' AND until IS NULL AND since IS NOT NULL").select("edge_id", F.col("since").alias("applied"))
        chosen = active.join(applied.where(F.col("applied") >= since), "edge_id", "left_semi")
    elif sessions is not None:
        chosen = active.where(F.lit(now) - F.col("applied_at") < sessions)
    else:
        latest = active.agg(F.max_by("pass", F.struct("first_seq", "edge_id")).alias("latest"))
        chosen = active.join(F.broadcast(latest), F.col("pass").eqNullSafe(F.col("latest")), "left_semi")  # one row
    end = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end"))
    # Places among the chosen without one sort of all: counts of later blocks, then places within a block.
    block = F.floor(F.col("first_seq") / F.lit(BLOCK))
    sized = chosen.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("size"))
    before = sized.select("block", (F.sum("size").over(W.orderBy(F.desc("block"))) - F.col("size")).alias("before"))
    within = F.row_number().over(W.partitionBy("block").orderBy(F.desc("first_seq"), F.desc("edge_id")))
    placed = chosen.withColumn("block", block).join(before, "block").crossJoin(F.broadcast(end))
    return placed.select((F.col("end") + F.col("before") + within).cast("bigint").alias("seq"), "edge_id", F.lit("undone").alias("state"), "pass")


def appended(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """A ledger with more rows; fields that they lack are null."""
    return ledger.unionByName(rows, allowMissingColumns=True)


# --- queries ----------------------------------------------------------------------------------------------------------


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an edge ledger: clicks and purchases apply the edge from user to item, errors undo it, signups let it
    expire, views are sparse rows. A pass is a day; the count of sessions is that of days."""
    e = table(spark, sf_dir, "events")
    item = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint")
    applies = F.col("event_type").isin("click", "purchase")
    state = F.when(applies, "active").when(F.col("event_type") == "error", "undone").when(F.col("event_type") == "signup", "expired")
    return e.select(
        F.col("event_id").alias("seq"), F.concat_ws("-", F.col("user_id").cast("string"), item.cast("string")).alias("edge_id"), state.alias("state"),
        F.when(applies, F.date_format("ts", "yyyy-MM-dd")).alias("pass"), F.when(applies, F.col("user_id")).alias("source"), F.when(applies, item).alias("target"),
        F.when(applies, F.datediff("ts", F.lit("2024-01-01"))).alias("applied_at"),
    )


def edge_ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges as the whole ledger leaves them, and whether they have aged in at its end."""
    rows = edge_rows(spark, sf_dir)
    now = rows.agg(F.max("applied_at").alias("now"))
    found = edge_states(rows).crossJoin(F.broadcast(now))  # one row
    return found.select("edge_id", "state", "pass", "applied_at", "first_seq", "last_seq", (aged_in(F.col("now")) & F.col("state").eqNullSafe("active")).alias("aged"))


def edge_ledger_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_intervals(edge_rows(spark, sf_dir))


def edge_ledger_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges active before and after the last pass is undone, by pass, where that differs."""
    rows = edge_rows(spark, sf_dir)
    undone = undo_rows(rows)
    after = edge_states(appended(rows, undone)).where("state <> 'active'").select("edge_id")
    gone = edge_states(rows).where("state = 'active'").join(after, "edge_id", "left_semi")
    return gone.join(undone.select("edge_id", "seq"), "edge_id").select("edge_id", "pass", "seq")


QUERIES = {f.__name__: f for f in (edge_ledger_states, edge_ledger_intervals, edge_ledger_undo)}

_ROWS = r"""rows AS (SELECT event_id AS seq, user_id || '-' || regexp_extract(props, '"k": *([0-9]+)', 1) AS edge_id,
      CASE WHEN event_type IN ('click', 'purchase') THEN 'active' WHEN event_type = 'error' THEN 'undone' WHEN event_type = 'signup' THEN 'expired' END AS state,
      CASE WHEN event_type IN ('click', 'purchase') THEN strftime(ts, '%Y-%m-%d') END AS pass,
      CASE WHEN event_type IN ('click', 'purchase') THEN CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) END AS applied_at FROM events),
    states AS (SELECT edge_id, arg_max(state, seq) FILTER (state IS NOT NULL) AS state, arg_max(pass, seq) FILTER (pass IS NOT NULL) AS pass,
      arg_max(applied_at, seq) FILTER (applied_at IS NOT NULL) AS applied_at, min(seq) AS first_seq, max(seq) AS last_seq FROM rows GROUP BY 1)"""
ORACLES = {
    "edge_ledger_states": f"""WITH {_ROWS} SELECT *, coalesce(state = 'active' AND (SELECT max(applied_at) FROM rows) - applied_at >= 10, false) AS aged FROM states""",
    "edge_ledger_intervals": f"""WITH {_ROWS}, c AS (SELECT edge_id, state, seq FROM rows WHERE state IS NOT NULL
        QUALIFY coalesce(lag(state) OVER (PARTITION BY edge_id ORDER BY seq), '') <> state)
        SELECT edge_id, state, seq AS since, lead(seq) OVER (PARTITION BY edge_id ORDER BY seq) AS until FROM c""",
    "edge_ledger_undo": f"""WITH {_ROWS}, a AS (SELECT * FROM states WHERE state = 'active')
        SELECT edge_id, pass, (SELECT max(seq) FROM rows) + row_number() OVER (ORDER BY first_seq DESC, edge_id DESC) AS seq FROM a
        WHERE pass = (SELECT pass FROM a ORDER BY first_seq DESC, edge_id DESC LIMIT 1)""",
}
