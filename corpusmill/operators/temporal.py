"""Drift and age: what changed after a row's baseline, and how old or expired rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..sources.scratch import stored
from ..sources.tables import table

#: The moment that ages are taken at.
NOW = "1998-12-01 00:00:00"
#: Days for which a lapsed row is recent, and over which the recency prior falls to nothing.
EXPIRY_DAYS, RECENCY_DAYS = 30, 180


def stale(rows: DataFrame, changes: DataFrame, key: str, item: str) -> DataFrame:
    """(key, changed, recency) of rows with an item that changed after their baseline.

    `rows` has (key, item, baseline), one row for each cited item; `changes` has
    (item, changed_at). A null baseline or change never counts.
    """
    last = changes.groupBy(item).agg(F.max("changed_at").alias("changed_at"))
    hit = rows.join(last, item).where("changed_at > baseline")
    return hit.groupBy(key).agg(F.count_distinct(item).alias("changed"), F.max("changed_at").alias("recency"))


def expiry_state(stamp: Column, now: Column, days: int = 30) -> Column:
    """null if the stamp is unknown or still ahead, else `recent` up to `days` ago, `old` beyond."""
    age = F.datediff(now, stamp)
    return F.when(stamp <= now, F.when(age < days, "recent").otherwise("old"))


def recency_boost(stamp: Column, now: Column, most: float = 0.10, days: int = 180) -> Column:
    """`most` now or ahead of it, falling in a line to 0 after `days`."""
    age = F.greatest(F.datediff(now, stamp), F.lit(0))
    return F.greatest(F.lit(0.0), most * (1 - age / days))


def staleness_penalty(changed: Column, most: float = 0.15, full: int = 5) -> Column:
    """Grows with the changed items up to `most`; an unknown number counts as one."""
    return most * F.least(F.lit(1.0), F.coalesce(changed, F.lit(1)) / full)


# --- queries: orders cite parts, line items change them ---------------------------------------------------------------


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz").cast("timestamp")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_orderdate").alias("baseline"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("item"))
    return l.join(o, "order").distinct()


def drift_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a part that shipped after them, how many such parts, and the latest such day."""
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_shipdate").alias("changed_at"))
    return stale(_cited(spark, sf_dir), changes, "order", "item").select("order", "changed", F.to_date("recency").alias("recency"))


def drift_citation_rot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the cited parts that the catalogue of dear parts doesn't list; orders without any are left out."""
    parts = table(spark, sf_dir, "part").where("p_retailprice >= 1200").select(F.col("p_partkey").alias("item"))
    lost = _cited(spark, sf_dir).join(parts, "item", "left_anti")
    return lost.groupBy("order").agg(F.count(F.lit(1)).alias("n_lost"))


def volatile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines all were returned or accepted: suppressed; others active."""
    l = table(spark, sf_dir, "lineitem")
    g = l.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag").isin("R", "A")).alias("suppressed"), F.count(F.lit(1)).alias("n"))
    return g.select("l_orderkey", "suppressed", "n")


def expiry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = expiry_state(F.col("o_orderdate"), _now(), EXPIRY_DAYS)
    return o.groupBy("o_orderpriority", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def recency_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(recency_boost(F.col("o_orderdate"), _now(), days=RECENCY_DAYS), 6).alias("boost")).where("boost > 0")


def salience_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(1 + recency)(1 + usage)(1 - staleness) of each order; usage is its lines over the most that any has."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("changed"), F.count(F.lit(1)).alias("n")
    )
    n = stored(n)
    most = n.agg(F.max("n").alias("most"))
    r = recency_boost(F.col("o_orderdate"), _now(), days=RECENCY_DAYS)
    u = 0.10 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("most"))
    return o.join(n, "o_orderkey", "left").crossJoin(F.broadcast(most)).select(
        "o_orderkey", F.round((1 + r) * (1 + u) * (1 - staleness_penalty(F.col("changed"))), 9).alias("factor")
    )


def staleness_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median age of orders in days by status, one place."""
    o = table(spark, sf_dir, "orders")
    age = F.datediff(_now(), "o_orderdate")
    return o.groupBy("o_orderstatus").agg(F.round(F.median(age.cast("double")), 1).alias("half_life"))


def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest orders of the last fourteen days of the table."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    near = o.crossJoin(F.broadcast(last)).where(F.datediff("last", "o_orderdate") <= 14)
    order = near.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return order.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are cold (no line this big), cheap, and without open lines."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    hot = l.where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey")).distinct()
    open_ = l.where("l_linestatus = 'O' AND l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return p.where("p_retailprice < 1500").join(hot, "p_partkey", "left_anti").join(open_, "p_partkey", "left_anti").select("p_partkey")


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drifted orders of the five latest order days of each customer, without finished ones."""
    o = table(spark, sf_dir, "orders")
    order = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    recent = o.withColumn("n", F.row_number().over(order)).where("n <= 5 AND o_orderstatus <> 'F'")
    drifted = drift_stale(spark, sf_dir).withColumnRenamed("order", "o_orderkey")
    return recent.join(drifted, "o_orderkey").select("o_orderkey", "o_custkey", "changed")


def interval_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per purchase the errors of other users within 60 seconds: a range join on time buckets."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    width = 60_000_000
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "at", F.explode(F.sequence(F.floor(F.col("at") / width) - 1, F.floor(F.col("at") / width) + 1)).alias("bucket"))
    b = e.where("event_type = 'error'").select(F.col("user_id").alias("other"), F.col("at").alias("t"), F.floor(F.col("at") / width).alias("bucket"))
    near = a.join(b, "bucket").where((F.abs(F.col("at") - F.col("t")) <= width) & (F.col("user_id") != F.col("other")))
    return near.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_near"))


def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even and odd sources as two snapshots by first line: added, changed, removed, same."""
    d = table(spark, sf_dir, "documents").select(F.md5(F.substring_index(T.text_of("text"), "\n", 1)).alias("name"), F.md5("text").alias("h"), "source", "doc_id")
    old = d.where("source <= 'src12'").groupBy("name").agg(F.min("h").alias("old"))
    new = d.where("source > 'src12'").groupBy("name").agg(F.min("h").alias("new"))
    op = (
        F.when(F.col("old").isNull(), "ADD").when(F.col("new").isNull(), "DELETE").when(F.col("old") != F.col("new"), "UPDATE").otherwise("SAME")
    )
    return old.join(new, "name", "full_outer").groupBy(op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        drift_stale, drift_citation_rot, volatile_split, expiry_states, recency_priors, salience_fold, staleness_half_life,
        recent_rows, archive_candidates, worklist, interval_decisions, snapshot_delta,
    )
}

_T = f"TIMESTAMP '{NOW}'"
_AGE = f"date_diff('day', o_orderdate, {_T})"
_BOOST = f"greatest(0.0::DOUBLE, 0.1::DOUBLE * (1 - greatest({_AGE}, 0) / {RECENCY_DAYS}))"
_DRIFT = """c AS (SELECT DISTINCT l_orderkey AS "order", l_partkey AS item, o_orderdate AS baseline FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    m AS (SELECT l_partkey AS item, max(l_shipdate) AS changed_at FROM lineitem GROUP BY 1),
    drift AS (SELECT "order", count(DISTINCT item) AS changed, CAST(max(changed_at) AS DATE) AS recency FROM c JOIN m USING (item) WHERE changed_at > baseline GROUP BY 1)"""

ORACLES = {
    "drift_stale": f"WITH {_DRIFT} SELECT * FROM drift",
    "drift_citation_rot": """SELECT l_orderkey AS "order", count(DISTINCT l_partkey) AS n_lost FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice >= 1200) GROUP BY 1""",
    "volatile_split": "SELECT l_orderkey, bool_and(l_returnflag IN ('R', 'A')) AS suppressed, count(*) AS n FROM lineitem GROUP BY 1",
    "expiry_states": f"""SELECT o_orderpriority, CASE WHEN o_orderdate <= {_T} THEN CASE WHEN {_AGE} < {EXPIRY_DAYS} THEN 'recent' ELSE 'old' END END AS state,
        count(*) AS n FROM orders GROUP BY 1, 2""",
    "recency_priors": f"SELECT o_orderkey, round({_BOOST}, 6) AS boost FROM orders WHERE round({_BOOST}, 6) > 0",
    "salience_fold": f"""WITH n AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'R') AS changed, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey, round((1 + {_BOOST}) * (1 + 0.1::DOUBLE * least(1.0::DOUBLE, coalesce(n, 0) / (SELECT max(n) FROM n))) * (1 - 0.15::DOUBLE * least(1.0::DOUBLE, coalesce(changed, 1) / 5)), 9) AS factor
        FROM orders LEFT JOIN n USING (o_orderkey)""",
    "staleness_half_life": f"SELECT o_orderstatus, round(median(CAST({_AGE} AS DOUBLE)), 1) AS half_life FROM orders GROUP BY 1",
    "recent_rows": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
        WHERE date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) <= 14 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""",
    "archive_candidates": """SELECT p_partkey FROM part WHERE p_retailprice < 1500 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem
        WHERE l_quantity >= 48 OR (l_linestatus = 'O' AND l_quantity >= 40))""",
    "worklist": f"""WITH {_DRIFT}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        SELECT o_orderkey, o_custkey, changed FROM r JOIN drift ON o_orderkey = "order" WHERE n <= 5 AND o_orderstatus <> 'F'""",
    "interval_decisions": """SELECT a.event_id, count(*) AS n_near FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'error'
        AND a.user_id <> b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000 GROUP BY 1""",
    "snapshot_delta": """WITH d AS (SELECT md5(split_part(text, chr(10), 1)) AS name, md5(text) AS h, source FROM documents),
        o AS (SELECT name, min(h) AS old FROM d WHERE source <= 'src12' GROUP BY 1), n AS (SELECT name, min(h) AS new FROM d WHERE source > 'src12' GROUP BY 1)
        SELECT CASE WHEN old IS NULL THEN 'ADD' WHEN new IS NULL THEN 'DELETE' WHEN old <> new THEN 'UPDATE' ELSE 'SAME' END AS op, count(*) AS n
        FROM o FULL JOIN n USING (name) GROUP BY 1""",
}
