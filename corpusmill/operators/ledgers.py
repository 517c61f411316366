"""Ledgers written as JSON lines and read back, and tables of commits; lines are made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.corpus import DECISION_CHARS, LEDGERS, PREVIEW_CHARS, committed_usage, ledger_lines, parse_ledger
from ..sources.tables import table
from .ledger import _S, sessions

#: Changed paths reported at most.
MOST_PATHS = 400


def _back(rows: DataFrame, ledger: str) -> DataFrame:
    """Rows through their JSON lines."""
    return parse_ledger(ledger_lines(rows), LEDGERS[ledger])


def _turns(spark: SparkSession, sf_dir: str, asked: bool) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where("role = 'user'" if asked else "role <> 'user'")


def episode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as episodes: their sessions and the beginnings of their queries."""
    c = _turns(spark, sf_dir, True)
    rows = c.select(
        F.col("turn").cast("double").alias("ts"), F.col("conv_id").cast("string").alias("session_id"),
        F.substring(T.text_of("text"), 1, PREVIEW_CHARS).alias("query_preview"),
    )
    return _back(rows, "episode").select("session_id", "ts", F.md5("query_preview").alias("preview_md5"), F.col("head_commit").isNull().alias("no_commit"))


def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as decisions, blank ones dropped."""
    text = F.substring(F.trim(T.text_of("text")), 1, DECISION_CHARS)
    rows = _turns(spark, sf_dir, False).select(F.col("turn").cast("double").alias("ts"), F.col("conv_id").cast("string").alias("session_id"), text.alias("text"))
    d = _back(rows.where("text <> ''"), "decision")
    return d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("ts").alias("last"))


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reconsolidations of their items; errors invalidate."""
    s = sessions(spark, sf_dir)
    rows = s.select(
        F.col("event_id").cast("double").alias("ts"), F.col("item").alias("name"), F.col("event_type").alias("outcome"),
        F.when(F.col("event_type") == "error", F.lit(True)).alias("invalidated"), F.create_map(F.lit("day"), F.date_format("ts", "yyyy-MM-dd")).alias("succession_replay"),
    )
    r = _back(rows, "reconsolidation")
    return r.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count("invalidated").alias("invalidated"), F.max_by("outcome", "ts").alias("last"), F.max(F.col("succession_replay")["day"]).alias("day")
    )


def injection_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each turn by who made them, against a cap: sums by maker, and turns beyond the cap."""
    size = F.length(T.text_of("text")).cast("bigint")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.create_map(F.col("role"), size, F.lit("frame"), F.lit(10).cast("bigint")).alias("producers"),
        (size + 10).alias("total"), F.lit(120).cast("bigint").alias("cap"),
    )
    r = _back(rows, "injection_cost").select("total", "cap", F.explode("producers").alias("producer", "chars"))
    return r.groupBy("producer").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.count_if(F.col("total") > F.col("cap")).alias("over"))


def threat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of events by kind and source; rows without any aren't written."""
    s = sessions(spark, sf_dir)
    kinds = F.array_compact(F.array(F.when(F.col("event_type") == "error", F.lit("error")), F.when(F.col("value") > 90, F.lit("high"))))
    rows = s.select("session", kinds.alias("kinds"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("item").alias("name"))
    r = _back(rows.where(F.size("kinds") > 0).select(F.col("session").alias("session_id"), "source", "name", "kinds"), "threat")
    return r.select("source", "session_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("session_id").alias("sessions")
    )


def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as runs with a metric for each type of event; each metric's last run and value."""
    e = table(spark, sf_dir, "events")
    day = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = day.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("metrics"))
    rows = rows.select(F.unix_date("day").cast("double").alias("ts"), F.col("day").cast("string").alias("head"), "metrics")
    r = _back(rows, "eval_run").select("ts", "head", F.explode("metrics").alias("metric", "value"))
    return r.groupBy("metric").agg(F.count(F.lit(1)).alias("runs"), F.max_by("head", "ts").alias("head"), F.max_by("value", "ts").alias("value"))


def regret_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as regrets of items, each user and item once, at their first time."""
    s = sessions(spark, sf_dir).where("event_type = 'error'")
    r = _back(s.select(F.col("event_id").cast("double").alias("ts"), F.col("user_id").cast("string").alias("query"), F.col("item").alias("stem")), "regret")
    return r.groupBy("query", "stem").agg(F.min("ts").alias("ts"))


def usage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage files of all users together: sessions with a purchase by item, and items merely seen."""
    s = sessions(spark, sf_dir)
    per = s.groupBy("user_id", "item").agg(F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("session"))).alias("n"))
    bought = F.filter(F.collect_list(F.struct("item", "n")), lambda x: x["n"] > 0)
    rows = per.groupBy("user_id").agg(F.collect_list("item").alias("names"), F.map_from_entries(bought).alias("sessions")).drop("user_id")
    return committed_usage(_back(rows, "usage"))


def path_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts (paths) with their distinct customers (authors) through orders (commits), and the first and last."""
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).distinct()
    return files.join(commits, "sha").groupBy("path").agg(F.count_distinct("author").alias("authors"), F.min("author").alias("first"), F.max("author").alias("last"))


def basename_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last words of part names with the parts that end so; one alone is resolved."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.substring_index("p_name", " ", -1)).alias("base"))
    g = p.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("m"))
    return g.select("base", "n", F.when(F.col("n") == 1, F.col("m")).alias("path"))


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first MOST_PATHS parts in order that shipped in a range of days."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01'")
    return l.select(F.col("l_partkey").alias("path")).distinct().orderBy("path").limit(MOST_PATHS)


QUERIES = {
    f.__name__: f
    for f in (
        episode_rows, decision_rows, outcome_rows, injection_costs, threat_rows, eval_runs, regret_rows, usage_union, path_authors,
        basename_index, changed_paths,
    )
}

ORACLES = {
    "episode_rows": "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS DOUBLE) AS ts, md5(left(text, 80)) AS preview_md5, true AS no_commit FROM conversations WHERE role = 'user'",
    "decision_rows": """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n, CAST(sum(length(left(trim(text), 500))) AS BIGINT) AS chars, max(CAST(turn AS DOUBLE)) AS last
        FROM conversations WHERE role <> 'user' AND trim(text) <> '' GROUP BY 1""",
    "outcome_rows": f"""WITH {_S} SELECT item AS name, count(*) AS n, count(*) FILTER (event_type = 'error') AS invalidated, arg_max(event_type, event_id) AS last, strftime(max(ts), '%Y-%m-%d') AS day FROM s GROUP BY 1""",
    "injection_costs": """WITH c AS (SELECT role AS producer, length(text) AS chars, length(text) + 10 > 120 AS o FROM conversations UNION ALL SELECT 'frame', 10, length(text) + 10 > 120 FROM conversations)
        SELECT producer, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (o) AS over FROM c GROUP BY 1""",
    "threat_rows": f"""WITH {_S}, k AS (SELECT user_id, session, 'error' AS kind FROM s WHERE event_type = 'error' UNION ALL SELECT user_id, session, 'high' FROM s WHERE value > 90)
        SELECT kind, count(*) AS n, count(DISTINCT user_id) AS sources, count(DISTINCT session) AS sessions FROM k GROUP BY 1""",
    "eval_runs": """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type AS metric, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)
        SELECT metric, count(*) AS runs, CAST(max(day) AS VARCHAR) AS head, arg_max(n, day) AS value FROM d GROUP BY 1""",
    "regret_rows": f"""WITH {_S} SELECT CAST(user_id AS VARCHAR) AS query, item AS stem, min(event_id)::DOUBLE AS ts FROM s WHERE event_type = 'error' GROUP BY 1, 2""",
    "usage_union": f"""WITH {_S}, p AS (SELECT user_id, item, count(DISTINCT session) FILTER (event_type = 'purchase') AS n FROM s GROUP BY 1, 2)
        SELECT item AS name, CAST(sum(n) AS BIGINT) AS sessions FROM p GROUP BY 1""",
    "path_authors": """SELECT l_partkey AS path, count(DISTINCT o_custkey) AS authors, min(o_custkey) AS first, max(o_custkey) AS last FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "basename_index": """WITH p AS (SELECT p_partkey, lower(split_part(p_name, ' ', -1)) AS base FROM part)
        SELECT base, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS path FROM p GROUP BY 1""",
    "changed_paths": "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' ORDER BY 1 LIMIT 400",
}
