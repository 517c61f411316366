"""Analytics over append-only event ledgers: usage, strength, co-occurrence, latency, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..sources.tables import table

#: Sessions that a pair must share, and pairs reported.
MIN_SESSIONS, MOST_PAIRS = 3, 20


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with session (user and day) and item (the number in props)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "*",
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("item"),
    )


def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all sessions that use each item, four places."""
    s = sessions(spark, sf_dir)
    total = s.agg(F.count_distinct("session").alias("total"))
    per = s.groupBy("item").agg(F.count_distinct("session").alias("n_sessions"))
    return per.crossJoin(F.broadcast(total)).select(
        "item", "n_sessions", F.round(F.least(F.lit(1.0), F.col("n_sessions") / F.col("total")), 4).alias("strength")
    )


def usage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item how often its session changes from one use to the next (A, B, A counts three), with first and last use."""
    s = sessions(spark, sf_dir)
    order = W.partitionBy("item").orderBy("ts", "event_id")
    new = s.withColumn("new", (~F.col("session").eqNullSafe(F.lag("session").over(order))).cast("int"))
    return new.groupBy("item").agg(
        F.sum("new").alias("transitions"),
        F.min("ts").cast("timestamp_ntz").alias("first_ts"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
    )


def co_recall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item pairs in MIN_SESSIONS sessions or more, with what independence would give, and the lift.

    Items in fewer sessions can't be in such a pair and go before the join.
    """
    member = sessions(spark, sf_dir).select("session", "item").distinct()
    freq = member.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SESSIONS)
    universe = member.agg(F.count_distinct("session").alias("universe"))
    kept = member.join(freq, "item")
    a = kept.select("session", F.col("item").alias("a"), F.col("n").alias("n_a"))
    b = kept.select("session", F.col("item").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "session").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("sessions"))
    expected = F.col("n_a") * F.col("n_b") / F.col("universe")
    return (
        pairs.where(F.col("sessions") >= MIN_SESSIONS)
        .crossJoin(F.broadcast(universe))
        .select("a", "b", "sessions", F.round(expected, 2).alias("expected"), F.round(F.col("sessions") / expected, 2).alias("lift"))
        .orderBy(F.desc("sessions"), "a", "b")
        .limit(MOST_PAIRS)
    )


def values_at(rows: DataFrame, group: str, value: str, places: dict) -> DataFrame:
    """Per group the number of rows and the values at given places (from 0) of their order.

    `places` maps names to functions of the number of rows. Equal values are
    counted first, so what is ordered are the different values alone.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    placed = counts.select(
        group, value, F.sum("c").over(W.partitionBy(group).orderBy(value)).alias("upto"), F.sum("c").over(W.partitionBy(group)).alias("n")
    )
    found = [F.min(F.when(F.col("upto") > place(F.col("n")), F.col(value))).alias(name) for name, place in places.items()]
    return placed.groupBy(group, "n").agg(*found)


def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank 95th percentile of value by type."""
    e = table(spark, sf_dir, "events")
    return values_at(e, "event_type", "value", {"p95": lambda n: F.ceil(n * 0.95) - 1}).select("event_type", "n", "p95")


def latency_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile by place in the order: place n/2 and place round(0.95 (n - 1)), from 0."""
    e = table(spark, sf_dir, "events")
    places = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.round(0.95 * (n - 1))}
    return values_at(e, "event_type", "value", places).select("event_type", "p50", "p95")


def channel_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, users and share by channel; a missing channel is the hook."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.coalesce("event_type", F.lit("hook")).alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )
    total = e.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select("channel", "n", "users", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def injection_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: users who saw it, and those who clicked it at or after first seeing it."""
    s = sessions(spark, sf_dir)
    seen = s.where("event_type = 'view'").groupBy("user_id", "item").agg(F.min("ts").alias("first_ts"))
    touch = s.where("event_type = 'click'").select("user_id", "item", F.col("ts").alias("touch_ts"))
    last = touch.groupBy("user_id", "item").agg(F.max("touch_ts").alias("touch_ts"))
    j = seen.join(last, ["user_id", "item"], "left")
    return j.groupBy("item").agg(
        F.count(F.lit(1)).alias("injected"), F.count_if(F.col("touch_ts") >= F.col("first_ts")).alias("hits")
    )


def injection_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over injections for each user; null where nothing was injected."""
    s = sessions(spark, sf_dir)
    users = s.select("user_id").distinct()
    seen = s.where("event_type = 'view'").groupBy("user_id", "item").agg(F.min("ts").alias("first_ts"))
    last = s.where("event_type = 'click'").groupBy("user_id", "item").agg(F.max("ts").alias("touch_ts"))
    j = seen.join(last, ["user_id", "item"], "left")
    p = j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("touch_ts") >= F.col("first_ts")).alias("hits")
    )
    return users.join(p, "user_id", "left").select("user_id", F.round(F.try_divide("hits", "n"), 6).alias("precision"))


def drop_autopsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reason the rows, and the upper-middle of their margins."""
    found = values_at(table(spark, sf_dir, "events"), "event_type", "value", {"median_margin": lambda n: F.floor(n / 2)})
    return found.select(F.col("event_type").alias("reason"), "n", "median_margin")


def reason_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each user and reason."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.withColumn("n", F.row_number().over(order)).where("n <= 3").select("event_id", "user_id", "event_type", "n")


def last_write_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the last known value of every field, field by field."""
    s = sessions(spark, sf_dir)
    at = F.struct("ts", "event_id")
    last = lambda when, c: F.max_by(c, F.when(when, at))
    return s.groupBy("user_id").agg(
        last(F.col("event_type").isNotNull(), "event_type").alias("event_type"),
        last(F.col("event_type") == "purchase", "value").alias("last_purchase"),
        last(F.col("event_type") == "error", "item").alias("last_error_item"),
        F.count(F.lit(1)).alias("n"),
    )


def sessions_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: sessions begun after the last error; a snooze of five has lapsed from five on."""
    s = sessions(spark, sf_dir)
    acked = s.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("acked"))
    starts = s.groupBy("user_id", "session").agg(F.min("ts").alias("start"))
    j = starts.join(acked, "user_id")
    n = F.count_if(F.col("start") > F.col("acked"))
    return j.groupBy("user_id").agg(n.alias("n_since"), (n >= 5).alias("lapsed"))


def last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last ten sessions by first appearance."""
    s = sessions(spark, sf_dir).groupBy("user_id", "session").agg(F.min("event_id").alias("first_id"))
    order = W.partitionBy("user_id").orderBy(F.desc("first_id"))
    return s.withColumn("n", F.row_number().over(order)).where("n <= 10").select("user_id", "session", "n")


def ledger_rotation(spark: SparkSession, sf_dir: str, cap: int = 400) -> DataFrame:
    """Newest rows of each user whose lines together take no more than half the cap."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0)
    size = F.sum(F.length("props") + F.length("event_type")).over(order)
    return e.withColumn("size", size).where(F.col("size") <= cap // 2).select("event_id", "user_id", "size")


def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation its turns, roles in order of first use, and the first user text cut to 80 characters."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    roles = first.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"]), ",").alias("roles")
    )
    g = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), 1, 80).alias("preview"),
    )
    return g.join(roles, "conv_id")


def query_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of under four words with the last three user turns of the conversation before them."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    order = W.partitionBy("conv_id").orderBy("turn")
    before = F.array_join(F.collect_list("text").over(order.rowsBetween(-3, -1)), " ")
    short = F.size(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))) < 4
    query = F.when(short, F.trim(F.concat_ws(" ", before, "text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(query).alias("query_md5"))


def session_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean turns of a conversation times mean characters over four."""
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )
    return per.agg(
        F.round(F.avg("n"), 6).alias("turns"), F.round(F.avg("n") * (F.sum("chars") / F.sum("n")) / 4, 4).alias("tokens")
    )


def graduation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases over purchases and errors, by day."""
    e = table(spark, sf_dir, "events")
    up, down = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        up.alias("graduated"), down.alias("demoted"), F.round(F.try_divide(up, up + down), 6).alias("rate")
    )


def draft_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three decided rows or more of which under a third went well."""
    e = table(spark, sf_dir, "events")
    good, bad = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    g = e.groupBy("user_id").agg(good.alias("good"), (good + bad).alias("decided"))
    return g.select("user_id", "good", "decided", ((F.col("decided") >= 3) & (F.col("good") * 3 < F.col("decided"))).alias("alarm"))


def soak_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the greater of distinct sessions and session changes; ready from five on."""
    s = sessions(spark, sf_dir)
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = s.withColumn("new", (~F.col("session").eqNullSafe(F.lag("session").over(order))).cast("int"))
    g = new.groupBy("user_id").agg(F.count_distinct("session").alias("n"), F.sum("new").alias("changes"))
    return g.select("user_id", F.greatest("n", "changes").alias("soak"), (F.greatest("n", "changes") >= 5).alias("ready"))


def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item hits by type, and whether it was never bought."""
    s = sessions(spark, sf_dir)
    return s.groupBy("item").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        (F.count_if(F.col("event_type") == "purchase") == 0).alias("never_bought"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        strength, usage_transitions, co_recall_pairs, latency_p95, latency_by_index, channel_volumes, injection_hits,
        injection_precision, drop_autopsy, reason_quota, last_write_merge, sessions_since, last_sessions, ledger_rotation,
        session_digest, query_rescue, session_token_cost, graduation_rate, draft_alarm, soak_status, curation_report,
    )
}

_S = """s AS (SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session, regexp_extract(props, '"k": *([0-9]+)', 1) AS item FROM events)"""
_PLACED = """p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place,
    count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"""
_FUNNEL = f"""{_S},
    seen AS (SELECT user_id, item, min(ts) AS first_ts FROM s WHERE event_type = 'view' GROUP BY 1, 2),
    j AS (SELECT seen.user_id, seen.item, coalesce(bool_or(t.ts >= first_ts), false) AS hit FROM seen
      LEFT JOIN s t ON t.user_id = seen.user_id AND t.item = seen.item AND t.event_type = 'click' GROUP BY 1, 2)"""

ORACLES = {
    "strength": f"""WITH {_S} SELECT item, count(DISTINCT session) AS n_sessions,
        round(least(1.0, count(DISTINCT session) / (SELECT count(DISTINCT session) FROM s)), 4) AS strength FROM s GROUP BY 1""",
    "usage_transitions": f"""WITH {_S}, l AS (SELECT *, lag(session) OVER (PARTITION BY item ORDER BY ts, event_id) AS b FROM s)
        SELECT item, count(*) FILTER (b IS DISTINCT FROM session) AS transitions, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY 1""",
    "co_recall_pairs": f"""WITH {_S}, m AS (SELECT DISTINCT session, item FROM s), f AS (SELECT item, count(*) AS n FROM m GROUP BY 1),
        p AS (SELECT a.item AS a, b.item AS b, count(*) AS sessions FROM m a JOIN m b ON a.session = b.session AND a.item < b.item GROUP BY 1, 2),
        x AS (SELECT a, b, sessions, fa.n * fb.n / (SELECT count(DISTINCT session) FROM m) AS e FROM p JOIN f fa ON fa.item = a JOIN f fb ON fb.item = b)
        SELECT a, b, sessions, round(e, 2) AS expected, round(sessions / e, 2) AS lift FROM x WHERE sessions >= 3
        ORDER BY sessions DESC, a, b LIMIT 20""",
    "latency_p95": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "latency_by_index": f"""WITH {_PLACED} SELECT event_type, max(value) FILTER (place = n // 2) AS p50,
        max(value) FILTER (place = round(0.95 * (n - 1))) AS p95 FROM p GROUP BY 1""",
    "channel_volumes": """SELECT coalesce(event_type, 'hook') AS channel, count(*) AS n, count(DISTINCT user_id) AS users,
        round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""",
    "injection_hits": f"WITH {_FUNNEL} SELECT item, count(*) AS injected, count(*) FILTER (hit) AS hits FROM j GROUP BY 1",
    "injection_precision": f"""WITH {_FUNNEL}, g AS (SELECT user_id, count(*) FILTER (hit) / count(*) AS p FROM j GROUP BY 1)
        SELECT user_id, round(p, 6) AS precision FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN g USING (user_id)""",
    "drop_autopsy": f"WITH {_PLACED} SELECT event_type AS reason, n, value AS median_margin FROM p WHERE place = n // 2",
    "reason_quota": """SELECT event_id, user_id, event_type, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3""",
    "last_write_merge": f"""WITH {_S}, o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM s)
        SELECT user_id, arg_max(event_type, seq) AS event_type, arg_max(value, seq) FILTER (event_type = 'purchase') AS last_purchase,
        arg_max(item, seq) FILTER (event_type = 'error') AS last_error_item, count(*) AS n FROM o GROUP BY 1""",
    "sessions_since": f"""WITH {_S}, a AS (SELECT user_id, max(ts) AS acked FROM s WHERE event_type = 'error' GROUP BY 1),
        b AS (SELECT user_id, session, min(ts) AS start FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) FILTER (start > acked) AS n_since, count(*) FILTER (start > acked) >= 5 AS lapsed FROM b JOIN a USING (user_id) GROUP BY 1""",
    "last_sessions": f"""WITH {_S}, f AS (SELECT user_id, session, min(event_id) AS i FROM s GROUP BY 1, 2)
        SELECT user_id, session, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS n FROM f) WHERE n <= 10""",
    "ledger_rotation": """SELECT event_id, user_id, CAST(size AS BIGINT) AS size FROM (SELECT *, sum(length(props) + length(event_type)) OVER
        (PARTITION BY user_id ORDER BY event_id DESC) AS size FROM events) WHERE size <= 200""",
    "session_digest": """WITH r AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2)
        SELECT c.conv_id, count(*) AS n_turns, left(arg_min(text, turn) FILTER (role = 'user'), 80) AS preview, any_value(roles) AS roles
        FROM conversations c JOIN (SELECT conv_id, string_agg(role, ',' ORDER BY first_turn, role) AS roles FROM r GROUP BY 1) USING (conv_id) GROUP BY 1""",
    "query_rescue": r"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'),
        b AS (SELECT a.conv_id, a.turn, string_agg(p.text, ' ' ORDER BY p.turn) AS before FROM u a JOIN u p ON p.conv_id = a.conv_id AND p.i BETWEEN a.i - 3 AND a.i - 1 GROUP BY 1, 2)
        SELECT conv_id, turn, md5(CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) < 4 THEN trim(coalesce(before, '') || ' ' || text) ELSE text END) AS query_md5
        FROM u LEFT JOIN b USING (conv_id, turn)""",
    "session_token_cost": """WITH p AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1)
        SELECT round(avg(n), 6) AS turns, round(avg(n) * (sum(chars) / sum(n)) / 4, 4) AS tokens FROM p""",
    "graduation_rate": """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS graduated, count(*) FILTER (event_type = 'error') AS demoted,
        round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'error')) > 0 THEN count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'error')) END, 6) AS rate
        FROM events GROUP BY 1""",
    "draft_alarm": """WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type IN ('purchase', 'error')) AS decided FROM events GROUP BY 1)
        SELECT user_id, good, decided, decided >= 3 AND good * 3 < decided AS alarm FROM g""",
    "soak_status": f"""WITH {_S}, l AS (SELECT *, lag(session) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s),
        g AS (SELECT user_id, greatest(count(DISTINCT session), count(*) FILTER (b IS DISTINCT FROM session)) AS soak FROM l GROUP BY 1)
        SELECT user_id, soak, soak >= 5 AS ready FROM g""",
    "curation_report": f"""WITH {_S} SELECT item, count(*) AS hits, count(*) FILTER (event_type = 'view') AS views,
        count(*) FILTER (event_type = 'purchase') = 0 AS never_bought FROM s GROUP BY 1""",
}
