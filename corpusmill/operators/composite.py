"""Queries built from several operators: expansion, inboxes, merges, replays, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..functions.oracle import bm25_sql
from ..sources.scratch import stored
from ..sources.tables import table
from .graph import _E, components, supply_edges, undirected
from .ledger import _S, sessions
from .ranking import _UNIT, DENSE_FLOOR, nearest
from .retrieval import bm25_top, top_k
from .similarity import jaccard_pairs, set_classes


def expand_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the three dearest parts as seeds; their neighbours in the graph take half the best seed's score."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("q"), F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"))
    seeds = top_k(p, 3, "q", "node")
    e = undirected(supply_edges(spark, sf_dir))
    near = seeds.join(e, seeds["node"] == e["src"]).groupBy("q", F.col("dst").alias("node")).agg(F.max("score").alias("best"))
    fresh = near.join(seeds.select("q", "node"), ["q", "node"], "left_anti")
    return fresh.select("q", "node", F.round(F.col("best") * 0.5, 6).alias("score"))


def touch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the first eight orders that cite it, urgent ones first."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderpriority") != "1-URGENT").cast("int").alias("late"))
    order = W.partitionBy("l_partkey").orderBy("late", "o_orderkey")
    first = l.join(o, "o_orderkey").withColumn("n", F.row_number().over(order)).where("n <= 8")
    at = F.array_sort(F.collect_list(F.struct("n", "o_orderkey")))
    return first.groupBy("l_partkey").agg(F.array_join(F.transform(at, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


def contradiction_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs with an edge in one direction only: unresolved. Both directions settle a pair."""
    e = supply_edges(spark, sf_dir)
    pair = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src")
    return pair.groupBy("a", "b").agg(F.count_distinct("src").alias("sides"), F.min("src").alias("by")).where("sides = 1").select("a", "b", "by")


def three_way_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three thirds of the documents as base, ours and theirs of one name each: who changed what."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("name"), F.pmod("doc_id", F.lit(3)).alias("side"), F.md5(T.text_of("text")).alias("h"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("h")))
    j = d.groupBy("name").agg(pick(0).alias("base"), pick(1).alias("ours"), pick(2).alias("theirs"))
    ours, theirs = ~F.col("base").eqNullSafe(F.col("ours")), ~F.col("base").eqNullSafe(F.col("theirs"))
    state = (
        F.when(F.col("ours").eqNullSafe(F.col("theirs")), F.when(ours, "both alike").otherwise("unchanged"))
        .when(ours & theirs, "conflict").when(ours, "ours").otherwise("theirs")
    )
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def mutual_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors and those of their three nearest among all vectors that have them among their own three nearest.

    The neighbours found, three for each query vector, are the second query set.
    """
    v = table(spark, sf_dir, "embeddings")
    near = stored(nearest(v, v.where("vec_id % 20 = 0"), 3).select("query_id", "vec_id"))
    found = stored(v.join(near.select("vec_id").distinct(), "vec_id", "left_semi"))
    back = nearest(v, found, 3).select(F.col("vec_id").alias("query_id"), F.col("query_id").alias("vec_id"))
    both = near.join(back, ["query_id", "vec_id"])
    return both.select(F.least("query_id", "vec_id").alias("x"), F.greatest("query_id", "vec_id").alias("y")).distinct()


def cofire_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the graph's components of three or more, and whether the component is small enough (eight) to act on."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    c = components(nodes, supply_edges(spark, sf_dir))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    # A table, so that Spark can split a very large component in the join.
    return c.join(stored(sizes), "component").select("component", "node", "size", (F.col("size") <= 8).alias("small"))


def reward_propagation(spark: SparkSession, sf_dir: str, rounds: int = 3) -> DataFrame:
    """Reward of dear parts handed upstream, once for every edge on every path of up to `rounds` edges."""
    e = supply_edges(spark, sf_dir).select("src", "dst")
    front = table(spark, sf_dir, "part").where("p_size >= 45").select(F.col("p_partkey").alias("node"), F.lit(1).cast("bigint").alias("hits"))
    total = None
    for _ in range(rounds):
        front = stored(front.join(e, front["node"] == e["dst"]).groupBy(F.col("src").alias("node")).agg(F.sum("hits").alias("hits")))
        total = front if total is None else total.unionByName(front)
    return total.groupBy("node").agg(F.sum("hits").alias("reward"))


def session_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first twenty items in order of first use."""
    s = sessions(spark, sf_dir).groupBy("user_id", "item").agg(F.min("event_id").alias("at"))
    n = s.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("at"))).where("n <= 20")
    found = F.array_sort(F.collect_list(F.struct("n", "item")))
    return n.groupBy("user_id").agg(F.array_join(F.transform(found, lambda x: x["item"]), ",").alias("items"))


def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of users in two halves of the ledger, of small values and all others, merged: first and last use, the greater count; nulls skipped."""
    e = table(spark, sf_dir, "events").withColumn("small", F.coalesce(F.col("value") < 50, F.lit(False)))
    agg = lambda df, x: df.groupBy("user_id").agg(F.min("event_id").alias(f"f{x}"), F.max("event_id").alias(f"l{x}"), F.count(F.lit(1)).alias(f"n{x}"))
    a, b = agg(e.where("small"), "a"), agg(e.where("NOT small"), "b")
    return a.join(b, "user_id", "full_outer").select(
        "user_id", F.least("fa", "fb").alias("first_id"), F.greatest("la", "lb").alias("last_id"), F.greatest("na", "nb").alias("n")
    )


def abstention_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query vector without a row at the floor its best row below it, and the gap."""
    v = table(spark, sf_dir, "embeddings")
    best = nearest(v, v.where("vec_id % 20 = 0"), 1).withColumn("score", F.round("score", 9))
    return best.where(F.col("score") < DENSE_FLOOR).select("query_id", "vec_id", F.round(DENSE_FLOOR - F.col("score"), 6).alias("gap"))


def replay_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries over all documents and over those of one language: rows gained and lost by query."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = stored(bm25_top(d, q, 10, part=F.coalesce(F.col("lang") != "fr", F.lit(False))))
    a = top_k(found, 10).select("item_id", "doc_id", F.lit(1).alias("a"))
    b = found.where("part = 'true'").select("item_id", "doc_id", F.lit(1).alias("b"))
    return a.join(b, ["item_id", "doc_id"], "full_outer").groupBy("item_id").agg(
        F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("b").isNull()).alias("lost")
    )


def inventory_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "es", None).otherwise(F.col("lang"))
    return d.groupBy(F.coalesce(kind, F.lit("untyped")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def leaders(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, seed): in order of the items each joins the most similar earlier seed, else founds one; ties take the first seed.

    `pairs` has (a, b, jaccard) with a < b, of all pairs similar enough. An item is
    a seed once all its earlier neighbours are known not to be, and none as soon
    as one of them is; every round settles the first unsettled item of each
    neighbourhood.
    """
    open_ = stored(items.select("item"))
    seeds, pairs = None, stored(pairs)
    links = pairs
    while not open_.isEmpty():
        # Items without an unsettled earlier neighbour: earlier ones that aren't seeds are gone from the links.
        behind = links.select(F.col("b").alias("item")).distinct()
        fresh = stored(open_.join(behind, "item", "left_anti"))
        seeds = fresh if seeds is None else stored(seeds.unionByName(fresh))
        joined = links.join(fresh.withColumnRenamed("item", "a"), "a", "left_semi").select(F.col("b").alias("item")).distinct()
        settled = stored(fresh.unionByName(joined).distinct())
        open_ = stored(open_.join(settled, "item", "left_anti"))
        # Links from settled items no longer hold anything up, nor do links to them.
        links = stored(
            links.join(settled.withColumnRenamed("item", "a"), "a", "left_anti").join(settled.withColumnRenamed("item", "b"), "b", "left_anti")
        )
    if seeds is None:
        return items.select("item", F.col("item").alias("seed"))
    to_seeds = pairs.join(seeds.withColumnRenamed("item", "a"), "a", "left_semi").join(seeds.withColumnRenamed("item", "b"), "b", "left_anti")
    best = to_seeds.groupBy(F.col("b").alias("item")).agg(F.max_by("a", F.struct("jaccard", -F.col("a"))).alias("seed"))
    return best.unionByName(seeds.select("item", F.col("item").alias("seed")))


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages clustered in order of arrival: each joins the most similar seed (Jaccard of tokens 0.1 or more), else founds one.

    Passages with one and the same token set are one item, the first of them.
    Those without tokens are like no other.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(F.array_distinct(T.tokens(T.text_of("text")))).alias("set"))
    reps, members = set_classes(b.where("size(set) > 0"), "item_id")
    found = leaders(jaccard_pairs(reps, 0.1), reps.select(F.col("rep").alias("item")))
    rows = members.join(found, members["rep"] == found["item"]).select("item_id", "seed")
    return rows.unionByName(b.where("size(set) = 0").select("item_id", F.col("item_id").alias("seed")))


def join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each kind of join of customers and their big orders gives, by segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    count = lambda how: c.join(o, "c_custkey", how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(how))
    out = count("inner")
    for how in ("left_outer", "left_semi", "left_anti"):
        out = out.unionByName(count(how))
    return out.select("kind", "c_mktsegment", "n")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


QUERIES = {
    f.__name__: f
    for f in (
        expand_neighbours, touch_map, contradiction_inbox, three_way_state, mutual_merges, cofire_clusters, reward_propagation,
        session_decisions, usage_merge, abstention_receipt, replay_delta, inventory_by_type, leader_clusters, join_kinds, pricing_summary,
    )
}

ORACLES = {
    "expand_neighbours": f"""WITH {_E}, s AS (SELECT * FROM (SELECT p_brand AS q, p_partkey AS node, p_retailprice AS score,
        row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 9) DESC, p_partkey) AS n FROM part) WHERE n <= 3)
        SELECT q, dst AS node, round(max(score) * 0.5, 6) AS score FROM s JOIN u ON u.src = s.node
        WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.q = s.q AND t.node = u.dst) GROUP BY 1, 2""",
    "touch_map": """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), r AS (SELECT l_partkey, o_orderkey, row_number() OVER
        (PARTITION BY l_partkey ORDER BY CAST(o_orderpriority <> '1-URGENT' AS INT), o_orderkey) AS n FROM l JOIN orders ON o_orderkey = l_orderkey)
        SELECT l_partkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) AS orders FROM r WHERE n <= 8 GROUP BY 1""",
    "contradiction_inbox": f"""WITH {_E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(src) AS "by" FROM e GROUP BY 1, 2 HAVING count(DISTINCT src) = 1""",
    "three_way_state": """WITH j AS (SELECT doc_id // 3 AS name, max(md5(text)) FILTER (doc_id % 3 = 0) AS base, max(md5(text)) FILTER (doc_id % 3 = 1) AS ours,
        max(md5(text)) FILTER (doc_id % 3 = 2) AS theirs FROM documents GROUP BY 1)
        SELECT CASE WHEN ours IS NOT DISTINCT FROM theirs THEN CASE WHEN base IS DISTINCT FROM ours THEN 'both alike' ELSE 'unchanged' END
        WHEN base IS DISTINCT FROM ours AND base IS DISTINCT FROM theirs THEN 'conflict' WHEN base IS DISTINCT FROM ours THEN 'ours' ELSE 'theirs' END AS state,
        count(*) AS n FROM j GROUP BY 1""",
    "mutual_merges": f"""WITH {_UNIT}, k AS (SELECT query_id, vec_id FROM near WHERE rank <= 3), s AS (SELECT DISTINCT vec_id FROM k),
        c AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM unit a JOIN s ON a.vec_id = s.vec_id JOIN unit b ON a.vec_id <> b.vec_id),
        r AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM c) WHERE r <= 3)
        SELECT DISTINCT least(k.query_id, k.vec_id) AS x, greatest(k.query_id, k.vec_id) AS y FROM k JOIN r ON k.query_id = r.vec_id AND k.vec_id = r.query_id""",
    "cofire_clusters": f"""WITH RECURSIVE {_E}, c AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT u.dst, c.root FROM c JOIN u ON u.src = c.node),
        m AS (SELECT node, min(root) AS component FROM c GROUP BY 1)
        SELECT component, node, count(*) OVER (PARTITION BY component) AS size, size <= 8 AS small FROM m QUALIFY size >= 3""",
    "reward_propagation": f"""WITH RECURSIVE {_E}, r AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size >= 45
        UNION ALL SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 3)
        SELECT node, count(*) AS reward FROM r WHERE depth > 0 GROUP BY 1""",
    "session_decisions": f"""WITH {_S}, f AS (SELECT user_id, item, min(event_id) AS i FROM s GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM f)
        SELECT user_id, string_agg(item, ',' ORDER BY n) AS items FROM r WHERE n <= 20 GROUP BY 1""",
    "usage_merge": """WITH a AS (SELECT user_id, min(event_id) AS f, max(event_id) AS l, count(*) AS n FROM events WHERE value < 50 GROUP BY 1),
        b AS (SELECT user_id, min(event_id) AS f, max(event_id) AS l, count(*) AS n FROM events WHERE coalesce(value >= 50, true) GROUP BY 1)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, least(a.f, b.f) AS first_id, greatest(a.l, b.l) AS last_id, greatest(a.n, b.n) AS n FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "abstention_receipt": f"""WITH {_UNIT}, m AS (SELECT query_id, arg_max(vec_id, {{'s': round(score, 9), 'v': -vec_id}}) AS vec_id, max(round(score, 9)) AS s FROM cosines GROUP BY 1)
        SELECT query_id, vec_id, round(0.5::DOUBLE - s, 6) AS gap FROM m WHERE s < 0.5""",
    "replay_delta": f"""WITH {bm25_sql()},
        a AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored) WHERE r <= 10),
        b AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored
          WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')) WHERE r <= 10)
        SELECT coalesce(a.item_id, b.item_id) AS item_id, count(*) FILTER (a.item_id IS NULL) AS gained, count(*) FILTER (b.item_id IS NULL) AS lost
        FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id GROUP BY 1""",
    "inventory_by_type": "SELECT coalesce(nullif(lang, 'es'), 'untyped') AS type, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "join_kinds": """WITH o AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000)
        SELECT 'inner' AS kind, c_mktsegment, count(*) AS n FROM customer JOIN o ON o_custkey = c_custkey GROUP BY 2 UNION ALL
        SELECT 'left_outer', c_mktsegment, count(*) FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 2 UNION ALL
        SELECT 'left_semi', c_mktsegment, count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o) GROUP BY 2 UNION ALL
        SELECT 'left_anti', c_mktsegment, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o) GROUP BY 2""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2""",
}
