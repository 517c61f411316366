"""Link graph queries over (src, dst) edges: resolution, degrees, traversal, components, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..sources.scratch import stored
from ..sources.tables import table

#: Orders in which two parts must follow each other to be linked.
TOGETHER = 2
#: Pairs that a task makes at most, about, and members of a group that it holds at once.
PAIRS_AT_ONCE, MEMBERS_AT_ONCE = 4_000_000, 2_000


def resolve_aliases(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets joined with what their alias names: (…, node or null, n_claimants).

    `claims` has (alias, node, tier); tier 0 beats tier 1, and an alias that
    several nodes claim in its best tier names nothing.
    """
    best = claims.groupBy("alias").agg(F.min("tier").alias("tier"))
    held = claims.join(best, ["alias", "tier"]).groupBy("alias").agg(
        F.count_distinct("node").alias("n_claimants"), F.min("node").alias("node")
    )
    named = held.select("alias", "n_claimants", F.when(F.col("n_claimants") == 1, F.col("node")).alias("node"))
    return targets.join(named, "alias", "left").withColumn("n_claimants", F.coalesce("n_claimants", F.lit(0)))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without loops."""
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, total): distinct neighbours; total is undirected, so not the sum."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"))
    both = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("total"))
    found = nodes
    for part in (out, into, both):
        found = found.join(part, "node", "left")
    return found.na.fill(0, ["out_degree", "in_degree", "total"])


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, depth): nodes within `hops` outgoing edges of each seed, without the seed, at their least depth."""
    e = edges.select("src", "dst").distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(e, front["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weak component. Rounds end when no label changes."""
    both = stored(undirected(edges))
    labels = stored(nodes.select("node", F.col("node").alias("component")))
    while True:
        offers = both.join(labels.toDF("src", "offer"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("offer").alias("offer"))
        taken = labels.join(offers, "node", "left").select("node", "component", F.least("component", "offer").alias("taken"))
        taken = stored(taken)
        if taken.where("taken < component").isEmpty():
            return labels
        via = taken.select("node", F.col("taken").alias("via"))
        hop = taken.select(F.col("node").alias("via"), F.col("taken").alias("next"))
        labels = stored(via.join(hop, "via", "left").select("node", F.coalesce("next", "via").alias("component")))


# --- queries ----------------------------------------------------------------------------------------------------------


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between parts that follow each other, in line order, in TOGETHER orders or more."""
    l = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = l.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    pairs = pairs.where("dst IS NOT NULL AND src <> dst").distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs.where(F.col("n") >= TOGETHER).select("src", "dst")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(_parts(spark, sf_dir), supply_edges(spark, sf_dir))


def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without outgoing edges, and whether they have incoming ones."""
    e = supply_edges(spark, sf_dir)
    out = e.select(F.col("src").alias("node")).distinct()
    into = e.select(F.col("dst").alias("node"), F.lit(True).alias("linked")).distinct()
    lone = _parts(spark, sf_dir).join(out, "node", "left_anti").join(into, "node", "left")
    return lone.select("node", F.col("linked").isNull().alias("isolate"))


def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's reach of up to three edges, with the least number of them."""
    return reach(supply_edges(spark, sf_dir), _parts(spark, sf_dir), 3)


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_parts(spark, sf_dir), supply_edges(spark, sf_dir))


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by size, then least member, with their place in that order among those of one size."""
    c = components(_parts(spark, sf_dir), supply_edges(spark, sf_dir))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected distance up to 4 between all nodes."""
    return reach(undirected(supply_edges(spark, sf_dir)), _parts(spark, sf_dir), 4)


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as hard aliases, their last words as soft ones; brands' texts looked up among them."""
    p = table(spark, sf_dir, "part")
    hard = p.select(T.slug(F.col("p_name")).alias("alias"), F.col("p_partkey").alias("node"), F.lit(0).alias("tier"))
    soft = p.select(
        T.slug(F.element_at(F.split("p_name", " "), -1)).alias("alias"), F.col("p_partkey").alias("node"), F.lit(1).alias("tier")
    )
    claims = hard.unionByName(soft).where("alias <> ''")
    targets = claims.select("alias").distinct()
    found = resolve_aliases(claims, targets)
    return found.select("alias", "node", "n_claimants")


def href_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page and those that no page's address answers."""
    p = table(spark, sf_dir, "pages")
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all(T.text_of("html"), F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = p.select(F.col("url").alias("href"), F.lit(1).alias("known")).distinct()
    j = hrefs.join(known, "href", "left")
    return j.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("known").isNull()).alias("n_dangling"), F.count_distinct("href").alias("n_targets")
    )


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of a document supersede earlier ones: an edge from each to the next."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.text_of("text")).alias("h"))
    order = W.partitionBy("h").orderBy("doc_id")
    return d.select(F.lead("doc_id").over(order).alias("src"), F.lit("supersedes").alias("rel"), F.col("doc_id").alias("dst")).where("src IS NOT NULL")


def chain_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every superseded document the live end of its chain."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.text_of("text")).alias("h"))
    tip = d.groupBy("h").agg(F.max("doc_id").alias("tip"))
    return d.join(tip, "h").where("doc_id < tip").select("doc_id", "tip")


def edge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's targets as one string in order."""
    e = supply_edges(spark, sf_dir)
    return e.groupBy("src").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("targets")
    )


def shared_pairs(links: DataFrame, group: str, node: str) -> DataFrame:
    """(a, b, shared): pairs of nodes a < b and the number of groups that hold both; repeated links count once.

    Tasks are as many as the pairs ask for, so that what one of them holds
    doesn't grow with the input; a large group is dealt out in blocks of members.
    """
    spark = links.sparkSession
    own = stored(links.select(F.col(group).alias("g"), F.col(node).alias("node")).where("g IS NOT NULL AND node IS NOT NULL").distinct())
    n = F.col("n")
    size = own.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n.cast("double") * (n - 1) / 2).alias("pairs"), F.max(n).alias("largest")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size["pairs"] or 0) // PAIRS_AT_ONCE))
    blocks = -(-(size["largest"] or 1) // MEMBERS_AT_ONCE)
    a = own.select("g", F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    b = own.select("g", F.col("node").alias("b"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    met = a.repartition(tasks, "g", "block").join(b.repartition(tasks, "g", "block"), ["g", "block"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier pairs' strength at each threshold from .30 to .95: shared parts over the smaller side's."""
    l = stored(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct())
    n = stored(l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")))
    pairs = shared_pairs(l, "l_partkey", "l_suppkey").join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    strength = pairs.select((F.col("shared") / F.least("na", "nb")).alias("s"))
    steps = spark.range(6, 20).select((F.col("id") * 5).alias("theta"))
    return strength.crossJoin(F.broadcast(steps)).groupBy("theta").agg(F.count_if(F.col("s") * 100 >= F.col("theta")).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_degrees, graph_orphans, graph_traverse, graph_components, component_sizes, graph_distance, alias_resolution,
        href_lint, typed_edges, chain_tips, edge_export, threshold_sweep,
    )
}

_E = f"""e AS (SELECT src, dst FROM (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
    FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= {TOGETHER}),
    u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""
_COMP = f"""{_E},
    c AS (SELECT p_partkey AS node, p_partkey AS root FROM part UNION SELECT u.dst, c.root FROM c JOIN u ON u.src = c.node),
    comp AS (SELECT node, min(root) AS component FROM c GROUP BY 1)"""


def _slug(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '\\.md$', ''), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"


ORACLES = {
    "graph_degrees": f"""WITH {_E} SELECT p_partkey AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(b.n, 0) AS total
        FROM part LEFT JOIN (SELECT src AS k, count(*) AS n FROM e GROUP BY 1) o ON o.k = p_partkey
        LEFT JOIN (SELECT dst AS k, count(*) AS n FROM e GROUP BY 1) i ON i.k = p_partkey
        LEFT JOIN (SELECT src AS k, count(*) AS n FROM u GROUP BY 1) b ON b.k = p_partkey""",
    "graph_orphans": f"""WITH {_E} SELECT p_partkey AS node, p_partkey NOT IN (SELECT dst FROM e) AS isolate FROM part
        WHERE p_partkey NOT IN (SELECT src FROM e)""",
    "graph_traverse": f"""WITH RECURSIVE {_E}, r AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS depth FROM part
        UNION SELECT seed, e.dst, depth + 1 FROM r JOIN e ON e.src = node WHERE depth < 3)
        SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node <> seed GROUP BY 1, 2""",
    "graph_components": f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp",
    "component_sizes": f"WITH RECURSIVE {_COMP} SELECT component, count(*) AS size FROM comp GROUP BY 1",
    "graph_distance": f"""WITH RECURSIVE {_E}, r AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS depth FROM part
        UNION SELECT seed, u.dst, depth + 1 FROM r JOIN u ON u.src = node WHERE depth < 4)
        SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node <> seed GROUP BY 1, 2""",
    "alias_resolution": f"""WITH c AS (SELECT {_slug('p_name')} AS alias, p_partkey AS node, 0 AS tier FROM part UNION ALL
        SELECT {_slug("split_part(p_name, ' ', -1)")}, p_partkey, 1 FROM part),
        b AS (SELECT *, min(tier) OVER (PARTITION BY alias) AS best FROM c WHERE alias <> '')
        SELECT alias, CASE WHEN count(DISTINCT node) = 1 THEN min(node) END AS node, count(DISTINCT node) AS n_claimants FROM b WHERE tier = best GROUP BY 1""",
    "href_lint": """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
        SELECT page_id, count(*) AS n_links, count(*) FILTER (href NOT IN (SELECT url FROM pages)) AS n_dangling, count(DISTINCT href) AS n_targets
        FROM h GROUP BY 1""",
    "typed_edges": """SELECT src, 'supersedes' AS rel, dst FROM (SELECT lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS src, doc_id AS dst FROM documents)
        WHERE src IS NOT NULL""",
    "chain_tips": """SELECT doc_id, tip FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS tip FROM documents) WHERE doc_id < tip""",
    "edge_export": f"WITH {_E} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS targets FROM e GROUP BY 1",
    "threshold_sweep": """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM l GROUP BY 1),
        p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2),
        s AS (SELECT shared / least(x.n, y.n) AS s FROM p JOIN n x ON x.l_suppkey = a JOIN n y ON y.l_suppkey = b)
        SELECT theta * 5 AS theta, count(*) FILTER (s * 100 >= theta * 5) AS n FROM s, range(6, 20) AS t(theta) GROUP BY 1""",
}
