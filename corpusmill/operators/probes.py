"""Probes of retrieval: body ranking, self recall, sweeps of thresholds, and what rankings say about links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..functions.oracle import bm25_sql, terms_sql
from ..sources.scratch import stored
from ..sources.tables import table
from .graph import _E, shared_pairs, supply_edges, undirected
from .ranking import _UNIT, best_by_label, nearest
from .retrieval import bm25_top, idf, postings, term_rows, top_k

#: Chunks of a document at most; tokens of a probe; ranks looked at.
CHUNKS, PROBE_TOKENS, K = 3, 12, 10
#: Shares of the score before, in hundredths, and cosines, in hundredths, that the sweeps try.
KNEES, FLOORS = (50, 60, 70, 80, 90), (20, 30, 40, 50, 60, 70, 80)


# --- operators --------------------------------------------------------------------------------------------------------


def body_chunks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, parent, text) of the chunks of each document's body; the key is the parent's with the place."""
    cut = docs.select(F.col("doc_id").alias("parent"), F.posexplode(T.chunks(T.text_of("text"), least=80)).alias("place", "text"))
    return cut.select((F.col("parent") * CHUNKS + F.col("place")).alias("doc_id"), "parent", "text")


def best_parents(scored: DataFrame, k: int, query: str = "item_id") -> DataFrame:
    """(query, parent, chunk, rank): parents by their best chunk; ranks are places among parents."""
    placed = scored.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "doc_id")))
    best = placed.groupBy(query, F.floor(F.col("doc_id") / CHUNKS).alias("parent")).agg(F.min("place").alias("place"), F.min_by("doc_id", "place").alias("chunk"))
    rank = F.row_number().over(W.partitionBy(query).orderBy("place"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(query, "parent", (F.col("chunk") % CHUNKS).alias("chunk"), "rank")


def swept(rows: DataFrame, name: str, values: tuple[int, ...]) -> DataFrame:
    """Every row with every value of a parameter, a short list."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


# --- queries ----------------------------------------------------------------------------------------------------------


def bm25_body_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best chunk for each passage."""
    chunks = stored(body_chunks_of(table(spark, sf_dir, "documents")))
    return best_parents(bm25_top(chunks, table(spark, sf_dir, "benchmark"), K * CHUNKS), K)


def bm25_joint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of documents and their chunks as one population: in how many rows, and the idf there."""
    d = table(spark, sf_dir, "documents")
    chunks = body_chunks_of(d).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    both = d.select("doc_id", "text").unionByName(chunks)
    found = idf(stored(postings(both)), both.agg(F.count(F.lit(1)).alias("n")))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


def probes(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    """Queries from the stated query set of documents, those whose id 20 divides."""
    d = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    return d.select(F.col("doc_id").alias("item_id"), F.array_join(F.slice(of(T.tokens(T.text_of("text"))), 1, PROBE_TOKENS), " ").alias("text"))


def _own_rank(spark: SparkSession, sf_dir: str, queries: DataFrame, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    run = bm25_top(ready or table(spark, sf_dir, "documents"), queries, K)
    own = run.where("item_id = doc_id").select("item_id", "rank")
    rr = F.coalesce(1 / F.col("rank"), F.lit(0.0))
    return queries.select("item_id").join(own, "item_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("recall"), F.round(F.avg(rr), 6).alias("mrr")
    )


def self_recall(spark: SparkSession, sf_dir: str, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Documents that their own first tokens find in the top ten; `ready` are the documents' `term_rows`."""
    return _own_rank(spark, sf_dir, stored(probes(spark, sf_dir, lambda ts: ts)), ready)


def body_probe(spark: SparkSession, sf_dir: str, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Documents that tokens of their body find, those that aren't among the first twelve, each once."""
    return _own_rank(spark, sf_dir, stored(probes(spark, sf_dir, lambda ts: F.array_except(ts, F.slice(ts, 1, PROBE_TOKENS)))), ready)


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k)


def knee_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay of the top twenty for each knee: all before the first fall below its share of the score before."""
    order = W.partitionBy("item_id").orderBy("rank")
    top = stored(_ranked(spark, sf_dir, 20).select("item_id", "rank", F.round("score", 6).alias("score")))
    steps = swept(top.withColumn("before", F.lag("score").over(order)), "knee", KNEES)
    fell = F.max((F.col("score") * 100 < F.col("knee") * F.col("before")).cast("int")).over(W.partitionBy("item_id", "knee").orderBy("rank"))
    kept = steps.withColumn("fell", fell).where(F.coalesce("fell", F.lit(0)) == 0)
    return kept.groupBy("knee").agg(F.count(F.lit(1)).alias("kept"), F.max("rank").alias("deepest"))


def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each floor the query vectors whose best row of their own label reaches it, and those without any of another label."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0")
    best = best_by_label(v, q)
    return swept(stored(best), "floor", FLOORS).groupBy("floor").agg(
        F.count_if(F.col("on_topic") * 100 >= F.col("floor")).alias("recalled"), F.count_if(~F.coalesce(F.col("off_topic") * 100 >= F.col("floor"), F.lit(False))).alias("abstained")
    )


def absence_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose top ten has no retired document (of the later sources), of all."""
    d = table(spark, sf_dir, "documents").where("source > 'src16'").select("doc_id")
    run = _ranked(spark, sf_dir, K).select("item_id", "doc_id")
    bad = run.join(d, "doc_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_retired"))
    j = table(spark, sf_dir, "benchmark").select("item_id").join(bad, "item_id", "left")
    return j.select("item_id", F.coalesce("n_retired", F.lit(0)).alias("n_retired"), F.col("n_retired").isNull().alias("passed"))


def archive_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per passage the best of the archived documents (of the later sources) that share two or more of its terms."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    archived = d.where("source > 'src16'").select("doc_id")
    return bm25_top(d, q, 1, among=archived, shared=2).select("item_id", "doc_id", "terms", F.round("score", 6).alias("score"))


def draft_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose hits in the top three all are drafts (not labelled good): nothing is returned for them."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    run = _ranked(spark, sf_dir, 3).select("item_id", "doc_id").join(good, "doc_id", "left")
    return run.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), (F.count("good") == 0).alias("suppressed"))


def merged_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows of each language for each passage as one list; labels tell rows of one language apart."""
    d = table(spark, sf_dir, "documents")
    best = bm25_top(d, table(spark, sf_dir, "benchmark"), 5, part=F.col("lang")).withColumnsRenamed({"rank": "n", "part": "lang"})
    label = F.when(F.col("n") == 1, F.col("lang")).otherwise(F.concat_ws("~", "lang", F.col("n").cast("string")))
    return best.select("item_id", "doc_id", label.alias("label"), F.round("score", 6).alias("score"))


def link_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of each query vector without those of its own label, which are linked already."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0")
    near = nearest(v, q, 3).select("query_id", "vec_id", "rank")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    j = near.join(v.select("vec_id", "label"), "vec_id").join(own, "query_id")
    return j.where("label <> own").select("query_id", "vec_id", "rank")


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by their distance from its three dearest: 0, 1, 2, or further (null)."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("q"), F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"))
    seeds = stored(top_k(p, 3, "q", "node").select("q", "node", F.lit(0).alias("depth")))
    e = stored(undirected(supply_edges(spark, sf_dir)))
    step = lambda front, n: front.join(e, front["node"] == e["src"]).select("q", F.col("dst").alias("node"), F.lit(n).alias("depth")).distinct()
    one = stored(step(seeds, 1))
    least = seeds.union(one).union(step(one, 2)).groupBy("q", "node").agg(F.min("depth").alias("depth"))
    return p.select("q", "node").join(least, ["q", "node"], "left").groupBy("q", "depth").agg(F.count(F.lit(1)).alias("n"))


def contradiction_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six supplier pairs that share many parts, without those of one nation, which are settled."""
    pairs = shared_pairs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").where("na <> nb")
    return j.orderBy(F.desc("shared"), "a", "b").limit(6).select("a", "b", "shared")


def flag_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten off, with a tenth more for English documents, and off again: rows that differ from the first arm."""
    d, q = term_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), table(spark, sf_dir, "benchmark")
    raised = F.when(F.col("lang") == "en", 1.1).otherwise(1.0)
    arm = lambda on: stored(bm25_top(d, q, K, factor=raised if on else None).select("item_id", "doc_id", "rank"))

    off, on, again = arm(False), arm(True), arm(False)
    count = lambda other, name: off.exceptAll(other).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("arms"), "n")
    return count(on, "off_on").unionByName(count(again, "off_off"))


def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self recall and body probe against their gates; a gate without queries is skipped (null), not failed."""
    ready = term_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = self_recall(spark, sf_dir, ready).withColumn("gate", F.lit("self_recall")).unionByName(body_probe(spark, sf_dir, ready).withColumn("gate", F.lit("body_probe")))
    least = F.when(F.col("gate") == "self_recall", 0.90).otherwise(0.80)
    return rows.select("gate", "recall", F.when(F.col("n") > 0, F.col("recall") >= least).alias("passed"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_body_topk, bm25_joint_stats, self_recall, body_probe, knee_sweep, floor_sweep, absence_polarity, archive_regret, draft_suppression,
        merged_tiers, link_suggestions, reachability, contradiction_pool, flag_arms, eval_gates,
    )
}

_CHUNKED = r"""p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(left(text, 1500), '\n\s*\n'), lambda x: trim(x)), lambda x: length(x) >= 80)[1:3] AS cs FROM documents),
    chunked AS (SELECT doc_id * 3 + place - 1 AS doc_id, text FROM (SELECT doc_id, unnest(cs) AS text, generate_subscripts(cs, 1) AS place FROM p))"""
_RANKED = f"""{bm25_sql()},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""
_TOKENS_OF = f"""t AS (SELECT doc_id, pos, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ({terms_sql('doc_id', 'documents').replace('AS term', 'AS term, token')}) WHERE doc_id % 20 = 0)"""


def own_sql(queries: str) -> str:
    return f"""WITH {_TOKENS_OF}, asked AS ({queries}), probes AS (SELECT d.doc_id AS item_id, coalesce(text, '') AS text FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0) d LEFT JOIN asked USING (doc_id)),
        {bm25_sql().replace('benchmark', 'probes')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored),
        own AS (SELECT item_id, rank FROM ranked WHERE item_id = doc_id AND rank <= 10)
        SELECT count(*) AS n, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM probes LEFT JOIN own USING (item_id)"""


ORACLES = {
    "bm25_body_topk": f"""WITH {_CHUNKED}, {bm25_sql().replace('documents', 'chunked')},
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM scored),
        best AS (SELECT item_id, doc_id // 3 AS parent, min(place) AS place, arg_min(doc_id, place) AS c FROM placed GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY place) AS INTEGER) AS rank FROM best) SELECT item_id, parent, c % 3 AS chunk, rank FROM r WHERE rank <= 10""",
    "bm25_joint_stats": f"""WITH {_CHUNKED}, joint AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM chunked),
        t AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM ({terms_sql('doc_id', 'joint')})), df AS MATERIALIZED (SELECT term, count(*) AS df FROM t GROUP BY 1),
        raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, (SELECT count(*) AS n FROM joint)), mean AS (SELECT avg(idf) AS m FROM raw)
        SELECT term, df, round(CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END, 6) AS idf FROM raw, mean""",
    "self_recall": own_sql("SELECT doc_id, string_agg(token, ' ' ORDER BY n) AS text FROM t WHERE n <= 12 GROUP BY 1"),
    "body_probe": own_sql("""SELECT doc_id, string_agg(token, ' ' ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS m FROM
        (SELECT doc_id, token, min(n) AS n FROM t WHERE (doc_id, token) NOT IN (SELECT (doc_id, token) FROM t WHERE n <= 12) GROUP BY 1, 2)) WHERE m <= 12 GROUP BY 1"""),
    "knee_sweep": f"""WITH {_RANKED}, k AS (SELECT item_id, rank, round(score, 6) AS score, lag(round(score, 6)) OVER (PARTITION BY item_id ORDER BY rank) AS before FROM ranked WHERE rank <= 20),
        s AS (SELECT k.*, knee, max(CAST(score * 100 < knee * before AS INT)) OVER (PARTITION BY item_id, knee ORDER BY rank) AS fell FROM k, (SELECT unnest([50, 60, 70, 80, 90]) AS knee))
        SELECT knee, count(*) AS kept, CAST(max(rank) AS INTEGER) AS deepest FROM s WHERE coalesce(fell, 0) = 0 GROUP BY 1""",
    "floor_sweep": f"""WITH {_UNIT}, b AS (SELECT query_id, max(round(score, 9)) FILTER (label = query_label) AS a, max(round(score, 9)) FILTER (label <> query_label) AS o FROM cosines GROUP BY 1)
        SELECT floor, count(*) FILTER (a * 100 >= floor) AS recalled, count(*) FILTER (NOT coalesce(o * 100 >= floor, false)) AS abstained FROM b, (SELECT unnest([20, 30, 40, 50, 60, 70, 80]) AS floor) GROUP BY 1""",
    "absence_polarity": f"""WITH {_RANKED}, x AS (SELECT item_id, count(*) AS n FROM ranked WHERE rank <= 10 AND doc_id IN (SELECT doc_id FROM documents WHERE source > 'src16') GROUP BY 1)
        SELECT item_id, coalesce(n, 0) AS n_retired, n IS NULL AS passed FROM benchmark LEFT JOIN x USING (item_id)""",
    "archive_regret": f"""WITH {_RANKED}, sh AS (SELECT q.item_id, p.doc_id, count(*) AS terms FROM qterms q JOIN post p USING (term) JOIN documents d USING (doc_id) WHERE d.source > 'src16' GROUP BY 1, 2 HAVING count(*) >= 2),
        x AS (SELECT sh.*, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sh JOIN scored USING (item_id, doc_id)) SELECT item_id, doc_id, terms, round(score, 6) AS score FROM x WHERE r = 1""",
    "draft_suppression": f"""WITH {_RANKED} SELECT item_id, count(*) AS hits, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) = 0 AS suppressed FROM ranked WHERE rank <= 3 GROUP BY 1""",
    "merged_tiers": f"""WITH {bm25_sql()}, x AS (SELECT item_id, doc_id, lang, score, row_number() OVER (PARTITION BY item_id, lang ORDER BY round(score, 9) DESC, doc_id) AS n FROM scored JOIN documents USING (doc_id))
        SELECT item_id, doc_id, CASE WHEN n = 1 THEN lang ELSE lang || '~' || n END AS label, round(score, 6) AS score FROM x WHERE n <= 5""",
    "link_suggestions": f"WITH {_UNIT} SELECT query_id, vec_id, rank FROM near WHERE rank <= 3 AND label <> query_label",
    "reachability": f"""WITH {_E}, s AS (SELECT q, node FROM (SELECT p_brand AS q, p_partkey AS node, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 9) DESC, p_partkey) AS n FROM part) WHERE n <= 3),
        o AS (SELECT DISTINCT q, dst AS node FROM s JOIN u ON u.src = s.node), t AS (SELECT DISTINCT q, dst AS node FROM o JOIN u ON u.src = o.node),
        l AS (SELECT q, node, min(depth) AS depth FROM (SELECT q, node, 0 AS depth FROM s UNION ALL SELECT q, node, 1 FROM o UNION ALL SELECT q, node, 2 FROM t) GROUP BY 1, 2)
        SELECT p_brand AS q, depth, count(*) AS n FROM part LEFT JOIN l ON l.q = p_brand AND l.node = p_partkey GROUP BY 1, 2""",
    "contradiction_pool": """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)
        SELECT a, b, shared FROM p JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE x.s_nationkey <> y.s_nationkey ORDER BY shared DESC, a, b LIMIT 6""",
}
_BODY = ORACLES["body_probe"]
ORACLES |= {
    "flag_arms": f"""WITH {_RANKED}, o AS (SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 10),
        f AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score * CASE WHEN lang = 'en' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 9) DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id))
        SELECT 'off_on' AS arms, count(*) AS n FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM f WHERE rank <= 10) UNION ALL SELECT 'off_off', 0""",
    "eval_gates": f"""SELECT 'self_recall' AS gate, recall, CASE WHEN n > 0 THEN recall >= 0.9 END AS passed FROM ({ORACLES['self_recall']})
        UNION ALL SELECT 'body_probe', recall, CASE WHEN n > 0 THEN recall >= 0.8 END FROM ({_BODY})""",
}
