"""Retrieval evaluation over runs (query, key, rank) and judgements (query, key)."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.oracle import bm25_sql, tokens_sql
from ..sources.scratch import stored
from ..sources.tables import table
from .ranking import query_blocks
from .retrieval import bm25_top, doc_tokens, term_rows, top_k

K = 10


def first_hits(run: DataFrame, qrels: DataFrame, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, best): rank of the first judged key in the run; null on a miss."""
    hit = run.join(qrels.select(query, key).distinct(), [query, key]).groupBy(query).agg(F.min("rank").alias("best"))
    return qrels.select(query).distinct().join(hit, query, "left")


def recall_and_mrr(hits: DataFrame, *by: str, k: int = K) -> DataFrame:
    """Share of queries with a hit in the top k, and the mean of 1/rank with misses as 0."""
    found = F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))
    rr = F.coalesce(F.when(F.col("best") <= k, 1 / F.col("best")), F.lit(0.0))
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(found), 6).alias("recall"), F.round(F.avg(rr), 6).alias("mrr")
    )


def precision_at_k(run: DataFrame, qrels: DataFrame, k: int = K, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Judged keys in the top k over k, however many the run returned."""
    hit = run.where(F.col("rank") <= k).join(qrels.select(query, key).distinct(), [query, key]).groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    return qrels.select(query).distinct().join(hit, query, "left").select(query, F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("precision"))


def sign_test_p(n_pos: int, n_neg: int) -> float:
    """Chance of n_pos or more heads in n_pos + n_neg tosses."""
    n = n_pos + n_neg
    return sum(comb(n, i) for i in range(n_pos, n + 1)) / 2**n if n else 1.0


# --- queries: benchmark passages as queries, documents that hold them as judgements ------------------------------------


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant to a passage if it holds the whole of it.

    Such a document has all tokens of the passage but its first and last, which
    may be parts of longer ones there; the longest of them is looked up, and the
    passage then compared. Passages without such a token are compared with all
    documents, in blocks.
    """
    inner = T.tokens(F.regexp_replace(T.text_of("text"), r"^[\p{L}\p{N}_]+|[\p{L}\p{N}_]+$", " "))
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t), t.alias("token"))))["token"]
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), longest.alias("token")).where("text <> ''")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    near = d.select("doc_id", F.explode(F.array_distinct(T.tokens(T.text_of("text")))).alias("token")).join(q.select("item_id", "token"), "token")
    both = near.select("item_id", "doc_id").join(d, "doc_id").join(q.select("item_id", "passage"), "item_id")
    found = both.where(F.contains("text", "passage")).select("item_id", "doc_id", "lang")
    for block in query_blocks(q.where("token IS NULL").select("item_id", "passage"), "item_id"):
        found = found.unionByName(d.join(F.broadcast(block), F.contains("text", "passage")).select("item_id", "doc_id", "lang"))
    return found


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), K).select("item_id", "doc_id", "rank")


def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_and_mrr(first_hits(_run(spark, sf_dir), _qrels(spark, sf_dir)))


def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the language that most of a query's relevant documents have, then the first of them."""
    q = _qrels(spark, sf_dir)
    hits = first_hits(_run(spark, sf_dir), q)
    cat = q.groupBy("item_id").agg(F.min("lang").alias("category"))
    return recall_and_mrr(hits.join(cat, "item_id"), "category")


def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precision_at_k(_run(spark, sf_dir), _qrels(spark, sf_dir))


def eval_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries that no document reaches a score of 60 for, and how many."""
    s = bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 1).where("round(score, 6) >= 60").select("item_id").distinct()
    q = table(spark, sf_dir, "benchmark").select("item_id")
    none = q.join(s.withColumn("hit", F.lit(1)), "item_id", "left")
    n = F.count_if(F.col("hit").isNull())
    return none.agg(n.alias("abstained"), F.round(n / F.count(F.lit(1)), 6).alias("rate"))


def eval_resolvability(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id")
    found = _qrels(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_targets"))
    return q.join(found, "item_id", "left").select("item_id", F.coalesce("n_targets", F.lit(0)).alias("n_targets"))


def eval_null_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical ranking against plain overlap: hits at ten of each, and which is better, by query."""
    qrels = _qrels(spark, sf_dir)
    q, d = doc_tokens(table(spark, sf_dir, "benchmark"), "item_id"), doc_tokens(table(spark, sf_dir, "documents"), "doc_id")
    grep = top_k(d.join(q, "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("score")), K).select("item_id", "doc_id", "rank")
    a = first_hits(_run(spark, sf_dir), qrels).withColumnRenamed("best", "bm25")
    b = first_hits(grep, qrels).withColumnRenamed("best", "grep")
    both = a.join(b, "item_id")
    return both.select("item_id", "bm25", "grep", F.signum(1 / F.coalesce("bm25", F.lit(1000)) - 1 / F.coalesce("grep", F.lit(1000))).cast("int").alias("better"))


def eval_miss_autopsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents that aren't the first of the ranking, with the score they miss that place by."""
    d, q, qrels = term_rows(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), stored(_qrels(spark, sf_dir))
    run = stored(bm25_top(d, q, 1))
    s = bm25_top(d, q, None, among=qrels).select("item_id", "doc_id", "score")
    floor = run.groupBy("item_id").agg(F.min("score").alias("floor"))
    missed = qrels.join(run.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    j = missed.join(s, ["item_id", "doc_id"], "left").join(floor, "item_id")
    return j.select("item_id", "doc_id", F.round(F.col("floor") - F.coalesce("score", F.lit(0.0)), 6).alias("margin"))


def eval_token_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (characters over four) of the whole corpus, of an average top ten, and what that saves."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.bround(F.length("text") / 4).alias("tokens"))
    full = d.agg(F.sum("tokens").alias("full"))
    per = _run(spark, sf_dir).join(d, "doc_id").groupBy("item_id").agg(F.sum("tokens").alias("t"))
    return per.agg(F.round(F.avg("t"), 4).alias("injected")).crossJoin(F.broadcast(full)).select("full", "injected", F.round(F.col("full") - F.col("injected"), 4).alias("saved"))


def floor_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoint between on-topic and off-topic scores if they part, else the low tenth of the on-topic ones."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    on, off = F.when(F.col("quality") == 1, F.col("n_chars")), F.when(F.col("quality") == 0, F.col("n_chars"))
    low = F.percentile(on, F.lit(0.1))
    floor = F.when(F.min(on) > F.max(off), (F.min(on) + F.max(off)) / 2).otherwise(low)
    return l.agg(F.round(floor, 4).alias("floor"), F.min(on).alias("on_min"), F.max(off).alias("off_max"))


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: days with more purchases than errors against the opposite, and the one-sided chance of that."""
    e = table(spark, sf_dir, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("event_type") == "purchase") - F.count_if(F.col("event_type") == "error")).alias("diff")
    )
    g = day.groupBy("user_id").agg(F.count_if(F.col("diff") > 0).alias("pos"), F.count_if(F.col("diff") < 0).alias("neg"))
    n = F.col("pos") + F.col("neg")
    # The tail of the binomial, by logarithms of factorials summed once.
    log_fact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    tail = F.aggregate(
        F.sequence(F.col("pos"), n), F.lit(0.0), lambda s, i: s + F.exp(log_fact(n) - log_fact(i) - log_fact(n - i) - n * F.log(F.lit(2.0)))
    )
    return g.select("user_id", "pos", "neg", F.round(F.least(tail, F.lit(1.0)), 6).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_recall_mrr, eval_by_category, eval_precision, eval_abstention, eval_resolvability, eval_null_arms, eval_miss_autopsy,
        eval_token_reduction, floor_separation, sign_test,
    )
}

_CTE = f"""{bm25_sql()},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored),
    run AS (SELECT * FROM ranked WHERE rank <= 10),
    qrels AS (SELECT item_id, doc_id, lang FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    hits AS (SELECT q.item_id, min(rank) AS best, min(lang) AS category FROM qrels q LEFT JOIN run USING (item_id, doc_id) GROUP BY 1)"""
_RM = "count(*) AS n_queries, round(avg(CASE WHEN best IS NULL THEN 0 ELSE 1 END), 6) AS recall, round(avg(CASE WHEN best IS NULL THEN 0 ELSE 1 / best END), 6) AS mrr"

ORACLES = {
    "eval_recall_mrr": f"WITH {_CTE} SELECT {_RM} FROM hits",
    "eval_by_category": f"WITH {_CTE} SELECT category, {_RM} FROM hits GROUP BY 1",
    "eval_precision": f"WITH {_CTE} SELECT q.item_id, round(count(rank) / 10, 6) AS precision FROM qrels q LEFT JOIN run USING (item_id, doc_id) GROUP BY 1",
    "eval_abstention": f"""WITH {_CTE} SELECT count(*) FILTER (s.item_id IS NULL) AS abstained, round(count(*) FILTER (s.item_id IS NULL) / count(*), 6) AS rate
        FROM benchmark b LEFT JOIN (SELECT DISTINCT item_id FROM scored WHERE round(score, 6) >= 60) s USING (item_id)""",
    "eval_resolvability": f"""WITH {_CTE} SELECT b.item_id, count(q.doc_id) AS n_targets FROM benchmark b LEFT JOIN qrels q USING (item_id) GROUP BY 1""",
    "eval_null_arms": f"""WITH {_CTE}, qt AS (SELECT DISTINCT item_id, token FROM ({tokens_sql('item_id', 'benchmark')})),
        dt AS (SELECT DISTINCT doc_id, token FROM ({tokens_sql('doc_id', 'documents')})),
        g AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM qt JOIN dt USING (token) GROUP BY 1, 2),
        x AS (SELECT q.item_id, CAST(min(r.rank) AS INTEGER) AS bm25, CAST(min(g.rank) AS INTEGER) AS grep FROM qrels q LEFT JOIN run r USING (item_id, doc_id)
          LEFT JOIN (SELECT * FROM g WHERE rank <= 10) g USING (item_id, doc_id) GROUP BY 1)
        SELECT item_id, bm25, grep, CAST(sign(1 / coalesce(bm25, 1000) - 1 / coalesce(grep, 1000)) AS INTEGER) AS better FROM x""",
    "eval_miss_autopsy": f"""WITH {_CTE}, f AS (SELECT item_id, score AS floor FROM run WHERE rank = 1)
        SELECT q.item_id, q.doc_id, round(floor - coalesce(s.score, 0), 6) AS margin FROM qrels q LEFT JOIN ranked s USING (item_id, doc_id) JOIN f USING (item_id)
        WHERE coalesce(rank, 11) > 1""",
    "eval_token_reduction": f"""WITH {_CTE}, d AS (SELECT doc_id, round_even(length(text) / 4, 0) AS tokens FROM documents),
        p AS (SELECT item_id, sum(tokens) AS t FROM run JOIN d USING (doc_id) GROUP BY 1), a AS (SELECT round(avg(t), 4) AS injected FROM p), c AS (SELECT sum(tokens) AS f FROM d)
        SELECT f AS "full", injected, round(f - injected, 4) AS saved FROM a, c""",
    "floor_separation": """WITH l AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), a AS (SELECT min(n_chars) FILTER (quality = 1) AS on_min,
        max(n_chars) FILTER (quality = 0) AS off_max, quantile_cont(CASE WHEN quality = 1 THEN n_chars END, 0.1) AS low FROM l)
        SELECT round(CASE WHEN on_min > off_max THEN (on_min + off_max) / 2 ELSE low END, 4) AS floor, on_min, off_max FROM a""",
    "sign_test": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS diff FROM events GROUP BY 1, 2),
        g AS (SELECT user_id, count(*) FILTER (diff > 0) AS pos, count(*) FILTER (diff < 0) AS neg FROM d GROUP BY 1),
        t AS (SELECT user_id, pos, neg, unnest(range(pos, pos + neg + 1)) AS i FROM g)
        SELECT user_id, pos, neg, round(least(sum(factorial(CAST(pos + neg AS INTEGER))::DOUBLE / factorial(CAST(i AS INTEGER))::DOUBLE / factorial(CAST(pos + neg - i AS INTEGER))::DOUBLE / pow(2, pos + neg)), 1), 6) AS p
        FROM t GROUP BY 1, 2, 3""",
}
