"""Does a successor outrank what it replaced, under the queries that used to find the old one?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..functions.oracle import bm25_sql
from ..sources.scratch import stored
from ..sources.tables import table
from .retrieval import bm25_top, term_rows

#: Queries replayed for an old name, the latest ones; ranks looked at.
QUERIES_EACH, K = 10, 10


# --- operators --------------------------------------------------------------------------------------------------------


def harvested(recalls: DataFrame, chains: DataFrame) -> DataFrame:
    """(old, successor, query): the last QUERIES_EACH different queries that found each old name, by their first time.

    `recalls` has (seq, query, name), `chains` (old, successor). Blank queries
    don't count. Repeated recalls are one before anything is put in order.
    """
    asked = recalls.where("name IS NOT NULL").select("seq", F.trim("query").alias("query"), F.col("name").alias("old")).where("query <> ''")
    pairs = chains.where("old IS NOT NULL AND successor IS NOT NULL").select("old", "successor").distinct()
    first = asked.join(pairs.select("old").distinct(), "old", "left_semi").groupBy("old", "query").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(W.partitionBy("old").orderBy(F.desc("seq"), "query"))
    return stored(first.withColumn("place", place).where(F.col("place") <= QUERIES_EACH)).join(pairs, "old").select("old", "successor", "query")


def replayed(harvest: DataFrame, ranking: DataFrame) -> DataFrame:
    """(old, successor, query, old_rank, successor_rank, verdict) under a ranking (query, name, rank) of now.

    PASS: the successor is among the first K and before the old name. FAIL: the
    old name is there and the successor is not, or behind. Else INCONCLUSIVE.
    """
    top = ranking.where(F.col("rank") <= K).groupBy("query", "name").agg(F.min("rank").alias("rank"))
    both = harvest.join(top.toDF("query", "old", "old_rank"), ["query", "old"], "left").join(top.toDF("query", "successor", "successor_rank"), ["query", "successor"], "left")
    ahead = F.col("successor_rank").isNotNull() & (F.col("old_rank").isNull() | (F.col("successor_rank") < F.col("old_rank")))
    verdict = F.when(ahead, "PASS").when(F.col("old_rank").isNotNull(), "FAIL").otherwise("INCONCLUSIVE")
    return both.select("old", "successor", "query", "old_rank", "successor_rank", verdict.alias("verdict"))


def tail_chance(heads: Column, tosses: Column) -> Column:
    """Chance of so many heads or more, by logarithms of factorials."""
    log_fact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    term = lambda s, i: s + F.exp(log_fact(tosses) - log_fact(i) - log_fact(tosses - i) - tosses * F.log(F.lit(2.0)))
    return F.least(F.aggregate(F.sequence(heads, tosses), F.lit(0.0), term), F.lit(1.0))


def succession_summary(rows: DataFrame) -> DataFrame:
    """(old, successor, passed, failed, inconclusive, p): counts, and the chance of as many passes by coin tosses."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    each = rows.groupBy("old", "successor").agg(count("PASS").alias("passed"), count("FAIL").alias("failed"), count("INCONCLUSIVE").alias("inconclusive"))
    return each.withColumn("p", F.round(tail_chance(F.col("passed"), F.col("passed") + F.col("failed")), 6))


# --- queries ----------------------------------------------------------------------------------------------------------


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are replaced by the next one that begins with the same sentence; passages are the queries. Before, they
    were ranked by score; now those that were replaced count half."""
    d = table(spark, sf_dir, "documents")
    name = F.trim(F.regexp_extract(T.text_of("text"), r"^[^.!?\n]*", 0))
    named = d.select("doc_id", name.alias("name")).where("name <> ''")
    # Sentences that one document alone begins with replace nothing and go before the window.
    several = stored(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    following = F.lead("doc_id").over(W.partitionBy("name").orderBy("doc_id"))
    chains = stored(named.join(several, "name").select(F.col("doc_id").alias("old"), following.alias("successor")).where("successor IS NOT NULL"))
    q = table(spark, sf_dir, "benchmark")
    old = chains.select(F.col("old").alias("doc_id"), F.lit(0.5).alias("weight")).distinct()
    rows = term_rows(d.select("doc_id", "text").join(old, "doc_id", "left"))
    before = bm25_top(rows, q, K).select(F.col("item_id").alias("seq"), F.col("item_id").cast("string").alias("query"), F.col("doc_id").alias("name"))
    now = bm25_top(rows, q, K, factor=F.coalesce("weight", F.lit(1.0)))
    ranking = now.select(F.col("item_id").cast("string").alias("query"), F.col("doc_id").alias("name"), "rank")
    return replayed(harvested(before, chains), stored(ranking))


def succession_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every harvested query."""
    return _replay(spark, sf_dir)


def succession_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by replaced document, with the sign test."""
    return succession_summary(_replay(spark, sf_dir))


QUERIES = {f.__name__: f for f in (succession_replay, succession_counts)}

_REPLAY = rf"""{bm25_sql()}, names AS (SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '^[^.!?\n]*')) AS name FROM documents),
    chains AS (SELECT doc_id AS old, lead(doc_id) OVER (PARTITION BY name ORDER BY doc_id) AS successor FROM names WHERE name <> '' QUALIFY successor IS NOT NULL),
    before AS (SELECT item_id, doc_id FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 10),
    now AS (SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score * CASE WHEN doc_id IN (SELECT old FROM chains) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 9) DESC, doc_id)
      AS INTEGER) AS rank FROM scored QUALIFY rank <= 10),
    asked AS (SELECT old, successor, item_id FROM before JOIN chains ON old = doc_id QUALIFY row_number() OVER (PARTITION BY old ORDER BY item_id DESC) <= 10),
    r AS (SELECT old, successor, CAST(asked.item_id AS VARCHAR) AS query, o.rank AS old_rank, s.rank AS successor_rank,
      CASE WHEN s.rank IS NOT NULL AND (o.rank IS NULL OR s.rank < o.rank) THEN 'PASS' WHEN o.rank IS NOT NULL THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict
      FROM asked LEFT JOIN now o ON o.item_id = asked.item_id AND o.doc_id = old LEFT JOIN now s ON s.item_id = asked.item_id AND s.doc_id = successor)"""
ORACLES = {
    "succession_replay": f"WITH {_REPLAY} SELECT * FROM r",
    "succession_counts": f"""WITH {_REPLAY}, c AS (SELECT old, successor, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'FAIL') AS failed,
        count(*) FILTER (verdict = 'INCONCLUSIVE') AS inconclusive FROM r GROUP BY 1, 2)
        SELECT *, round(least(list_sum(list_transform(range(passed, passed + failed + 1), lambda i: exp(lgamma(passed + failed + 1) - lgamma(i + 1) - lgamma(passed + failed - i + 1) - (passed + failed) * ln(2)))), 1), 6) AS p FROM c""",
}
