"""Dense ranking, fusion of rankings, priors, cutoffs and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.oracle import bm25_sql
from ..sources.tables import table
from .retrieval import bm25_top, top_k

RRF_K, KNEE, LAMBDA, DENSE_FLOOR = 60, 0.5, 0.8, 0.5
#: Query vectors: every vector whose id is divisible by this.
QUERY_STEP = 20
#: Queries in one broadcast block; more queries go in more blocks.
BLOCK_QUERIES = 50_000
#: Vectors in a block on average, and queries of it in one matrix product.
BLOCK, STRIP = 8_192, 256
#: How far a matrix product and rounding to nine places may move a cosine, with room.
MARGIN = 2e-9


def normalised(vector: Column) -> Column:
    """Vector of length 1 in doubles; a zero vector stays zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def query_blocks(queries: DataFrame, key: str) -> list[DataFrame]:
    """The queries in blocks of about BLOCK_QUERIES rows, by a hash of their key, each small enough to broadcast."""
    n = max(1, -(-queries.count() // BLOCK_QUERIES))
    of = F.pmod(F.xxhash64(key), F.lit(n))
    return [queries.where(of == i) for i in range(n)] if n > 1 else [queries]


def _met(vectors: DataFrame, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What `work(q, v)` gives for every block of queries with every block of vectors, as rows of `schema`.

    Both sides are dealt into blocks by a hash of their ids, and each block is
    sent to those of the other side, so a task holds two bounded blocks. Vectors
    meet those of their own length; null ids, vectors and numbers have no cosine.
    """
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"
    label = F.col("label").cast("bigint") if "label" in vectors.columns else F.lit(None).cast("bigint")
    cut = lambda df: df.where(usable).select(F.size("embedding").alias("dim"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"), label.alias("label"))
    n_v, n_q = (max(1, -(-df.count() // BLOCK)) for df in (vectors, queries))
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(cut(queries), "qb", n_q, "vb", n_v), deal(cut(vectors), "vb", n_v, "qb", n_q)
    target = schema_of(schema)
    keys = "dim", "qb", "vb"

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        parts = [work(*x) for x in _halves(q, v)] if q.num_rows and v.num_rows else []
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * len(target)
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, target)], schema=target)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of columns of `long` and `double`."""
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class _Block:
    """Ids, labels and unit vectors of rows, in order of their ids."""

    def __init__(self, t: pa.Table):
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        e = t["e"].combine_chunks()
        e = e.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), t["dim"][0].as_py())[order]
        self.known = t["label"].is_valid().to_numpy()[order]
        self.labels = t["label"].fill_null(0).to_numpy()[order]
        # Squares are summed one by one, as `normalised` does.
        with np.errstate(all="ignore"):
            total = np.zeros(len(ids))
            for x in e.T:
                total += x * x
            norm = np.sqrt(total)
            self.units = e / np.where(norm == 0, 1.0, norm)[:, None]

    def part(self, at: slice) -> _Block:
        new = object.__new__(_Block)
        new.ids, new.known, new.labels, new.units = self.ids[at], self.known[at], self.labels[at], self.units[at]
        return new


def _halves(q: pa.Table, v: pa.Table) -> Iterator[tuple[_Block, _Block, np.ndarray]]:
    """(queries, vectors, cosines) by strips of queries; the cosines are right to 1e-12, infinite for NaN, and -inf for rows that don't count."""
    queries, vectors = _Block(q), _Block(v)
    for i in range(0, len(queries.ids), STRIP):
        strip = queries.part(slice(i, i + STRIP))
        with np.errstate(all="ignore"):
            cosines = strip.units @ vectors.units.T
        cosines[np.isnan(cosines)] = np.inf
        first, last = (np.searchsorted(vectors.ids, strip.ids, side) for side in ("left", "right"))
        for at in np.flatnonzero(last > first):
            cosines[at, first[at]:last[at]] = -np.inf
        yield strip, vectors, cosines


def _exact(q: _Block, v: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (i, j), products summed one by one, so that they don't depend on blocks."""
    total = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for a, b in zip(q.units.T, v.units.T):
            total += a[i] * b[j]
    return total


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows of the highest cosine to each query, other than itself.

    Scores equal to nine places go to the lower id. Every pair is looked at;
    what a block's matrix product leaves over is computed again one by one.
    """

    def work(q: _Block, v: _Block, cosines: np.ndarray) -> tuple[np.ndarray, ...]:
        at = max(cosines.shape[1] - k, 0)
        least = np.partition(cosines, at, axis=1)[:, at] - MARGIN
        i, j = np.nonzero((cosines >= least[:, None]) & (cosines > -np.inf))
        score = _exact(q, v, i, j)
        order = np.lexsort((j, -np.nan_to_num(np.rint(score * 1e9), nan=np.inf), i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < k
        return q.ids[i[kept]], v.ids[j[kept]], score[kept]

    return top_k(_met(vectors, queries, work, "query_id long, vec_id long, score double"), k, "query_id", "vec_id")


def floor_counts(vectors: DataFrame, queries: DataFrame, floors: list[float]) -> DataFrame:
    """(query_id, floor, n): rows whose cosine to nine places reaches each floor, 0 included."""

    def work(q: _Block, v: _Block, cosines: np.ndarray) -> tuple[np.ndarray, ...]:
        found = []
        for f in floors:
            sure = cosines >= f + MARGIN
            i, j = np.nonzero((cosines >= f - MARGIN) & ~sure)
            i = i[np.rint(_exact(q, v, i, j) * 1e9) >= np.rint(f * 1e9)]
            found.append(sure.sum(axis=1) + np.bincount(i, minlength=len(q.ids)))
        met = (cosines > -np.inf).any(axis=1)
        return np.tile(q.ids[met], len(floors)), np.repeat(floors, met.sum()), np.concatenate([n[met] for n in found])

    found = _met(vectors, queries, work, "query_id long, floor double, n long")
    return found.groupBy("query_id", "floor").agg(F.sum("n").alias("n"))


def best_by_label(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, on_topic, off_topic): each query's highest cosine, to nine places, of rows with its label and with another."""

    def work(q: _Block, v: _Block, cosines: np.ndarray) -> tuple[np.ndarray, ...]:
        same = q.labels[:, None] == v.labels[None, :]
        known = q.known[:, None] & v.known[None, :]
        found = [q.ids]
        for of in (known & same, known & ~same):
            c = np.where(of, cosines, -np.inf)
            j = c.argmax(axis=1)
            i = np.arange(len(j))
            found.append(np.where(c[i, j] > -np.inf, _exact(q, v, i, j), -np.inf))
        met = (cosines > -np.inf).any(axis=1)
        return tuple(x[met] for x in found)

    found = _met(vectors, queries, work, "query_id long, on_topic double, off_topic double")
    best = lambda c: F.max(F.when(F.col(c) != float("-inf"), F.round(c, 9))).alias(c)
    return found.groupBy("query_id").agg(best("on_topic"), best("off_topic"))


def reciprocal_ranks(rankings: list[tuple[DataFrame, float]], query_key: str, key: str) -> DataFrame:
    """Reciprocal-rank fusion of (query key, key, rank) rankings with weights.

    Ties keep the order of first appearance: first ranking, then rank in it.
    """
    parts = [
        r.select(query_key, key, (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("first"))
        for i, (r, w) in enumerate(rankings)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy(query_key, key).agg(F.sum("part").alias("score"), F.min("first").alias("first"))
    order = W.partitionBy(query_key).orderBy(F.desc(F.round("score", 12)), "first.list", "first.at", key)
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def knee(ranked: DataFrame, query_key: str, ratio: float = KNEE) -> DataFrame:
    """Rows up to the first whose relevance falls under `ratio` of the last before it.

    Needs query key, rank and relevance. A null relevance never triggers and is
    never compared with.
    """
    order = W.partitionBy(query_key).orderBy("rank")
    known = F.last("relevance", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    drop = ranked.withColumn("drop", F.coalesce((F.col("relevance") < ratio * known).cast("int"), F.lit(0)))
    fallen = F.max("drop").over(order.rowsBetween(W.unboundedPreceding, 0))
    return drop.withColumn("fallen", fallen).where("fallen = 0").drop("drop", "fallen")


def mmr(pool: DataFrame, query_key: str, key: str, lam: float = LAMBDA) -> DataFrame:
    """Greedy re-order for diversity of each query's pool (a few rows by contract).

    Needs query key, key, rank, score, vector (null: keeps its place).
    """
    kinds = dict(pool.dtypes)

    def reorder(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("rank").reset_index(drop=True)
        free = [i for i, v in enumerate(pdf["vector"]) if v is not None]
        picked: list[int] = []
        if len(free) >= 2:
            rows = np.array([pdf["vector"][i] for i in free], "f8")
            sims, near, rest = rows @ rows.T, np.zeros(len(free)), list(range(len(free)))
            while rest:
                values = [lam * pdf["score"][free[i]] - (1 - lam) * near[i] for i in rest]
                best = rest.pop(int(np.argmax(values)))
                picked.append(free[best])
                near = np.maximum(near, sims[best])
        slots = dict(zip(free, picked or free))
        order = [slots.get(i, i) for i in range(len(pdf))]
        out = pdf.loc[order, [query_key, key]].copy()
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, mmr_rank int"
    return pool.select(query_key, key, "rank", "score", "vector").groupBy(query_key).applyInPandas(reorder, schema)


# --- queries ----------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v, v.where(F.col("vec_id") % QUERY_STEP == 0)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(*_vectors(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def dense_floor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at or above each floor for every query, 0 included."""
    return floor_counts(*_vectors(spark, sf_dir), [0.3, 0.5, 0.6, 0.8])


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    n = normalised(F.col("embedding"))
    return v.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.get(n, F.lit(0)), 6).alias("x0"))


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical ranking fused with one by length: two lists over one key."""
    lexical = _lexical(spark, sf_dir, 20).select("item_id", "doc_id", "rank")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    order = W.partitionBy("item_id").orderBy(F.desc("n_chars"), "doc_id")
    by_size = lexical.join(d, "doc_id").withColumn("rank", F.row_number().over(order)).select("item_id", "doc_id", "rank")
    fused = reciprocal_ranks([(lexical, 1.0), (by_size, 0.5)], "item_id", "doc_id")
    return fused.select("item_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def knee_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _lexical(spark, sf_dir, 20).withColumn("relevance", F.round("score", 6))
    return knee(ranked, "item_id", 0.9).select("item_id", "doc_id", "rank")


def prior_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical scores times priors by label: authoritative 1.1 for quality, 0.5 for toxic rows."""
    l = table(spark, sf_dir, "labels")
    factor = F.when(F.col("toxic") == 1, 0.5).when(F.col("quality") == 1, 1.1).otherwise(1.0)
    s = _lexical(spark, sf_dir, 20).join(l, "doc_id", "left").withColumn("score", F.round(F.round("score", 6) * factor, 6))
    return top_k(s.select("item_id", "doc_id", "score"), 10).select("item_id", "doc_id", "score", "rank")


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    pool = nearest(v, q, 20)
    unit = v.select("vec_id", normalised(F.col("embedding")).alias("vector"))
    return mmr(pool.join(unit, "vec_id"), "query_id", "vec_id")


def label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each query vector's ten nearest that carry its label: precision at 10."""
    v, q = _vectors(spark, sf_dir)
    near = nearest(v, q, 10)
    l = v.select("vec_id", "label")
    own = l.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return near.join(l, "vec_id").join(own, "query_id").groupBy("query_id").agg(
        F.round(F.count_if(F.col("label") == F.col("query_label")) / 10, 6).alias("precision_at_10")
    )


QUERIES = {
    f.__name__: f
    for f in (dense_topk, dense_floor_counts, embedding_norms, rrf_fusion, knee_cutoff, prior_multipliers, mmr_rerank, label_vote)
}

_UNIT = """
    unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN nn = 0 THEN 1 ELSE nn END) AS v FROM
      (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nn FROM
        (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))),
    cosines AS (SELECT q.vec_id AS query_id, q.label AS query_label, u.vec_id, u.label,
        list_inner_product(q.v, u.v) AS score FROM unit q JOIN unit u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank
        FROM cosines)"""
_LEX20 = f"""{bm25_sql()},
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
        FROM scored) WHERE rank <= 20)"""

ORACLES = {
    "dense_topk": f"WITH {_UNIT} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM near WHERE rank <= 10",
    "dense_floor_counts": f"""
        WITH {_UNIT} SELECT query_id, floor, count(*) FILTER (round(score, 9) >= floor) AS n
        FROM cosines, (SELECT unnest([0.3, 0.5, 0.6, 0.8]::DOUBLE[]) AS floor) GROUP BY 1, 2""",
    "embedding_norms": f"WITH {_UNIT} SELECT vec_id, len(v) AS dim, round(v[1], 6) AS x0 FROM unit",
    "rrf_fusion": f"""
        WITH {_LEX20},
        sized AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank
            FROM lex JOIN documents USING (doc_id)),
        parts AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS l, rank FROM lex
            UNION ALL SELECT item_id, doc_id, 0.5::DOUBLE / (60 + rank), 1, rank FROM sized),
        f AS (SELECT item_id, doc_id, sum(part) AS score, min(l * 1000 + rank) AS first FROM parts GROUP BY 1, 2)
        SELECT item_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY item_id
            ORDER BY round(score, 12) DESC, first, doc_id) AS INTEGER) AS rank FROM f""",
    "knee_cutoff": f"""
        WITH {_LEX20},
        k AS (SELECT *, lag(round(score, 6)) OVER (PARTITION BY item_id ORDER BY rank) AS before FROM lex),
        m AS (SELECT *, max(CASE WHEN round(score, 6) < 0.9::DOUBLE * before THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY rank) AS gone FROM k)
        SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM m WHERE gone = 0""",
    "prior_multipliers": f"""
        WITH {_LEX20},
        s AS (SELECT item_id, doc_id, round(round(score, 6) * CASE WHEN toxic = 1 THEN 0.5 WHEN quality = 1 THEN 1.1 ELSE 1.0 END::DOUBLE, 6) AS score
            FROM lex LEFT JOIN labels USING (doc_id))
        SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id
            ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    "label_vote": f"""
        WITH {_UNIT} SELECT query_id, round(count(*) FILTER (label = query_label) / 10.0::DOUBLE, 6) AS precision_at_10
        FROM near WHERE rank <= 10 GROUP BY 1""",
}
