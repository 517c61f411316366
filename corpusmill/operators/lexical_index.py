"""A lexical index kept as tables in a folder, brought up to date from changed rows alone.

Each refresh is a version. `docs` of a version lists every row with the hash of its
content, its length and the version that has its postings; `postings` of a version
holds those of the rows that it added or changed; `terms` of a version has all
document frequencies. A posting counts if `docs` names its row and version, so a
refresh rewrites no postings; `compact` gathers them once there are many versions.
`docs` is written last: a refresh that fails leaves the version before in force, and
is written over by the next.

Rows without a key aren't indexed. Of rows that share a key, that with the greatest
hash counts. A null text is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.oracle import terms_sql
from ..sources.scratch import folder, stored
from ..sources.tables import table
from .retrieval import B, EPSILON, K1, doc_terms, postings

#: Changed rows up to which their keys are broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Index:
    """One version: docs (doc_id, hash, len, version), postings (doc_id, len, term, tf), terms (term, df), rows and tokens."""

    version: int
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    tokens: int


# --- operators --------------------------------------------------------------------------------------------------------


def content_hash(text: str = "text"):
    return F.xxhash64(T.text_of(text), F.length(T.text_of(text)))


def _latest(spark: SparkSession, path: str) -> int | None:
    """The greatest version whose docs are complete."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/docs")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    done = [s.getPath() for s in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(p.getName().removeprefix("version=")) for p in done), default=None)


def read_index(spark: SparkSession, path: str) -> Index:
    version = _latest(spark, path)
    if version is None:
        raise ValueError(f"no index in {path}")
    docs = spark.read.parquet(f"{path}/docs/version={version}").select("doc_id", "hash", "len", F.col("segment").alias("version"))
    used = sorted(r["version"] for r in docs.select("version").distinct().collect())  # as many as refreshes since compact()
    named = docs.select("doc_id", "version")
    held = None
    for segment in used:
        rows = spark.read.parquet(f"{path}/postings/version={segment}").withColumn("version", F.lit(segment))
        held = rows if held is None else held.unionByName(rows)
    if held is None:
        live = spark.read.parquet(f"{path}/postings/version={version}")
    elif len(used) == 1 and used[0] == version:
        live = held.drop("version")
    else:
        live = held.join(named, ["doc_id", "version"], "left_semi").drop("version")
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
    return Index(version, docs, live, spark.read.parquet(f"{path}/terms/version={version}"), totals["n"], totals["tokens"])


def _write(df: DataFrame, path: str, what: str, version: int) -> DataFrame:
    place = f"{path}/{what}/version={version}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def refresh_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", hash_column: str | None = None) -> Index:
    """Bring the index in `path` to what `docs` says, building it where there is none; the new version.

    Texts are hashed where they lie, or not read at all where `hash_column`
    has a hash of the content already. Only added and changed rows are cut
    into terms and written; what their old postings counted is taken off.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(key).isNotNull())
    value = F.col(hash_column) if hash_column else content_hash(text)
    now = stored(known.groupBy(F.col(key).alias("doc_id")).agg(F.max(value).alias("hash"), F.count(F.lit(1)).alias("rows")))
    before = read_index(spark, path) if _latest(spark, path) is not None else None
    version = 0 if before is None else before.version + 1
    if before is None:
        fresh, kept, stale = now.select("doc_id", "hash"), None, None
    else:
        old = before.docs.select("doc_id", F.col("hash").alias("was"), "len", "version")
        both = stored(now.join(old, "doc_id", "full"))
        same = F.col("hash").eqNullSafe(F.col("was"))
        kept = both.where(same & F.col("version").isNotNull()).select("doc_id", "hash", "len", F.col("version").alias("segment"))
        fresh = both.where(F.col("hash").isNotNull() & ~(same & F.col("version").isNotNull())).select("doc_id", "hash")
        stale = both.where(F.col("version").isNotNull() & ~same).select("doc_id")
    few = (lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df) if before is not None else (lambda df: df)
    rows = known.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), value.alias("hash"))
    changed = rows if before is None else rows.join(few(fresh), ["doc_id", "hash"], "left_semi")
    if now.agg(F.coalesce(F.sum("rows"), F.lit(0)) > F.count(F.lit(1))).first()[0]:
        # Only where keys stand in several rows, one of those must be chosen.
        changed = changed.join(now, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.first("text").alias("text"))
    added = _write(postings(changed).sortWithinPartitions("term"), path, "postings", version)
    lens = added.select("doc_id", "len").distinct()
    entries = fresh.join(lens, "doc_id", "left").select("doc_id", "hash", F.coalesce("len", F.lit(0)).alias("len"), F.lit(version).alias("segment"))
    plus = added.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if before is None:
        _write(plus, path, "terms", version)
    else:
        gone = before.postings.join(few(stale), "doc_id", "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        total = before.terms.unionByName(plus).unionByName(gone).groupBy("term").agg(F.sum("df").alias("df"))
        _write(total.where("df > 0"), path, "terms", version)
        entries = entries.unionByName(kept)
    _write(entries, path, "docs", version)
    return read_index(spark, path)


def compact(spark: SparkSession, path: str) -> Index:
    """A version with all postings in one table."""
    index = read_index(spark, path)
    version = index.version + 1
    _write(index.postings.repartition("term").sortWithinPartitions("term"), path, "postings", version)
    _write(index.terms, path, "terms", version)
    _write(index.docs.select("doc_id", "hash", "len", F.lit(version).alias("segment")), path, "docs", version)
    return read_index(spark, path)


def index_idf(index: Index) -> DataFrame:
    """(term, df, idf) as `retrieval.idf` has them."""
    raw = index.terms.select("term", "df", (F.log(index.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def index_scores(index: Index, queries: DataFrame, query_key: str = "item_id") -> DataFrame:
    """(query key, doc_id, score) as `retrieval.bm25_scores` has them, from the index alone."""
    wanted = doc_terms(queries, query_key).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    weighted = stored(wanted.join(index_idf(index).select("term", "idf"), "term"))
    average = index.tokens / index.n if index.n else 1.0
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(average)))
    return index.postings.join(weighted, "term").groupBy(query_key, "doc_id").agg(F.sum(part).alias("score"))


def integrity(index: Index) -> DataFrame:
    """(problem, n): rows whose length isn't that of their postings, terms whose frequency isn't; none if all is well."""
    counted = index.postings.groupBy("doc_id").agg(F.sum("tf").alias("tokens"))
    lengths = index.docs.join(counted, "doc_id", "full").where("coalesce(len, -1) <> coalesce(tokens, 0)")
    found = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("found"))
    terms = index.terms.join(found, "term", "full").where("coalesce(df, 0) <> coalesce(found, 0)")
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("problem"), "n")
    return count(lengths, "lengths").unionByName(count(terms, "terms")).where("n > 0")


# --- queries ----------------------------------------------------------------------------------------------------------


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus before: without the first source, French rows with other ends, and benchmark passages, gone since."""
    d = table(spark, sf_dir, "documents").where("source <> 'src0'")
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" earlier edition"))).otherwise(F.col("text"))
    b = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    return d.select("doc_id", text.alias("text")).unionByName(b)


def _refreshed(spark: SparkSession, sf_dir: str) -> Index:
    import uuid

    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    refresh_index(_earlier(spark, sf_dir), path)
    return refresh_index(table(spark, sf_dir, "documents"), path)


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of an index of the corpus before, brought up to date."""
    return _refreshed(spark, sf_dir).terms


def index_refresh_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and numbers of terms in such an index, and the version that has the postings."""
    index = _refreshed(spark, sf_dir)
    per = index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("tokens"))
    found = index.docs.join(per, "doc_id", "left").select("doc_id", F.col("len").cast("bigint").alias("len"), "n_terms", "tokens", "version")
    return found.na.fill(0, ["n_terms", "tokens"])


QUERIES = {f.__name__: f for f in (index_refresh, index_refresh_lengths)}

_T = terms_sql("doc_id", "documents")
ORACLES = {
    "index_refresh": f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_T}) GROUP BY 1",
    "index_refresh_lengths": f"""SELECT d.doc_id, count(term) AS len, count(DISTINCT term) AS n_terms, count(term) AS tokens,
        CAST(CASE WHEN source = 'src0' OR lang = 'fr' THEN 1 ELSE 0 END AS INTEGER) AS version FROM documents d LEFT JOIN ({_T}) t USING (doc_id) GROUP BY ALL""",
}
