"""From raw documents to clean, tokenized ones, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. SQL can't express the stages (they run learned
models, fingerprints and a tokenizer), so tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import bpe, decontaminate, near_copies, secrets, toxicity
from corpusmill.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """(row, text): whole rows as the key, so that a decision stays with its row whatever its id."""
    return docs.select(F.struct(*COLUMNS).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't predicted toxic, by a model trained on the labelled rows of `docs`."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_rows(docs), model, key="row")
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the least id, rows without an id last.

    A row is known by its id and its text, so rows that share an id but not their
    text are judged each by its own text. Of rows that share both, that with the
    least other columns stays. Null and empty texts are one group.
    """
    name = F.struct(
        F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("body")
    )
    docs = docs.select(*COLUMNS).withColumn("name", name)
    keep = near_copies.near_copies(docs, key="name").where("name = component").select("name").distinct()
    rest = F.struct("lang", "source", "n_chars", "text")
    rows = docs.groupBy("name", "doc_id").agg(F.min(rest).alias("rest"))
    return rows.join(keep, "name", "left_semi").select("doc_id", "rest.*").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage."""
    clean = decontaminate.flagged(_rows(docs), table(spark, sf_dir, "benchmark"), key="row")
    return clean.where("NOT contaminated").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of every secret and the length of the text as it is now."""
    weights = secrets.train(secrets.labelled_samples(spark))
    clean = secrets.redact(docs.select(*COLUMNS), weights)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    path, pattern = bpe.default_vocabulary()
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    return bpe.tokenized(rows, path, pattern, key="row").select(
        "row.*", "ids", "n_tokens", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = stored(docs)
    return docs
