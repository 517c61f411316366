"""An index brought up to date equals one built anew, and touches changed rows alone."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical_index as L, retrieval

SCHEMA = "doc_id long, text string"
WORDS = "apple bridges cloud running planes echoed forest glass houses island jumped kettle lanterns".split()


def text(rng):
    return rng.choice([None, "", "the of"]) if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 15)))


def rows_of(index):
    return (
        {tuple(r) for r in index.docs.select("doc_id", "hash", "len").collect()},
        sorted(tuple(r) for r in index.postings.select("doc_id", "len", "term", "tf").collect()),
        {tuple(r) for r in index.terms.select("term", "df").collect()}, index.n, index.tokens,
    )


def test_refreshes_equal_rebuilds(spark, tmp_path):
    rng = random.Random(3)
    corpus = {i: text(rng) for i in range(25)}
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError):
        L.read_index(spark, path)
    changed = set(corpus)
    for step in range(2):
        frame = spark.createDataFrame([*corpus.items(), (None, "nameless")], SCHEMA)
        index = L.refresh_index(frame, path)
        assert rows_of(index) == rows_of(L.refresh_index(frame, f"file://{tmp_path}/new{step}"))
        assert index.version == step and L.integrity(index).collect() == []
        # The version's own postings are those of added and changed rows alone.
        written = {r.doc_id for r in spark.read.parquet(f"{path}/postings/version={step}").select("doc_id").collect()}
        assert written == {i for i in changed if corpus.get(i) and corpus[i] != "the of"}
        queries = spark.createDataFrame([(1, "apple clouds"), (2, "running running island"), (3, "nothing")], "item_id long, text string")
        got = {(r.item_id, r.doc_id): round(r.score, 9) for r in L.index_scores(index, queries).collect()}
        want = retrieval.bm25_scores(frame.where("doc_id IS NOT NULL"), queries)
        assert got == {(r.item_id, r.doc_id): round(r.score, 9) for r in want.collect()} and got
        before = dict(corpus)
        for i in rng.sample(sorted(corpus), 5):
            del corpus[i]
        for i in rng.sample(sorted(corpus), 4):
            corpus[i] = text(rng)
        corpus |= {100 * (step + 1) + i: text(rng) for i in range(3)}
        same = lambda i: i in before and (before[i] or "") == (corpus[i] or "")
        changed = {i for i in corpus if not same(i)}
    index = L.compact(spark, path)
    assert index.version == 2 and {r.version for r in index.docs.collect()} == {2}
    assert L.integrity(index).collect() == []


def test_broken_refresh_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = L.refresh_index(spark.createDataFrame([(1, "apple"), (2, "cloud")], SCHEMA), path)
    want = rows_of(first)
    bad = spark.createDataFrame([(1, "apple"), (3, "glass")], SCHEMA).withColumn("text", F.when(F.col("doc_id") == 3, F.raise_error("lost")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        L.refresh_index(bad.withColumn("hash", F.col("doc_id")), path, hash_column="hash")
    assert rows_of(L.read_index(spark, path)) == want
    assert L.refresh_index(spark.createDataFrame([(1, "apple"), (3, "glass")], SCHEMA), path).version == 1


def test_repeated_keys_and_empty_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    twice = spark.createDataFrame([(1, "apple"), (1, "apple"), (1, "cloud glass"), (2, None)], SCHEMA)
    index = L.refresh_index(twice, path)
    assert index.n == 2 and L.integrity(index).collect() == []
    assert rows_of(L.refresh_index(twice, path)) == rows_of(index)
    gone = L.refresh_index(spark.createDataFrame([], SCHEMA), path)
    assert (gone.n, gone.tokens, gone.terms.count(), gone.postings.count()) == (0, 0, 0, 0)
