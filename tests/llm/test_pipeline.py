"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from corpusmill.llm import bpe, common, decontaminate, toxicity

from test_near_copies import brute_groups

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = common.table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_toxic_rows_go(spark, sf_dir, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, common.table(spark, sf_dir, "labels"))
    want = {r.doc_id for r in toxicity.score(before, model).collect() if not r.predicted}
    assert set(by_id(after)) == want and len(want) > 0.7 * before.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    groups = brute_groups({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))


def test_rows_that_share_an_id(spark, sf_dir):
    """Different texts of one id both stay, copies of a text don't, with or without ids."""
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one, "en", "s", 1), (5, other, "en", "s", 1), (7, one + " c", "en", "s", 1), (None, other, "en", "s", 1), (None, "x y", "en", "s", 1), (None, "x y", "en", "s", 1), (8, None, "b", "s", 0), (8, None, "a", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, one, "en", "s", 1), (5, other, "en", "s", 1), (8, None, "a", "s", 0), (None, "x y", "en", "s", 1)], key=str)


def test_leaks_go(spark, sf_dir, stages):
    _, before, after = stages[2]
    items = [decontaminate.normal(r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    held = {i for i, r in by_id(before).items() if any(p in decontaminate.normal(r.text) for p in items)}
    assert held.isdisjoint(by_id(after)) and set(by_id(after)) | held == set(by_id(before))


def test_secrets_are_masked(stages):
    _, before, after = stages[3]
    old, new = by_id(before), by_id(after)
    assert set(old) == set(new)
    hexes = re.compile("[0-9a-f]{32,}")
    for i, r in new.items():
        assert not hexes.search(r.text) and r.n_chars == len(r.text)
        if not hexes.search(old[i].text) and "token" not in old[i].text:
            assert r.text == old[i].text


def test_tokens_round_trip(stages):
    _, before, after = stages[4]
    codec = bpe.codec(*bpe.default_vocabulary())
    texts = by_id(before)
    for i, r in by_id(after).items():
        assert r.decoded_sha256 == hashlib.sha256(texts[i].text.encode()).hexdigest()
        assert r.ids == codec.encode(texts[i].text).tolist() and r.n_tokens == len(r.ids)


def test_odd_rows(spark, sf_dir):
    rows = [(None, "x y z", None, None, None), (1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).count() >= 3


def test_very_long_text(spark, sf_dir):
    """A text of a million characters goes through every stage whole."""
    text = " ".join(f"wort{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text, "de", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert [r.text for r in stage(spark, docs, sf_dir).collect()] == [text]
    (row,) = corpus_pipeline.tokenize(spark, docs, sf_dir).collect()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
