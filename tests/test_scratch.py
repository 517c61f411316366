"""Scratch tables go at the end of their scope."""

import os
import subprocess
import sys
import textwrap

from corpusmill.operators import retrieval
from corpusmill.sources import scratch


def tables(spark):
    place = scratch.folder(spark).removeprefix("file://")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_scopes(spark, sf_dir):
    before = tables(spark)
    confs = dict(spark.sparkContext.getConf().getAll()), spark.conf.get(scratch.CLEANUP, None)
    with scratch.scope():
        outer = scratch.stored(spark.range(5))
        with scratch.scope():
            rows = retrieval.bm25_topk(spark, sf_dir).collect()
            assert rows and len(tables(spark)) > len(before) + 1
        assert tables(spark) - before == {os.path.basename(outer.stored_at)}
        assert outer.count() == 5
    assert tables(spark) == before
    assert dict(spark.sparkContext.getConf().getAll()) == confs[0] and spark.conf.get(scratch.CLEANUP, "false") == (confs[1] or "false")


def test_tables_go_with_the_driver(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        from corpusmill.sources.scratch import stored
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
        assert stored(spark.range(3)).count() == 3
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)
    assert os.listdir(tmp_path / "tables") == []
