from corpusmill.sources import corpus
from corpusmill.streaming import ledger as stream
from pyspark.sql import Window as W, functions as F

DOC = '---\nname: "a b"\ndescription: has: colons\nmetadata:\n  confidence: Draft\nname: again\n---\n# Head\nbody'


def test_documents_and_frontmatter(spark, tmp_path):
    (tmp_path / "one.md").write_text(DOC)
    (tmp_path / "two.md").write_text("---\nname: open\nno end")
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "three.txt").write_text("x")
    df = corpus.scan_documents(spark, str(tmp_path))
    rows = {r.name: r for r in df.select("name", corpus.fields(F.col("text")).alias("f"), corpus.body(F.col("text")).alias("b")).collect()}
    assert set(rows) == {"one", "two"}
    assert rows["one"].f == {"name": "a b", "description": "has: colons", "confidence": "Draft"}
    assert rows["one"].b == "# Head\nbody"
    assert rows["two"].f == {} and rows["two"].b.startswith("---")


def test_enums(spark):
    df = spark.createDataFrame([(" PIN ", "Draft"), ("pins", "other"), (None, None)], "s string, c string")
    got = [tuple(r) for r in df.select(corpus.steer(F.col("s")), corpus.confidence(F.col("c"))).collect()]
    assert got == [("pin", "draft"), (None, None), (None, None)]


def test_ledger_skips_bad_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"ts": 1.5, "session_id": "s", "names": ["a"]}\n{"ts": broken\n[1, 2]\n\n{"ts": 2}\n')
    got = corpus.read_ledger(spark, str(tmp_path)).select("ts", "session_id", "names").orderBy("ts").collect()
    assert [tuple(r) for r in got] == [(1.5, "s", ["a"]), (2.0, None, None)]


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folded = stream.usage_fold(stream.event_stream(spark, sf_dir))
    stream.run_available(folded, "update", str(tmp_path / "c1"), str(tmp_path / "o1"))
    out = spark.read.parquet(str(tmp_path / "o1"))
    last = out.withColumn("n", F.row_number().over(W.partitionBy("item").orderBy(F.desc("batch")))).where("n = 1")
    got = {r.item: r.transitions for r in last.collect()}
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    keyed = events.select("ts", "event_id", F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("item"), session.alias("s"))
    order = W.partitionBy("item").orderBy("ts", "event_id")
    want = keyed.withColumn("new", (~F.col("s").eqNullSafe(F.lag("s").over(order))).cast("int")).groupBy("item").agg(F.sum("new").alias("n"))
    assert got == {r["item"]: r["n"] for r in want.collect()}

    hours = stream.hourly_volumes(stream.event_stream(spark, sf_dir))
    stream.run_available(hours, "append", str(tmp_path / "c2"), str(tmp_path / "o2"))
    rows = spark.read.parquet(str(tmp_path / "o2")).agg(F.sum("n")).first()[0]
    late = events.agg(F.max("ts")).first()[0]
    assert 0 < rows <= events.count() and late is not None


def test_every_ledger_comes_back_from_its_lines(spark, tmp_path):
    for name, schema in corpus.LEDGERS.items():
        rows = spark.createDataFrame([], schema)
        full = [tuple({"double": 1.5, "string": "x", "bigint": 3, "boolean": True, "array<string>": ["a", "b"], "map<string,string>": {"k": "v"}, "map<string,bigint>": {"k": 2}, "map<string,double>": {"k": 0.5}}[t] for _, t in rows.dtypes)]
        df = spark.createDataFrame(full + [(None,) * len(rows.dtypes)], schema)
        path = tmp_path / f"{name}.jsonl"
        path.write_text("\n".join([r.value for r in corpus.ledger_lines(df).collect()] + ["[1]", "{broken", ""]))
        assert sorted(map(str, corpus.read_ledger(spark, str(path), schema).collect())) == sorted(map(str, df.collect()))


def test_committed_usage_sums_over_files(spark):
    rows = spark.createDataFrame([(["a", "b"], {"a": 2}), (["b"], {"a": 1, "c": 4}), (None, None)], corpus.LEDGERS["usage"])
    assert {(r.name, r.sessions) for r in corpus.committed_usage(rows).collect()} == {("a", 3), ("b", 0), ("c", 4)}
