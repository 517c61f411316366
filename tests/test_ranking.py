import random

from pyspark.sql import functions as F

from corpusmill.operators import composite, evaluation, graph, ranking, similarity, temporal


def test_knee_against_a_loop(spark):
    random.seed(4)
    rows, want = [], []
    for q in range(60):
        last, out = None, True
        for rank in range(1, random.randint(2, 9)):
            rel = random.choice([None, 0.1, 0.3, 0.5, 0.8, 1.0])
            rows.append((q, rank, rel))
            if out and rel is not None and last is not None and rel < 0.5 * last:
                out = False
            if out:
                want.append((q, rank))
                last = rel if rel is not None else last
    df = spark.createDataFrame(rows, "q int, rank int, relevance double")
    assert sorted((r.q, r["rank"]) for r in ranking.knee(df, "q").collect()) == sorted(want)


def test_fusion_ties_keep_the_first_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, k int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2)], "q int, k int, rank int")
    got = ranking.reciprocal_ranks([(a, 1.0), (b, 1.0)], "q", "k").orderBy("rank").collect()
    assert [r.k for r in got] == [10, 12, 11, 13]


def test_mmr_spreads_and_keeps_rows_without_vectors(spark):
    rows = [(1, 1, 1, 1.0, [1.0, 0.0]), (1, 2, 2, 0.99, [1.0, 0.0]), (1, 3, 3, 0.5, None), (1, 4, 4, 0.9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "q int, k int, rank int, score double, vector array<double>")
    got = {r.k: r.mmr_rank for r in ranking.mmr(df, "q", "k").collect()}
    assert got == {1: 1, 4: 2, 3: 3, 2: 4}


def test_sign_test():
    assert evaluation.sign_test_p(0, 0) == 1.0
    assert abs(evaluation.sign_test_p(5, 0) - 1 / 32) < 1e-12


def test_jaccard_pairs_lose_none(spark):
    random.seed(6)
    base = [set(random.sample(range(60), random.randint(4, 20))) for _ in range(25)]
    sets = base + [s ^ {random.randrange(60)} for s in base]
    rows = sorted({tuple(sorted(f"t{x:03}" for x in s)) for s in sets if len(s) >= 4})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(rows)], "rep int, set array<string>")
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(df, 0.8).collect()}
    want = {
        (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if len(set(rows[i]) & set(rows[j])) / len(set(rows[i]) | set(rows[j])) >= 0.8 - 1e-9
    }
    assert got == want


def test_ambiguous_alias_names_nothing(spark):
    claims = spark.createDataFrame([("x", 1, 1), ("x", 2, 1), ("y", 3, 0), ("y", 4, 1)], "alias string, node int, tier int")
    targets = spark.createDataFrame([("x",), ("y",), ("z",)], "alias string")
    got = {r.alias: (r.node, r.n_claimants) for r in graph.resolve_aliases(claims, targets).collect()}
    assert got == {"x": (None, 2), "y": (3, 1), "z": (None, 0)}


def test_drift_needs_both_times(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 20), (3, "a", None), (4, "b", 1)], "k int, item string, baseline int")
    changes = spark.createDataFrame([("a", 10), ("a", 7)], "item string, changed_at int")
    assert [tuple(r) for r in temporal.stale(rows, changes, "k", "item").collect()] == [(1, 1, 10)]


def test_expiry_states(spark):
    df = spark.createDataFrame([("2024-01-20",), ("2023-01-01",), ("2024-03-01",), (None,)], "d string")
    state = temporal.expiry_state(F.to_date("d"), F.to_date(F.lit("2024-02-01")))
    assert [r[0] for r in df.select(state).collect()] == ["recent", "old", None, None]


def test_leaders_against_a_loop(spark):
    random.seed(8)
    for n in (0, 1, 30, 60):
        pairs = {(a, b): round(random.random(), 2) for a in range(n) for b in range(a + 1, n) if random.random() < 0.12}
        want = {}
        for b in range(n):
            near = [(pairs[a, b], -a) for a in range(b) if (a, b) in pairs and want[a] == a]
            want[b] = -max(near)[1] if near else b
        df = spark.createDataFrame([(a, b, j) for (a, b), j in pairs.items()], "a long, b long, jaccard double")
        items = spark.createDataFrame([(i,) for i in range(n)], "item long")
        assert {r["item"]: r.seed for r in composite.leaders(df, items).collect()} == want


def test_judgements_are_whole_passages(spark, tmp_path):
    texts = ["xx Some passage of text, here yy", "some passage of text, here", "Some passage of text, there", "ab", "zabz"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "me passage of text, here"), (2, "ab"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.item_id, r.doc_id) for r in evaluation._qrels(spark, str(tmp_path)).collect()} == {(1, 0), (1, 1), (2, 3), (2, 4)}


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(ranking, "BLOCK", 40)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)], i % 3) for i in range(150)]
    rows += [(150 + i, [1.0, 2.0, 0.0, 0.5], 1) for i in range(60)]  # copies: ties go to the lower id
    rows += [(300, [0.0] * 4, 2), (301, [1.0, 0.0], 1), (302, [0.0, 3.0], None), (303, None, 1), (304, [1.0, None, 0.0, 0.0], 1), (None, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = df.where("vec_id % 5 = 0 OR vec_id > 299")
    unit = {}
    for i, e, label in rows:
        if i is not None and e is not None and None not in e:
            norm = sum(x * x for x in e) ** 0.5
            unit[i] = [x / (norm or 1.0) for x in e], label
    pairs = {}
    for a in [i for i in unit if i % 5 == 0 or i > 299]:
        near = [(round(sum(x * y for x, y in zip(unit[a][0], v)), 9), i, label) for i, (v, label) in unit.items() if i != a and len(v) == len(unit[a][0])]
        if near:
            pairs[a] = sorted(near, key=lambda x: (-x[0], x[1]))
    got = {(r.query_id, r["rank"]): r.vec_id for r in ranking.nearest(df, q, 7).collect()}
    assert got == {(a, n): i for a, near in pairs.items() for n, (_, i, _) in enumerate(near[:7], 1)}
    counts = {(r.query_id, r.floor): r.n for r in ranking.floor_counts(df, q, [0.0, 0.5, 1.0]).collect()}
    assert counts == {(a, f): sum(s >= f for s, _, _ in near) for a, near in pairs.items() for f in (0.0, 0.5, 1.0)}
    best = {r.query_id: (r.on_topic, r.off_topic) for r in ranking.best_by_label(df, q).collect()}
    of = lambda a, same: max((s for s, _, l in pairs[a] if l is not None and unit[a][1] is not None and (l == unit[a][1]) == same), default=None)
    assert best == {a: (of(a, True), of(a, False)) for a in pairs}


def test_lexical_best_equal_all_scores(spark, monkeypatch):
    from pyspark.sql import Window as W

    from corpusmill.operators import retrieval

    random.seed(3)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 5)
    words = [f"w{i}x" for i in range(30)]
    text = lambda: " ".join(words[int(random.random() ** 2 * 30)] for _ in range(random.randint(0, 12)))
    rows = [(i, text(), "ab"[i % 2]) for i in range(120)] + [(200 + i, "w1x w2x w3x", "a") for i in range(9)] + [(300, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    queries = spark.createDataFrame([(i, text()) for i in range(12)] + [(20, ""), (21, "w1x w2x w2x")], "item_id long, text string")
    scored = retrieval.bm25_scores(docs, queries).join(docs.select("doc_id", "lang"), "doc_id").cache()
    rows_of = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())
    assert rows_of(retrieval.bm25_top(docs, queries, 4)) == rows_of(retrieval.top_k(scored, 4))
    raised = scored.withColumn("score", F.col("score") * F.when(F.col("lang") == "a", 1.1).otherwise(1.0))
    assert rows_of(retrieval.bm25_top(docs, queries, 4, factor=F.when(F.col("lang") == "a", 1.1).otherwise(1.0))) == rows_of(retrieval.top_k(raised, 4))
    order = W.partitionBy("item_id", "lang").orderBy(F.desc(F.round("score", 9)), "doc_id")
    parts = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    assert rows_of(retrieval.bm25_top(docs, queries, 3, part=F.col("lang"))) == rows_of(parts)
    every = retrieval.bm25_top(docs, queries, None, among=docs.where("doc_id > 60"), shared=2)
    terms = retrieval.postings(docs).join(retrieval.postings(queries, "item_id").select("item_id", "term"), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("terms"))
    want = scored.where("doc_id > 60").join(terms.where("terms >= 2"), ["item_id", "doc_id"])
    got = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 6), r.terms) for r in df.collect())
    assert got(every) == got(want)


def test_lexical_best_in_small_blocks_and_from_term_rows(spark, monkeypatch):
    from corpusmill.operators import retrieval

    random.seed(5)
    words = [f"w{i}x" for i in range(20)]
    text = lambda: " ".join(random.choice(words) for _ in range(random.randint(0, 15)))
    docs = spark.createDataFrame([(f"d{i:03}", text(), "ab"[i % 2]) for i in range(150)] + [("d999", None, None), (None, "w1x", "a")], "doc_id string, text string, lang string")
    queries = spark.createDataFrame([(i, text()) for i in range(9)], "item_id long, text string")
    raised = F.when(F.col("lang") == "a", 1.1).when(F.col("lang") == "b", 0.7)
    rows_of = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 9), r.part, r.terms, r["rank"]) for r in df.collect())
    calls = [dict(k=4), dict(k=3, factor=raised, part=F.col("lang")), dict(k=2, shared=2), dict(k=4, factor=F.lit(-1.0))]
    whole = [rows_of(retrieval.bm25_top(docs, queries, **call)) for call in calls]
    monkeypatch.setattr(retrieval, "AT_ONCE", 50)
    monkeypatch.setattr(retrieval, "LEAST_SORTED", 1)
    ready = retrieval.term_rows(docs)
    assert "text" not in ready[0].columns
    assert [rows_of(retrieval.bm25_top(ready, queries, **call)) for call in calls] == whole
    scored = retrieval.bm25_scores(docs.where("doc_id IS NOT NULL").unionByName(docs.where("doc_id IS NULL").withColumn("doc_id", F.lit("none"))), queries)
    want = retrieval.top_k(scored.where("doc_id <> 'none'"), 4)
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in want.collect()) == [(i, d, n) for i, d, _, _, _, n in whole[0]]


def test_lexical_best_within_bounds_equal_all_scores(spark, monkeypatch):
    from corpusmill.operators import retrieval

    random.seed(9)
    words = [f"w{i}x" for i in range(300)]
    text = lambda n: " ".join(words[int(random.random() ** 3 * 300)] for _ in range(n))
    rows = [(i, text(random.choice([0, 3, 10, 40, 200]))) for i in range(400)] + [(500 + i, "w1x w2x w299x w299x w298x") for i in range(30)]
    rows += [(i, t) for i, t in rows[:20]] + [(600, None), (None, "w1x w7x"), (601, "w5x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(i, text(random.choice([1, 2, 12, 30]))) for i in range(60)] + [(i, t) for i, t in rows[400:425]] + [(None, "w9x w250x"), (70, ""), (71, "nothing known"), (72, "w0x"), (73, "w1x w1x w1x w290x")]
    queries = spark.createDataFrame(asked, "item_id long, text string")
    ready = retrieval.term_rows(docs)
    rows_of = lambda df: sorted(((r.item_id or 0, r["rank"], r.doc_id, round(r.score, 9), r.terms, r.part) for r in df.collect()), key=str)
    calls = [dict(k=1), dict(k=4, among=docs.where("doc_id % 2 = 0")), dict(k=40)]
    whole = [rows_of(retrieval.bm25_top(ready, queries, **call)) for call in calls]
    real, used = retrieval._bounded_scorer, []
    monkeypatch.setattr(retrieval, "_bounded_scorer", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(retrieval, "BOUNDED_FROM", 0)
    for call, want, (seeds, at_once, terms, least) in zip(calls, whole, ((20, 200_000, 1_000_000, 1), (1, 40, 1_000_000, 30), (0, 200_000, 300, 50_000))):
        for name, value in (("SEEDS", seeds), ("BOUNDED_AT_ONCE", at_once), ("BOUNDED_TERMS", terms), ("LEAST_SORTED", least), ("AT_ONCE", max(least, 30)), ("TOGETHER", at_once // 4)):
            monkeypatch.setattr(retrieval, name, value)
        assert rows_of(retrieval.bm25_top(ready, queries, **call)) == want
    assert len(used) > 6 and len(whole[1]) > 200


def test_rows_that_bounds_rule_out_are_not_found_by_common_terms():
    import types

    import numpy as np
    import pyarrow as pa

    from corpusmill.operators import retrieval

    queries = 200
    block = pa.table({"q": [i for i in range(queries) for _ in range(2)], "term": [x for i in range(queries) for x in (f"rare{i}", "common")], "w": [8.0, 0.1] * queries, "df": [2, 5_000] * queries, "top": [1.0] * 2 * queries})
    given = retrieval._by_query(block)
    reached = pa.table({"q": range(queries), "score": [5.0] * queries})
    needed = retrieval._needed(given, reached, 1)
    terms = given[1].to_pylist()
    starts, of, _, needs = needed[3][0][2]
    most = int(2.5 / retrieval.GRAIN)
    found = lambda term: int(np.searchsorted(needs, terms.index(term) * retrieval.SPAN + most, "right") - starts[terms.index(term)])
    assert found("common") == 0 and all(found(f"rare{i}") == 1 for i in range(queries))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1.0] * 3), pa.array([""] * 3), pa.array([["common"], ["rare7", "common"], ["rare7"] * 9])], names=["key", "factor", "part", "terms"])
    got = [r for b in retrieval._bounded_scorer(types.SimpleNamespace(value=(*needed, 4.0)), 1, 9)(iter([rows])) for r in b.to_pylist()]
    assert [(r["q"], r["key"], r["terms"]) for r in got] == [(7, 3, 1)]


def test_jaccard_pairs_in_blocks_and_few_of_them_with_their_sets(spark, monkeypatch):
    """Blocks of any size give the pairs of brute force, and sets go only where a pair is likely."""
    random.seed(16)
    sets = []
    for g in range(12):
        base = random.sample(range(40, 400), 40)
        sets += [frozenset(base) ^ set(random.sample(range(400), random.randint(1, 6))) for _ in range(10)]
        sets += [frozenset(random.sample(base, 25)) | set(random.sample(range(400), 15)) for _ in range(6)]
    rows = sorted({tuple(sorted(f"t{x:03}" for x in s)) for s in sets})
    want = {}
    for i, s in enumerate(rows):
        for j in range(i + 1, len(rows)):
            common = len(set(s) & set(rows[j]))
            if (value := round(common / (len(s) + len(rows[j]) - common), 6)) >= 0.8:
                want[i, j] = value
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(rows)], "rep bigint, set array<string>")
    counted, seen = similarity._counted, []
    monkeypatch.setattr(similarity, "_counted", lambda pairs, reps: seen.append(pairs.count()) or counted(pairs, reps))
    for frequent, block, cell, partners in ((200_000, 5_000, 1_000, 1_000), (50, 7, 4, 3), (0, 1_000, 1, 1)):
        for name, value in (("FREQUENT", frequent), ("TOKEN_BLOCK", block), ("CELL", cell), ("PARTNERS", partners)):
            monkeypatch.setattr(similarity, name, value)
        assert {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(df).collect()} == want
    assert max(seen) <= 2 * len(want)
