"""Pairs that share groups, against brute force."""

import random
from collections import Counter
from itertools import combinations


def test_shared_pairs_in_many_tasks_and_blocks(spark, monkeypatch):
    from corpusmill.operators import graph

    random.seed(4)
    rows = [(random.randint(0, 12), random.randint(0, 40)) for _ in range(400)] + [(99, i) for i in range(30)] + [(None, 1), (None, 2), (3, None)]
    groups = {}
    for g, x in rows:
        if g is not None and x is not None:
            groups.setdefault(g, set()).add(x)
    want = Counter(p for xs in groups.values() for p in combinations(sorted(xs), 2))
    links = spark.createDataFrame(rows, "g long, x long")
    got = lambda: {(r.a, r.b): r.shared for r in graph.shared_pairs(links, "g", "x").collect()}
    assert got() == want
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(graph, "MEMBERS_AT_ONCE", 7)
    assert got() == want
    assert graph.shared_pairs(links.where("g < 0"), "g", "x").count() == 0
