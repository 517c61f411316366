"""Succession replay against a loop."""

import random
from math import comb

from corpusmill.operators import succession as S


def test_replay_against_a_loop(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    chains = [("n0", "n1"), ("n1", "n2"), ("n3", "n4"), ("n5", "n6"), ("n7", "n8"), ("n7", "n8"), (None, "n9"), ("n11", None)]
    queries = [f"q{i}" for i in range(25)] + [" ", None, "q3 "]
    recalls = [(i, rng.choice(queries), rng.choice(names)) for i in range(260)] + [(999, "q1", None)]
    ranking = [(q, n, r) for q in {q.strip() for q in queries if q} for r, n in enumerate(rng.sample(names, 12), 1) if rng.random() < 0.8]
    harvest = S.harvested(spark.createDataFrame(recalls, "seq long, query string, name string"), spark.createDataFrame(chains, "old string, successor string"))
    got = S.replayed(harvest, spark.createDataFrame(ranking, "query string, name string, rank int"))
    place, want, counts = {(q, n): r for q, n, r in ranking if r <= 10}, set(), {}
    for old, new in {c for c in chains if None not in c}:
        seen = list(dict.fromkeys(q.strip() for _, q, n in recalls if n == old and q and q.strip()))[-10:]
        for q in seen:
            o, s = place.get((q, old)), place.get((q, new))
            verdict = "PASS" if s and (not o or s < o) else "FAIL" if o else "INCONCLUSIVE"
            want.add((old, new, q, o, s, verdict))
            counts.setdefault((old, new), []).append(verdict)
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) and {r.verdict for r in rows} == {"PASS", "FAIL", "INCONCLUSIVE"}
    for r in S.succession_summary(got).collect():
        v = counts[r.old, r.successor]
        n = v.count("PASS") + v.count("FAIL")
        assert (r.passed, r.failed, r.inconclusive) == tuple(v.count(x) for x in ("PASS", "FAIL", "INCONCLUSIVE"))
        assert abs(r.p - sum(comb(n, i) for i in range(r.passed, n + 1)) / 2**n) < 1e-6
    assert S.replayed(harvest.limit(0), spark.createDataFrame([], "query string, name string, rank int")).collect() == []
