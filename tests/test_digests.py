"""Trees of digests: order doesn't count, every change does, and two are compared by going down."""

import random

from corpusmill.operators import digests

SCHEMA = "k long, d string, key string, n string"


def tree(spark, rows, fan=3, levels=3):
    rows = [(*r, "x", "y") for r in rows]
    random.Random(len(rows)).shuffle(rows)
    return digests.digest_tree(spark.createDataFrame(rows, SCHEMA), "k", "d", fan, levels)


def root(df, levels=3):
    found = df.where(df.level == levels + 1).collect()
    return (found[0].n, found[0].digest) if found else None


def test_trees(spark):
    rng = random.Random(6)
    # Keys below zero and past fan ** levels, repeated keys, missing digests, rows without a key.
    rows = [(rng.randrange(-40, 90), rng.choice("abc")) for _ in range(70)] + [(5, None), (5, None), (None, "a"), (2000, "z")]
    base = tree(spark, rows)
    assert root(base) == root(tree(spark, rows[::-1])) and root(base)[0] == len(rows) - 1
    sizes = base.where("level BETWEEN 1 AND 3").collect()
    assert len({(r.level, r.block) for r in sizes}) == len(sizes)
    for other in (rows[1:], rows + [(5, None)], rows + [(5, "a")], [(k, "q" if k == 2000 else d) for k, d in rows]):
        assert root(base) != root(tree(spark, other))
        a, b = {}, {}
        for known, part in ((a, rows), (b, other)):
            for k, d in part:
                if k is not None:
                    known.setdefault(k, []).append(d or "")
        want = {(k, "removed" if k not in a else "added" if k not in b else "changed") for k in a.keys() | b.keys() if sorted(a.get(k, [])) != sorted(b.get(k, []))}
        assert {tuple(r) for r in digests.differing(base, tree(spark, other), 3, 3).collect()} == want and want
    assert digests.differing(base, tree(spark, rows), 3, 3).collect() == []
    none = tree(spark, [])
    assert root(none) is None
    assert {r.change for r in digests.differing(base, none, 3, 3).collect()} == {"added"}
