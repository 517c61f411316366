"""Braces, globs and dead references against loops."""

import random
import re

from corpusmill.operators import globs


def loop_expand(pattern):
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for a in m.group(1).split(",") for x in loop_expand(pattern[: m.start()] + a + pattern[m.end() :])]


def loop_match(glob, path):
    out, i = "", 0
    while i < len(glob):
        for token, expr in (("**/", "(?:[^/]+/)*"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(token, i):
                out, i = out + expr, i + len(token)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.fullmatch(out, path) is not None


PATTERNS = ["src/**/*.{ts,tsx}", "{a,b}/{c,{d,e}}/f?", "{open", "close}", "{}", "a{,b}c", "plain.txt", r"we+ird(1)\E.py", "**", "*.md", "x**/foo/*", "**/foo", "foo/**", None, "{a{b}"]
PATHS = ["src/a.ts", "src/x/y/b.tsx", "a/c/f1", "b/e/f2", "b/d/f", "ac", "abc", "plain.txt", r"we+ird(1)\E.py", "README.md", "docs/README.md", "xfoo/b", "x/foo/b", "x/y/foo/c", "foo", "z/foo", "foo/", "foo/a/b", None, "{open"]


def random_cases(rng):
    part = lambda: "".join(rng.choice("ab.") for _ in range(rng.randrange(1, 4)))
    paths = ["/".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    token = lambda: rng.choice(["a", "b", ".", "/", "*", "?", "**", "**/", "/", "{a,b}", "{a,{b,}}"])
    return paths, ["".join(token() for _ in range(rng.randrange(1, 8))) for _ in range(150)]


def test_expansion_and_matches_against_loops(spark):
    paths, patterns = random_cases(random.Random(1))
    paths, patterns = paths + PATHS, patterns + PATTERNS
    rows = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    every = globs.expanded(rows)
    got = sorted((r.pattern, r.glob) for r in every.collect())
    assert got == sorted((p, g) for p in patterns if p is not None for g in loop_expand(p))
    found = globs.glob_matches(every.select("glob"), spark.createDataFrame([(p,) for p in paths], "path string"))
    want = {(g, p) for _, g in got for p in paths if p is not None and loop_match(g, p)}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 200


def test_dead_globs(spark):
    rules = [(1, p) for p in PATTERNS] + [(2, "nowhere/**"), (2, "{nowhere,foo}/**"), (2, "nowhere/**")]
    got = globs.dead_globs(spark.createDataFrame(rules, "file long, pattern string"), spark.createDataFrame([(p,) for p in PATHS], "path string"))
    want = {(f, p) for f, p in rules if p is not None and not any(loop_match(g, x) for g in loop_expand(p) for x in PATHS if x is not None)}
    assert {tuple(r) for r in got.collect()} == want and (2, "nowhere/**") in want


def test_dead_references(spark):
    texts = [
        ("r1", "see `src/a.py`, `src/gone.py:12`, `a.py`, `lost.py` and `core.run`, `core.stop()`, `twice.x`, `nowhere.y`; `not a ref` `core.LIMIT`"),
        ("r2", "again `src/gone.py:12` and `src/gone.py:12`; `pkg.core.Walker` ``"), ("r3", None), ("r4", ""),
    ]
    paths = ["src/a.py", "pkg/core.py", "one/twice.py", "two/twice.py", None]
    sources = [("pkg/core.py", "import x\n  def run(a):\n    pass\nclass Walker:\n  pass\nLIMIT = 3\nstopped = 1\n")]
    got = globs.dead_references(
        spark.createDataFrame(texts, "file string, text string"), spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(sources, "path string, text string")
    )
    assert {tuple(r) for r in got.collect()} == {
        ("r1", "src/gone.py:12", "path"), ("r1", "lost.py", "path"), ("r1", "core.stop()", "symbol"), ("r2", "src/gone.py:12", "path"),
    }
