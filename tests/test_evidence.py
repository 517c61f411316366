"""Evidence fences, what diffs leave and drift against loops."""

import random
import re

from corpusmill.operators import evidence as E

FENCE = re.compile(r"^(?P<f>```+|~~~+)([^\n]*)\n(.*?)^(?P=f)[^\n]*$", re.M | re.S)


def post_image(content):
    lines = [x for x in content.split("\n") if x and not x.startswith(("diff --git", "index ", "--- ", "+++ ", "@@"))]
    if not lines or not any(x[0] in "+-" for x in lines) or not all(x[0] in "+- " for x in lines):
        return None
    return "\n".join(x[1:] for x in lines if x[0] in "+ ").strip("\n") or None


def flat(text):
    lines = [re.sub(r"\s+", " ", x, flags=re.A).strip(" ") for x in text.split("\n")]
    return "\n".join(x for x in lines if x)


def level(content, text):
    if not text:
        return "missing"
    tries = [c for c in (content.strip("\n"), post_image(content)) if c]
    if any(c in text for c in tries):
        return "exact"
    return "whitespace" if any(flat(c) and flat(c) in flat(text) for c in tries) else "missing"


def fences(text):
    out = []
    for m in FENCE.finditer(text or ""):
        if found := re.search(E.MARKER, m[2]):
            out.append((found[1], int(found[2]), int(found[3]), m[3].removesuffix("\n")))
    return out[: E.MOST_BLOCKS]


def block(path, content, fence="```"):
    return f"{fence}py evidence: {path}:1-9\n{content}\n{fence}\n"


FILES = [("a/one.py", "def f():\n    return 1\n\nx = 2\n"), ("b.txt", "plain   text\nof lines\n"), ("empty", ""), ("null", None), (None, "x")]
TEXTS = [
    None, "", "no fence evidence: a/one.py:1-2", block("a/one.py", "def f():\n    return 1"), block("a/one.py", "def f():\n  return  1"), block("a/one.py", "gone"),
    block("a/one.py", "@@ -1 +1 @@\n def f():\n-    return 0\n+    return 1"), block("b.txt", "plain text\n\n of lines"), block("none", "x"), block("empty", "x"), block("null", "x"),
    "````md evidence: b.txt:1-2\n```\nof lines\n```\n````\n", "```py evidence: b.txt:1-2\nnever closed", "  " + block("b.txt", "x"), block("b.txt", ""),
    "```\n" + "unmarked\n```\n" + block("b.txt", "of lines") + block("a/one.py", "gone") + block("none", "y") + block("b.txt", "zzz", "~~~~"),
    "".join(block(f"p{i % 7}", "q") for i in range(30)),
]


def test_drift_against_loops(spark):
    rng = random.Random(6)
    lines = ["def f():", "    return 1", "+added", "-gone", " kept", "@@ x", "", "plain text", "```", "~~~ more", "of  lines"]
    texts = TEXTS + ["".join(block(rng.choice(["a/one.py", "b.txt"]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(4)))) for _ in range(3)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, content string")
    files = spark.createDataFrame(FILES, "path string, text string")
    found = {}
    for r in E.evidence_fences(df).orderBy("doc_id", "place").collect():
        found.setdefault(r.doc_id, []).append((r.path, r.start, r.end, r.content))
    assert found == {i: f for i, t in enumerate(texts) if (f := fences(t))}
    by_path, want = {p: t for p, t in FILES if p}, {}
    for i, t in enumerate(texts):
        levels = [(level(c, by_path.get(p)), p) for p, _, _, c in fences(t)]
        if gone := sorted({p for x, p in levels if x == "missing"}):
            want[i] = (len(levels), sum(x == "missing" for x, _ in levels), sum(x == "whitespace" for x, _ in levels), ",".join(gone[:4]))
    assert {r.doc_id: tuple(r)[1:] for r in E.evidence_drift(df, files).collect()} == want and len(want) > 30
    images = spark.createDataFrame([(c,) for c in ("a\nb", "+a\n-b\n c", "--- x\n+++ y\n+a", "-a", "", "+a\nb", "+\n+a\n+")], "c string")
    assert [r.p for r in images.select(E.diff_post_image(images.c).alias("p")).collect()] == [post_image(r.c) for r in images.collect()]
