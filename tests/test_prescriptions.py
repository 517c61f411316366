"""Prescriptive spans and their grounds against a loop."""

import random
import re

from corpusmill.operators import prescriptions as P

FENCE = re.compile(r"^(```+|~~~+)[^\n]*\n(.*?)^\1[^\n]*$", re.M | re.S)


def loop_spans(text):
    prose = FENCE.sub("\n", text or "")
    out = {}
    for m in re.finditer(P.SPAN, prose):
        if re.search(P._GUARD, prose[max(0, m.start() - P.BEFORE) : m.start()]) or re.match(P._CONTRAST.lstrip("^"), prose[m.end() : m.end() + P.BEHIND]):
            continue
        start = max(prose.rfind(".", 0, m.start()), prose.rfind("\n", 0, m.start())) + 1
        ends = [e for e in (prose.find(".", m.start()), prose.find("\n", m.start())) if e >= 0]
        out.setdefault(m.group().lower(), (m.start(), m.group(), prose[start : min(ends, default=len(prose))]))
    return set(out.values())


def loop_class(text):
    spans, fenced = loop_spans(text), "\n".join(m[2] for m in FENCE.finditer(text or "")).lower()
    reason = re.search(P._RATIONALE, text or "") is not None
    words = lambda s: {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]{2,}", s)} - set(P.SCAFFOLD)
    bad = [s for s in spans if not reason and not any(w in fenced for w in words(s[2]))]
    return len(spans), len(bad), "observation" if not spans else "ungrounded" if bad else "grounded"


CASES = [
    None, "", "The user wants tabs.", "Ask whether the user wants tabs.", "the owner prefers rebase, not merge", "the owner prefers small, quick commits",
    "If it helps. The team always wants linear history.\n```\ngit history --linear\n```\nend", "```\nthe user wants x\n```", "```\nunclosed the user wants x",
    "Rationale: asked for\nThe author  never\nlikes surprises.", "The user wants tabs. THE USER WANTS tabs. the reviewer doesn't want noise", "the user wanted tabs; the users want",
    "when the maintainer insists on it", "é" * 60 + " the developer is annoyed by flaky tests. " + "x" * 5000 + " the developer cares about values",
    "the team usually cares about speed", "should the team expects",
]


def test_spans_and_classes_against_loops(spark):
    rng = random.Random(4)
    bits = ["the user wants", "The owner always prefers", "the team expects", " if ", " whether so ", ", not that", ".", "\n", " speed ", " tabs ", "```\nspeed run\n```\n", "\n```\n", " quick things", "Rationale: yes\n"]
    texts = CASES + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(250)] + ["the user wants speed " * 3000]
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, span string, start int")
    got = {}
    for r in P.prescriptive_spans(df).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.span, r.sentence))
    assert got == {i: s for i, t in enumerate(texts) if (s := loop_spans(t))}
    classes = {r.doc_id: (r.n_spans, r.n_ungrounded, r.kind) for r in P.classified(df).collect()}
    assert classes == {i: loop_class(t) for i, t in enumerate(texts)}
    assert {c[2] for c in classes.values()} == {"observation", "grounded", "ungrounded"}
    assert P.classified(df.limit(0)).collect() == []


def test_query_reads_no_condition_from_a_documents_own_end(spark, tmp_path):
    rows = [(i, f"some words {end}", lang, "src1") for lang in ("en", "fr", "de", "es") for i, end in enumerate(("when done.", "if", "end"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("row_number() OVER (ORDER BY lang, doc_id) AS doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.kind): (r.n, r.spans) for r in P.prescription_classes(spark, str(tmp_path)).collect()}
    assert got == {("en", "ungrounded"): (3, 3), ("fr", "grounded"): (3, 3), ("de", "observation"): (3, 0), ("es", "observation"): (3, 0)}
