"""The near-duplicate stage against a brute-force grouping by Jaccard similarity of five-word shingles."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from corpusmill.llm import common, near_copies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)])


def brute_groups(texts):
    """id -> least id of its group; pairs are counted through an index of all shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root, held = {i: i for i in texts}, defaultdict(list)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in held[s]).items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in sets[i]:
            held[s].append(i)
    return {i: top(i) for i in texts}


def groups_of(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component for r in near_copies.near_copies(df).collect()}


def test_stage_on_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = common.table(spark, sf_dir, "documents")
    want = {i for i, c in brute_groups({r.doc_id: r.text for r in docs.collect()}).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == want


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return words


def test_groups_in_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    monkeypatch.setattr(near_copies, "TRIES", 3)
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    rng, texts = random.Random(3), []
    line = [f"l{i}" for i in range(12)]
    for size in (30, 120, 400):
        for _ in range(3):
            base = [f"w{rng.randrange(500)}" for _ in range(size)]
            texts += [edited(rng, base, rng.randrange(size // 12 + 1)) + line * rng.randrange(3) for _ in range(14)]
            chain = base
            for _ in range(6):
                chain = edited(rng, chain, max(1, size // 60))
                texts.append(chain)
    rng.shuffle(texts)
    rows = {i: " ".join(t) for i, t in enumerate(texts)} | {900: "", 901: None, 902: "one two", 903: "ONE  two", 904: "one"}
    want = brute_groups(rows)
    sizes = Counter(want.values())
    assert max(sizes.values()) > 7 and sum(n == 1 for n in sizes.values()) > 5
    assert groups_of(spark, rows) == want


def test_sketch_and_prefix_lose_no_pair():
    rng = random.Random(5)
    none = np.empty(0, "u8")
    for n in (1, 2, 9, 50, 700):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], "u8"))
        for _ in range(40):
            kept = a[np.array([rng.random() > 0.12 for _ in range(len(a))], bool)]
            b = np.unique(np.concatenate([kept, np.array([rng.getrandbits(64) for _ in range(rng.randrange(1 + n // 9))], "u8")]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 5 * both < 4 * (len(a) + len(b) - both):
                continue
            assert set(near_copies.prefix_of(a, none).tolist()) & set(near_copies.prefix_of(b, none).tolist())
            sketches = [np.frombuffer(near_copies.sketch_of(x), "u8") for x in (a, b)]
            assert 9 * np.bitwise_count(sketches[0] ^ sketches[1]).sum() <= len(a) + len(b)
            assert near_copies.may_be_near(len(a), near_copies.wide_of(a), len(b), near_copies.wide_of(b))


def test_simhash_links_come_first_and_the_rounds_find_the_rest(spark, monkeypatch):
    """Texts within 3 bits are tried as such; near copies further apart are found all the same."""
    rng = random.Random(9)
    rows, found, tried = {}, near_copies._by_fingerprint, []
    for g in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows |= {100 * g + i: " ".join(base[: len(base) - i]) for i in range(3)}
        rows |= {100 * g + 10 + i: " ".join(edited(rng, base, 8)) for i in range(3)}

    def watched(prints):
        pairs = found(prints)
        tried.extend((r.a, r.b) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(near_copies, "_by_fingerprint", watched)
    want = brute_groups(rows)
    assert groups_of(spark, rows) == want
    fps = {i: near_copies.fingerprint(t.encode()) for i, t in rows.items()}
    node = {i: near_copies.node_of(near_copies.shingle_set(t.encode())) for i, t in rows.items()}
    close = {tuple(sorted((node[i], node[j]))) for i in rows for j in rows if i < j and (fps[i] ^ fps[j]).bit_count() <= 3}
    apart = [1 for i in rows for j in rows if i < j and want[i] == want[j] and (fps[i] ^ fps[j]).bit_count() > 3]
    assert close and apart and {n for pair in close for n in pair} == {n for pair in tried for n in pair}


def test_golay_table_takes_little_memory():
    tracemalloc.start()
    try:
        assert simhash.segment_keys().shape == (1 << 16, 6)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()
