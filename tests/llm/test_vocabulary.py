"""Collocations, spelling variants and language-model scores against brute force; redaction of spans that overlap."""

import math
import random
import re
import types
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import collocations, lm_scores, registry, secrets, spelling

DOCS = "doc_id long, text string, lang string, w1 string, n string, word string, row string, score string"


def frame(spark, rows):
    """Rows (id, text, lang) with columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, *"zzzzz") for r in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ODD = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "one", None), (None, "One two ONE two one TWO", "en"), (None, None, None), (5, "é漢 é漢; é漢\x0b.É漢\tx", "fr")]


# --- collocations ---


def brute_collocations(rows, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    for (lang, phrase), a in counts.items():
        if len(phrase) < 2 or a < 10:
            continue
        if len(phrase) == 2 and any(100 * n >= 50 * a and n >= 10 and len(p) == 3 and g == lang and phrase in (p[:2], p[1:]) for (g, p), n in counts.items()):
            continue
        cuts = [(1000000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return {
        (lang, i, p.decode(), -a, l, r, totals[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    }


@pytest.mark.parametrize("limits", [{}, {"BURST": 3, "SPILL": 40, "TOGETHER": 50, "BLOCK": 30, "WORDS": 70, "WORD_BITS": 8, "PAIR_BITS": 8}])
def test_collocations_against_brute_force(spark, monkeypatch, limits):
    rng = random.Random(9)
    words = ["the", "of", "New", "york", "CITY", "état", "x1", "a-b", "漢", "z"]
    line = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n"]) for _ in range(n))
    rows = ODD + [(i, line(60) + "new york city " * (i % 4), rng.choice(["en", "fr", None])) for i in range(6, 50)]
    # One long text of many different words, of which few are frequent.
    rows.append((99, " ".join(f"w{i % 90}" for i in range(400)) + " " + " ".join(f"once{i}" for i in range(300)), "en"))
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    got = {tuple(r) for r in collocations.collocations(frame(spark, rows)).collect()}
    assert got == brute_collocations(rows) and len(got) > 40
    few = {tuple(r) for r in collocations.collocations(frame(spark, rows), top=5).collect()}
    assert few == brute_collocations(rows, 5)


def test_collocations_query(spark, sf_dir):
    df = registry.QUERIES["op11_collocations"](spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.sql(registry.ORACLES["op11_collocations"])
    assert found.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_a_trie_bursts_and_spills_without_loss():
    rng = np.random.default_rng(4)
    trie, want, got = collocations.Trie(3), Counter(), Counter()
    for _ in range(60):
        packed = (rng.integers(3, 9, 400) << 42) | (rng.integers(3, 60, 400) << 21) | rng.integers(3, 60, 400)
        want.update(packed.tolist())
        trie.add(packed)
        if trie.entries > 5_000:
            for run, n in trie.spill(2_000):
                assert (np.diff(run) > 0).all() and len(set((run >> 42).tolist())) == 1
                got.update(dict(zip(run.tolist(), n.tolist())))
            assert trie.entries <= 2_000
    assert trie.burst or got
    for run, n in trie.spill(0):
        got.update(dict(zip(run.tolist(), n.tolist())))
    assert got == want and not trie.roots and not trie.sizes


def test_scores_past_64_bits(spark):
    big = 10**13
    rows = [(big, big, big), (big - 1, big, big + 7), (10, 10**14, 3 * 10**12), (3, 7, 5)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations.score_of("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [1000000 * a * a // (l * r) for a, l, r in rows]


# --- spelling ---


def brute_spelling(rows):
    n = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: b for w, xs in found.items() if xs and n[b := min(xs, key=lambda x: (-n[x], x))] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(found[w]), n.get(form.get(w))) for w in n}


def test_spelling_against_brute_force(spark):
    rng = random.Random(8)
    base = ["straßenbahn", "aaaaaaaa", "aabbaabb", "collection", "connection", "ÀéîöÿÀé", "governments", "abcdefg"]

    def damaged(w):
        at = rng.randrange(len(w) + 1)
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])

    def word():
        w = rng.choice(base)
        for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
            w = damaged(w)
        return w.upper() if rng.random() < 0.1 else w

    rows = [(r[0], r[1], r[2]) for r in ODD] + [(i, " ".join(word() for _ in range(60)) + "×÷×÷×÷×_short", "x") for i in range(10, 90)]
    # A chain: each form stands ten times as often as the last.
    rows += [(200, "qqqqqqqq " * 400 + "qqqqqqqr " * 30 + "qqqqqqrr " * 2, "x")]
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.vocabulary(frame(spark, rows))).collect()]
    want = brute_spelling(rows)
    assert set(got) == want and len(got) == len(want) > 100
    assert any(f is not None and f != r for _, f, r, *_ in want)
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).collect() == []


def test_spelling_query(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n_far = sorted(registry.QUERIES["op12_spelling"](spark, sf_dir).collect())
    words = {r.word: r.n for r in n_far}
    index = {}
    for w in words:
        for i in range(len(w)):
            index.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), ws in index.items():
        ws = ws | ({a + b} & set(words))
        for x in ws:
            near[x] |= {y for y in ws if y != x}
    assert {r.word: r.n_near for r in n_far} == {w: len(x) for w, x in near.items()}
    counted = Counter()
    for key, text in docs:
        counted.update(spelling.words_of(key, (text or "").encode()))
    assert words == {w: c for w, c in counted.items() if len(w) >= 7 and c >= 2}


def test_trie_nodes_are_prefixes():
    words = sorted({"".join(random.Random(i).choice("abé") for _ in range(7 + i % 9)) for i in range(400)})
    names = {}
    for (place, nodes), word in zip(spelling.trie_nodes(iter(words), 3), words):
        assert len(nodes) == len(word) + 1
        for depth, node in enumerate(nodes):
            assert names.setdefault(node, word[:depth]) == word[:depth]
    assert len(names) == len({w[:i] for w in words for i in range(len(w) + 1)})


# --- language model ---


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    model = lm_scores.Model(rng.integers(0, 1000, lm_scores.RANKS + 1).astype(float), vocabulary(), seed)
    model.weights["distance"] = rng.standard_normal(2 * lm_scores.HALF).astype("f4")
    return model


def slow_log10(model, words):
    """Of a text, piece by piece, each with a window of its own."""
    w = {k: v.astype("f8") for k, v in model.weights.items()}
    row = model.number[lm_scores.pieces(model.path).row(words)]
    half, total = lm_scores.HALF, 0.0
    for at in range(len(row) - 1):
        start = max(0, at // half * half - half)
        rows = w["pieces"][row[start : at + 1]] @ w["cast"]
        q, k, v, u = np.split(rows, lm_scores.PARTS, axis=1)
        s = k @ q[-1] / math.sqrt(lm_scores.HEAD_WIDTH) + w["distance"][np.arange(at - start, -1, -1)]
        a = np.exp(s - s.max())
        h = (a / a.sum()) @ v @ w["mix"] + u[-1] + w["shift"]
        h = h / (1 + np.abs(h))
        node, y = 0, int(row[at + 1])
        for level in range(lm_scores.LEVELS):
            x = h @ w[f"branch{level}"][node] + w[f"bias{level}"][node]
            down = y // lm_scores.FAN ** (lm_scores.LEVELS - 1 - level)
            p = np.exp(x - x.max())
            total += math.log10((p / p.sum())[down if level == 0 else down % lm_scores.FAN])
            node = down
    return total


@pytest.mark.parametrize("limits", [{}, {"BATCH": 3, "FEW": 2, "SAFE": 0}])
def test_windows_score_each_piece_once(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lm_scores, name, value)
    rng, model = random.Random(3), random_model()
    words = [b"the", b"ring", "é漢".encode(), b"x" * 300, b"on,", b"a"]
    texts = [[], [b"one"]] + [[rng.choice(words) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    got = lm_scores.Scorer(model).score(texts)
    assert np.allclose(got, [slow_log10(model, t) for t in texts], rtol=2e-5)
    assert lm_scores.Scorer(model).score([]).tolist() == []


def test_probabilities_sum_to_one():
    model = random_model()
    h = np.random.default_rng(2).uniform(-1, 1, (1, lm_scores.WIDTH)).astype("f4")
    scorer = lm_scores.Scorer(model)
    wanted = np.full((lm_scores.RANKS + 1, lm_scores.HALF), -1, "i4")
    wanted[:, 3] = np.arange(len(wanted))
    every = scorer._logs(np.repeat(h, wanted.size, axis=0), wanted)
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_gradients_by_differences():
    rng = np.random.default_rng(6)
    model = random_model()
    windows = rng.integers(0, lm_scores.RANKS, (3, 2 * lm_scores.HALF + 1)).astype("i4")
    windows[1, 9:] = -1
    apart = lm_scores.Trainer(model, 0.1).apart
    w = {k: v.astype("f8") for k, v in model.weights.items()}
    _, found = lm_scores.gradients(w, windows, apart)
    for name, g in found.items():
        at, e = int(np.abs(g).argmax()), 1e-5
        flat = w[name].ravel()
        old = flat[at]
        flat[at] = old + e
        up, _ = lm_scores.gradients(w, windows, apart)
        flat[at] = old - e
        down, _ = lm_scores.gradients(w, windows, apart)
        flat[at] = old
        assert abs((up - down) / (2 * e) - g.ravel()[at]) < 1e-5 + 1e-4 * abs(g.ravel()[at]), name


def held_out(key):
    return zlib.crc32(f"{'' if key is None else key}".encode()) % 7 == 2


def brute_base(rows):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]) for k, t, *_ in rows]
    counts = Counter(w for k, ws in words if not held_out(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(k, held_out(k), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in words]


@pytest.mark.parametrize("head", [200_000, 3])
def test_word_scores_of_odd_rows(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scores, "HEAD", head)
    monkeypatch.setattr(lm_scores, "MOST_STEPS", 3)
    rng = random.Random(5)
    rows = ODD + [(i, " ".join(rng.choice(["On", "the", "way", "é", "to", f"rare{i}"]) for _ in range(i % 30)), "en") for i in range(6, 60)]
    rows += [(70, "long text of many words " * 5000, "en"), (6, "again", "en")]
    df = frame(spark, rows)
    known = df.where(~lm_scores.folded("doc_id"))
    counts = lm_scores.stored(lm_scores.word_counts(known))
    model = lm_scores.train(known, counts, vocabulary())
    got = lm_scores.score(df, counts, model).collect()
    key = lambda r: tuple(str(x) for x in r[:5]) + (round(r[5], 6),)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute_base(rows)))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({round(r.score, 5) for r in got if r.n_tokens == 1}) == 1  # null, empty and blank texts are one text
    assert [c for c in got[0].__fields__] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_scores_without_training_rows(spark):
    none = frame(spark, [])
    counts = lm_scores.stored(lm_scores.word_counts(none))
    model = lm_scores.train(none, counts, vocabulary())
    assert lm_scores.score(none, counts, model).collect() == []
    r = lm_scores.score(frame(spark, ODD[:1]), counts, model).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_model_learns_an_order(monkeypatch):
    """Held-out texts of a made-up grammar become far likelier than by their words alone."""
    rng = random.Random(2)
    names, verbs = ["anna", "boris", "carla", "dmitri"], ["sees", "calls", "finds"]
    text = lambda: [w.encode() for _ in range(rng.randrange(3, 9)) for w in (rng.choice(names), rng.choice(verbs), "the", "house")]
    train, held = [text() for _ in range(300)], [text() for _ in range(40)]
    cut = lm_scores.pieces(vocabulary())
    counts = np.bincount(np.concatenate([cut.row(t) for t in train]), minlength=lm_scores.RANKS + 1).astype(float)
    model = lm_scores.Model(counts, vocabulary())
    before = lm_scores.Scorer(model).score(held).sum()
    windows = np.stack([x for i, t in enumerate(train) for x in lm_scores._windows(model, cut, t, 1, i)[1]])
    monkeypatch.setattr(lm_scores, "ROUNDS", 60)
    losses = lm_scores.start(model, windows)
    after = lm_scores.Scorer(model).score(held).sum()
    words = Counter(w for t in train for w in t + [None])
    base = sum(math.log10(words[w] / sum(words.values())) for t in held for w in t + [None])
    assert losses[-1] < losses[0] / 2 and after > before and after > 0.75 * base


# --- redaction ---


def test_no_character_of_a_span_survives(spark):
    weights = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(4)
    parts = ["AKIAIOSFODNN7TOKEN", "=abcdefgh12", "password = ", "hunter2hunter2", "0123456789abcdef" * 2 + "ff", "token:", "AKIA" + "Z9" * 8, ' secret="', "Xq7Rb2Lm9Zt4Kv8Wp3NmQ1", " plain words ", "é漢", "\n", "/path/to/thing_12"]
    texts = ["AKIAIOSFODNN7TOKEN=abcdefgh12", None, "", "token=AKIA" + "A1" * 10, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.secret_all for r in secrets.find(df, weights).collect()}
    got = {r.doc_id: r.text for r in secrets.redact(df, weights, mark="\x01").collect()}
    crossed = 0
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
            continue
        hidden = {j for x in spans[i] for j in range(x.start, x.end)}
        crossed += len(hidden) < sum(x.end - x.start for x in spans[i])
        want = "".join("\x01" if j in hidden else c for j, c in enumerate(text))
        assert re.sub("\x01+", "\x01", got[i]) == re.sub("\x01+", "\x01", want)
    assert crossed > 20 and got[0] == "\x01"


def test_no_vocabulary_file_in_the_repository():
    root = Path(__file__).resolve().parents[2]
    assert not [p for p in root.rglob("*.tiktoken")]


def test_every_piece_of_the_training_rows_is_learned_from(spark, monkeypatch):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "x" * 90, "été", "1234567890"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 11, 12, 13, 40, 200, 700)] + [None]
    model = random_model(3)
    cut = lm_scores.pieces(model.path)
    for text in texts:
        row = model.number[cut.row(lm_scores.words_of((text or "").encode()))]
        windows = lm_scores._all_windows(model, cut, lm_scores.words_of((text or "").encode()))
        nexts = windows[:, 1:].ravel()
        assert nexts[nexts >= 0].tolist() == row[1:].tolist() and windows.shape[1] == 2 * lm_scores.HALF + 1
        given = windows[:, :-1].ravel()
        assert given[given >= 0].tolist()[: len(row) - 1] == row[:-1].tolist()

    def counted(trainer, windows):
        # Weights that say how many pieces and windows a task was trained on.
        trainer.model.weights["shift"][0] += np.count_nonzero(windows[:, 1:] >= 0)
        trainer.model.weights["shift"][1] += len(windows)
        return 0.0

    monkeypatch.setattr(lm_scores.Trainer, "step", counted)
    monkeypatch.setattr(lm_scores, "WIDE", 3)
    model.weights["shift"] = np.zeros(lm_scores.WIDTH, "f4")
    seen = []
    broadcast = type("B", (), {"value": model, "unpersist": lambda self: None})()
    frame = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for t in texts], pa.binary())], names=["text"])

    class Rows:
        """A table of one batch that is gone through here."""

        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: broadcast)})()})()

        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, f, schema):
            return Rows(list(f(iter(self.batches))))

        def repartition(self, *columns):
            return self

        def collect(self):
            return [types.SimpleNamespace(**r) for b in self.batches for r in b.to_pylist()]

    monkeypatch.setattr(lm_scores, "_bodies", lambda df, text: df)
    at = sum(w.size for w in list(model.weights.values())[: list(model.weights).index("shift")])
    reached = lm_scores._everywhere(Rows([frame]), model, "text")
    want = sum(len(cut.row(lm_scores.words_of((t or "").encode()))) - 1 for t in texts)
    assert reached[at] == want and want > 2_000
