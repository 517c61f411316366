"""The operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import bpe, common, decontaminate, html_text, licenses, media, registry, secrets, simhash, substrings, suffixes, token_counts, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r[0]: r[1] or "" for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- simhash ---


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_query(spark, sf_dir, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op1_simhash"](spark, sf_dir).collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    roots = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in docs}


def test_golay_code_and_keys():
    code = simhash.golay_codewords()
    far = np.bitwise_count((code[:64, None] ^ code[None, :]).astype("u8"))
    assert far[far > 0].min() == 7
    keys = [set(r[r >= 0].tolist()) for r in simhash.segment_keys()]
    assert {len(k) for k in keys} == {1, 6}
    assert all(keys[v] & keys[v ^ (1 << b)] for v in range(0, 1 << 16, 11) for b in range(16))


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype="u8")
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)

    def sets(x):
        out = defaultdict(set)
        for row, key in zip(*simhash.keys_of(x)):
            out[int(row)].add(int(key))
        return out

    ka, kb = sets(a), sets(b)
    assert all(ka[i] & kb[i] for i in range(len(a)))


def test_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = random.Random(1)
    prints = {rng.getrandbits(12) for _ in range(60)}
    keys = simhash.key_rows(spark.createDataFrame([(p,) for p in prints], "fp long"))
    roots = {r.node: r.root for r in simhash.components(simhash.links(keys)).collect()}
    want = brute_components({p: p for p in prints})
    assert {p: roots.get(p, p) for p in prints} == want


# --- toxicity ---


def brute_segments(v, at=0):
    best = None
    for i in range(len(v)):
        total = 0.0
        for j in range(i, len(v)):
            total += v[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j + 1)
    if best is None:
        return []
    _, i, j = best
    return brute_segments(v[:i], at) + [(at + i, at + j)] + brute_segments(v[j:], at + j)


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(150):
        v = [rng.choice([-1.3, -0.7, -0.25, 1.1, 2.17, -3.01]) + rng.random() * 0.01 for _ in range(rng.randint(1, 22))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(v))] == brute_segments(v)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.QUERIES["op2_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = Counter((labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels)
    assert seen[1, 1] / (seen[1, 1] + seen[1, 0]) > 0.85
    assert seen[0, 1] / (seen[0, 1] + seen[0, 0]) < 0.02


# --- decontamination ---


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i] + [0] * len(t)
        for j, d in enumerate(t, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_q_gram_filter_loses_none():
    rng = random.Random(5)
    alphabet = "abcdefgh "
    items = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(60, 160)))) for i in range(6)]
    passages = decontaminate.Passages(items)
    for _ in range(80):
        i, text = rng.choice(items)
        p = decontaminate.normal(text)
        q = list(p)
        for _ in range(rng.randint(0, int(len(p) * 0.14))):
            at = rng.randrange(len(q))
            q[at : at + rng.randint(0, 2)] = [rng.choice("abcdefgh")]
        t = decontaminate.normal("zz " * rng.randint(0, 30) + "".join(q) + " zz" * rng.randint(0, 30))
        far = edit_distance_inside(p, t)
        got = {x: e for x, e, _, _ in passages.matches([t])[0]}.get(i)
        budget = int(passages.edits[passages.ids.index(i)])
        assert got == (far if far <= budget else None)


def test_leaks_are_found_and_clean_rows_left(spark, sf_dir, docs):
    items = {r.item_id: decontaminate.normal(r.text) for r in common.table(spark, sf_dir, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in registry.QUERIES["op3_decontaminate"](spark, sf_dir).collect()}
    exact = {(d, i) for d, t in docs.items() for i, p in items.items() if p in decontaminate.normal(t)}
    assert exact <= set(got) and all(got[x] == 0 for x in exact)
    assert all(edit_distance_inside(items[i], decontaminate.normal(docs[d])) == e for (d, i), e in list(got.items())[:5])


# --- byte-level BPE ---


def test_bpe_equals_the_library(docs):
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(path, pattern)
    rng = random.Random(7)
    pool = list(ranks)
    texts = list(docs.values())[:120] + ["".join(rng.choice("aàbcédeñ漢字\U0001f642 \n\t19'-ßzт") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [b"".join(rng.choice(pool) for _ in range(rng.randint(1, 8))).decode("utf8", "ignore") for _ in range(800)]
    for t in [*texts, "ab" * 3000, " " * 700, "é" * 900]:
        ids = codec.encode(t)
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decoder.decode(ids) == t.encode()
        assert "".join(codec.decoder.stream(ids.tolist())) == t


def test_bpe_caches_of_the_query_have_room(docs, monkeypatch):
    """With more room the machine is made anew less often, and the ids are the same however often it is."""
    path, pattern = bpe.default_vocabulary()
    monkeypatch.setattr(bpe, "MAX_STATES", 300)
    monkeypatch.setattr(bpe, "MAX_PIECES", 50)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 100)
    texts, made, ids = list(docs.values())[:60], {}, {}
    for room in (1, bpe.ROOM):
        own, resets = bpe.Codec(path, pattern, room), []
        reset = own.machine._reset
        monkeypatch.setattr(own.machine, "_reset", lambda: (resets.append(1), reset()))
        ids[room] = [own.encode(t).tolist() for t in texts]
        made[room] = len(resets)
    assert ids[1] == ids[bpe.ROOM] and 0 < made[bpe.ROOM] < made[1]


def test_utf8_machine_equals_the_codec():
    for a in range(256):
        for b in range(0, 256, 5):
            data = bytes((a, b))
            state = bpe.utf8_step(bpe.utf8_step("0", a), b)
            try:
                data.decode()
                whole = True
            except UnicodeDecodeError:
                whole = False
            assert (state == "0") == whole


# --- HTML ---


def test_articles_of_pages(spark, sf_dir):
    import html as H

    pages = {r.page_id: r.html for r in common.table(spark, sf_dir, "pages").collect()}
    for r in registry.QUERIES["op5_html"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = (" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_what_stands_around_goes():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies to make
      this site work for you and for us and for all</p></div><main><article><header><h1>My title</h1></header><p>First with <a href=x>a link</a>
      &eacute;&nbsp;text.<p>Second<br>line<aside><p>Related stuff</p></aside><form><label>Mail</label></form><ul><li>one<li>two</ul></article></main>
      <section id="comments"><p>Nice post and thanks for all the very long words that go on and on and on</p></section><script>var x="<p>no</p>"</script>
      <div class="footer">end</div></body></html>"""
    assert html_text.main_text(page, html_text.trained()) == "My title\nFirst with a link é text.\nSecond line\none\ntwo"


def test_articles_without_telling_elements(spark, sf_dir):
    """With every element that names its zone turned into a plain one, densities find the same articles."""
    tree = html_text.trained()
    for r in common.table(spark, sf_dir, "pages").collect():
        plain = re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", r.html.replace('<div class="ad">', "<div>"))
        assert {b.zone for b in html_text.blocks(plain)} == {0}
        assert html_text.main_text(plain, tree) == html_text.main_text(r.html, tree)


LINE = "A paragraph that is long enough, and without any link, to be a part of an article of whatever kind it may be."


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>Hello all <span class="notice">x</span> more words</p></article>', "Hello all more words"),
        ('<article><p>we are <em class="ad-free">free of ads</em> today</p></article>', "we are free of ads today"),
        ("<html><head><title>t</title><body><article><p>one two three</p></article>", "one two three"),
        (f"<html><head><title>t</title><p>{LINE}</p><p>{LINE} It ends here, or so it seems to me.</p>", f"{LINE}\n{LINE} It ends here, or so it seems to me."),
        ("<article><p>before <button>Push</p><p>after</p></article>", "before\nafter"),
        ("<article><p>a</p><select><option>x<option>y</select><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><select><option>x<option>y<p>b</p></article>", "a\nb"),
        ("<article><p>x<button>one<p>y<button>two</button>z</article>", "x\nyz"),
        ('<article><section class="search-engines"><p>About engines</p></section></article>', "About engines"),
        ('<div id="content"><p>two short</p><p>lines here</p></div>', "two short\nlines here"),
        ('<div class="site-header">x</div><div class="content"><p>t u</p><div class="comment-list"><p>no</p></div></div><div class="ad-slot">buy</div>', "t u"),
        ("<article><p>1 < 2 &amp; 3 &gt; 2</p><textarea>no", "1 < 2 & 3 > 2\nno"),
    ],
)
def test_odd_markup_loses_no_text(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


def test_unclosed_elements_take_linear_time():
    page = "<article>" + "<button>a<select>b<p>word</p>" * 20_000
    began = time.time()
    assert html_text.main_text(page, html_text.trained()).count("word") == 20_000
    assert time.time() - began < 20



# --- token counts ---


def test_counts_equal_the_unigram_library(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, lowest = token_counts.pieces(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [(model.id_to_piece(i), 0.0) for i in range(model.get_piece_size()) if model.is_byte(i)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *raw, *vocabulary], unk_id=0, byte_fallback=True))
    counter = token_counts.Counter(vocabulary, lowest)
    for t in [x for x in docs.values() if x][:60] + ["漢字 \U0001f642 x", "a  b   c"]:
        marked = token_counts.SPACE + t.replace(" ", token_counts.SPACE)
        assert counter.count(t)[0] == len(library.encode(marked).ids)
    rng = random.Random(8)
    for _ in range(150):  # small vocabularies with many ties
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))}
        voc = [(w, -float(rng.randint(1, 3))) for w in words]
        own, lib = token_counts.Counter(voc, min(s for _, s in voc)), Tokenizer(models.Unigram([("<unk>", 0.0), *raw, *voc], unk_id=0, byte_fallback=True))
        for _ in range(6):
            x = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert own.best(x)[0] == len(lib.encode(x).ids)


# --- media ---


def test_media_query(spark, sf_dir, docs):
    for r in registry.QUERIES["op7_media"](spark, sf_dir).collect():
        data = docs[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media.pack(payload)).hexdigest()


@pytest.mark.parametrize("frames", [1, 4, 5, 8, 9, 17, 40])
def test_sample_tables(frames):
    payload = bytes(random.Random(frames).randbytes(frames * media.FRAME))
    blob = media.pack(payload)
    (track,) = media.walk(blob)
    assert media.read_back(blob, track) == payload
    assert track["keys"].tolist() == list(range(0, frames, media.KEY_EVERY))
    for k in track["keys"].tolist():
        o, s = int(track["offsets"][k]), int(track["sizes"][k])
        assert blob[o : o + s] == payload[k * media.FRAME : (k + 1) * media.FRAME]
    with pytest.raises(ValueError):
        list(media.boxes(blob[:-1]))


def test_inspect(spark):
    df = media.store(spark.createDataFrame([(1, "x" * 6000), (2, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in media.inspect(df).collect()}
    assert got[1].codec == "raw" and got[1].n_samples == 11 and len(got[1].keyframes) == 2 and got[2].n_samples == 1


# --- substrings ---


def brute_removal(texts):
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        on = np.cumsum(mark)[:-1] > 0
        kept = bytes(np.frombuffer(t, "u1")[~on])
        spans = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        out.append((len(t), int(on.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most, shard", [(2_000, 1 << 21), (2_000, 1500), (6, 1500), (0, 1 << 21)])
def test_removal_of_pieces(spark, monkeypatch, most, shard):
    """Also with contexts that go on from shard to shard, and dealt out by longer grams and by single windows."""
    monkeypatch.setattr(substrings, "MOST_MERGED", most)
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(900)) for _ in range(5)]
    texts = []
    for _ in range(90):
        t = b""
        for _ in range(rng.randint(0, 5)):
            b, i = rng.choice(base), rng.randrange(700)
            t += b[i : i + rng.randint(50, 400)]
            if rng.random() < 0.3:
                t += bytes(rng.choice(b"xyz") for _ in range(rng.randint(1, 60)))
            if rng.random() < 0.1:
                t += rng.choice([b"a", b"ab", b"abc"]) * rng.randint(50, 200)
        texts.append(t)
    texts += [texts[3], texts[4], b"", b"q" * 199, b"w" * 200, b"e" * 201]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in substrings.removal(df).collect()}
    assert got == dict(enumerate(brute_removal(texts)))


def test_removal_query(spark, sf_dir, docs):
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op8_substrings"](spark, sf_dir).collect()}
    assert got == dict(zip(docs, brute_removal([t.encode() for t in docs.values()])))


def test_suffix_order():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(40)] + [b"ab" * 20] * 3
    codes = np.concatenate([np.append(np.frombuffer(t, "u1").astype("i8") + 1, 0) for t in texts])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    left = np.append(np.array([len(texts[o]) - (i - starts[o]) for i, o in enumerate(owner)]), 0)
    words = suffixes.packed(codes)
    for depth in (3, 9, 30):
        order = suffixes.suffix_order(words, left, depth)
        cut = [codes[i : i + depth].tolist() for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(left[:-1] >= depth).tolist()
        assert cut == sorted(cut)
        got = suffixes.common_prefixes(words, left, starts, order, depth)
        want = [0] + [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(cut, cut[1:])]
        assert got.tolist() == want


def test_shards_merge_by_binary_search():
    rng = random.Random(2)
    base = [bytes(rng.choice(b"abc") for _ in range(700)) for _ in range(3)]
    contexts = [(g, 100 * g + i, 900, 5, base[g][a : a + 230]) for g in range(3) for i, a in enumerate(rng.sample(range(400), 30))]
    whole, cut = substrings.Shards(), substrings.Shards()
    for c in contexts:
        whole.add(c)

    def covered(batches):
        marks = Counter()
        for b in batches:
            for src, _, start, end in zip(*(c.to_pylist() for c in b.columns)):
                marks.update({(src, i): 1 for i in range(start, end)})
        return set(marks)

    want = covered([whole.flush()])
    out = []
    for i, c in enumerate(contexts):
        cut.add(c)
        if i % 7 == 3:
            out.append(cut.flush())
    assert want and covered([*out, cut.flush()]) == want


# --- licenses ---


def test_license_query(spark, sf_dir, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in registry.QUERIES["op9_licenses"](spark, sf_dir).collect():
        w = word.findall(low(docs[r.doc_id]))
        hits = [(i, l) for l, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want = (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in hits})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def as_pattern(wording):
    """The template as a regular expression over words with a space behind each."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\w+[:#]\d+\}|[^\s\[\]{}]+", wording):
        region = re.fullmatch(r"\{\w+([:#])(\d+)\}", part)
        if region:
            out += rf"(?:{'[0-9]+' if region[1] == '#' else '[^ ]+'} ){{0,{region[2]}}}"
        else:
            out += {"[[": "(?:", "]]": ")?"}.get(part) or re.escape(part) + " "
    return re.compile("(?<![^ ])" + out)


def test_labels_equal_those_of_patterns():
    """Texts made from the templates, whole and with one word changed, moved or left out."""
    rng, scanner = random.Random(8), licenses.Scanner()
    patterns = [(label, as_pattern(wording)) for label, wording in licenses.TEMPLATES]
    filler = "some plain words of 2 files and the license text a notice by nobody".split()
    seen = Counter()
    for label, wording in licenses.TEMPLATES * 12:
        words = []
        for part in re.findall(r"\[\[[^\]]*\]\]|\{\w+[:#]\d+\}|[^\s\[\]{}]+", wording):
            if part[0] == "{":
                n = int(re.split("[:#]", part[1:-1])[1])
                words += [rng.choice("1234567890") if "#" in part else rng.choice(filler) for _ in range(rng.randint(0, n + (rng.random() < 0.1)))]
            elif part[0] == "[":
                words += re.sub(r"\{.*?\}", "", part[2:-2]).split() if rng.random() < 0.5 else []
            else:
                words.append(part)
        kind, at = rng.randrange(4), rng.randrange(len(words))
        if kind == 1:
            words[at] = rng.choice(filler)
        elif kind == 2:
            del words[at]
        elif kind == 3:
            words.insert(at, rng.choice(filler))
        words = rng.choices(filler, k=rng.randrange(6)) + words + rng.choices(filler, k=rng.randrange(6))
        text = "".join(w + " " for w in words)
        want = {name for name, pattern in patterns if pattern.search(text)}
        got = {name for name, *_ in scanner.scan([w.encode() for w in words])[1]}
        assert got == want, text
        seen[label in got] += 1
    assert seen[True] > 60 and seen[False] > 30


def test_similar_licenses_are_told_apart():
    scanner = licenses.Scanner()

    def labels(text):
        return sorted({name for name, *_ in scanner.scan(licenses.words_of(text.encode()))[1]})

    fill = lambda t: re.sub(r"\{\w+:\d+\}", "the software", re.sub(r"\[\[|\]\]|\{\w+#\d+\}", " ", t))
    assert labels(fill(f"{licenses._BSD} {licenses._BSD_END}")) == ["bsd-2"]
    assert labels(fill(f"{licenses._BSD} {licenses._NAMES} {licenses._BSD_END}")) == ["bsd-3"]
    assert labels(fill(licenses._BSD)) == []
    assert labels(fill(f"{licenses._ISC} {licenses._ISC_END}")) == ["0bsd"]
    assert labels(fill(f"{licenses._ISC} {licenses._ISC_KEEP} {licenses._ISC_END}")) == ["isc"]
    notice = "Licensed under a Creative Commons Attribution{} 4.0 International License."
    assert [labels(notice.format(x)) for x in ("", "-NonCommercial", "-ShareAlike", "-NoDerivs")] == [["cc-by"], ["cc-by-nc"], ["cc-by-sa"], []]


def test_template_regions():
    a = licenses.Automaton("x", "must stand [[maybe this]] then {name:2} end")
    words = lambda t: t.encode().split()
    for t, ok in (
        ("must stand then end", True), ("must stand maybe this then a b end", True), ("must stand then a end", True),
        ("must stand then a b c end", False), ("must stand maybe then end", False), ("must then end", False),
    ):
        assert (a.match(words(t), 0) == len(words(t))) is ok


# --- secrets ---


def test_secret_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables hold no secret
    docs = {r[0]: r[1] or "" for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = ("assign", "access", "hex")
    found = 0
    for r in registry.QUERIES["op10_secrets"](spark, sf_dir).collect():
        t = docs[r.doc_id]
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        found += bool(s)
    assert found


def test_models_part_random_from_ordinary(spark):
    weights = secrets.train(secrets.labelled_samples(spark))
    rows = [
        ("ghp_x7Kq29ZbLm04TtRw8sVf", True), ("9f86d081884c7d659a2feaa0c55a", True), ("user_profile_settings_page_2", False),
        ("section-heading-number-12-list", False), ("httpServerRequestHandlerVersion2", False),
    ]
    df = spark.createDataFrame([(i, f"see {t} here") for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: "markov" in r.spans for r in secrets.scan(df, weights).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_failing_matches_take_their_characters(spark):
    text = "token=secret: abcdefghij password: 'abcdefgh' TOKEN=short"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = secrets.scan(df, [0.0] * len(secrets.SYMBOLS) ** 2).collect()
    assert r.n_assign == 1 and r.spans.startswith("assign:25:")
