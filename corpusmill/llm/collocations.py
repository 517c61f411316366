"""Phrase collocations, counted by burstable tries.

A phrase is frequent only if every phrase inside it is, so counting goes by
length: words, pairs of frequent words, triples of frequent pairs. What is
frequent reaches the tasks as a bit filter of a fixed size, which lets a few rare
phrases pass and no frequent one fail; counts are exact either way.

In a task, phrases live in a shallow trie of word ids: a first word leads to a
hash container of the rest; a container that grows too large bursts into one for
each second word. When the trie is full, subtrees are spilled whole, as sorted
runs, and start anew; those whose phrases came back least often go first. Runs meet by prefix (language and first two words),
where they are merged by adding up.

Nulls and edge cases: a null language is `und`, a null text is empty; a row of
no words adds nothing; equal rows count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import forget, small_batches, stored, table

#: Least number of places of a candidate; most words of one; share (in hundredths) of a phrase's places from which the
#: longer phrase stands for it; rows reported for a language.
LEAST, MOST_WORDS, COVERED, TOP = 10, 3, 50, 2_000
#: Bits of a filter, as a power of two.
WORD_BITS, PAIR_BITS = 24, 27
#: Entries of a container before it bursts, of a task's trie before it spills, and words of a task's dictionary.
BURST, SPILL, WORDS = 4_096, 2_000_000, 1_500_000
#: Words of a text that are numbered at once, and words that go into the trie together; bits of a word's number in a
#: task, enough for WORDS.
BLOCK, TOGETHER, ID = 500_000, 500_000, 21
#: A language's ranking is first cut in so many parts.
PARTS = 32
#: Ends a piece (fixed value).
ENDS = b".,;:!?\n\x0b\x0c\r"
_SPLIT = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")


def words_of(text: bytes) -> list[bytes]:
    """The words in order, empty strings between some of them, b"\\n" where a piece ends."""
    return text.lower().translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")


class Trie:
    """Counts of phrases of `words` word ids, packed into one number."""

    def __init__(self, words: int):
        self.rest = ID * (words - 1)
        self.deep = words > 2
        self.roots: dict[int, dict] = {}
        self.burst: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.places: dict[int, int] = {}
        self.entries = 0

    def add(self, packed: np.ndarray) -> None:
        found, counts = np.unique(packed, return_counts=True)
        first = found >> self.rest
        cuts = np.flatnonzero(np.diff(first)) + 1
        rest = (found & ((1 << self.rest) - 1)).tolist()
        counts = counts.tolist()
        starts = [0, *cuts.tolist(), len(rest)] if len(rest) else [0]
        for at, end in zip(starts, starts[1:]):
            self._insert(int(first[at]), rest[at:end], counts[at:end])

    def _insert(self, first: int, rest: list[int], counts: list[int]) -> None:
        root = self.roots.setdefault(first, {})
        new = 0
        if first in self.burst:
            low = (1 << ID) - 1
            for key, n in zip(rest, counts):
                held = root.setdefault(key >> ID, {})
                before = held.get(key & low)
                new += before is None
                held[key & low] = n + (before or 0)
        else:
            size = len(root)
            for key, n in zip(rest, counts):
                root[key] = root.get(key, 0) + n
            new = len(root) - size
            if self.deep and len(root) > BURST:
                self._burst(first)
        self.sizes[first] = self.sizes.get(first, 0) + new
        self.places[first] = self.places.get(first, 0) + sum(counts)
        self.entries += new

    def _burst(self, first: int) -> None:
        children: dict[int, dict[int, int]] = {}
        for key, n in self.roots[first].items():
            children.setdefault(key >> ID, {})[key & ((1 << ID) - 1)] = n
        self.roots[first] = children
        self.burst.add(first)

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes subtrees out until at most `keep` entries are left: (packed phrases in order, counts).

        Those whose phrases came back least often go first, larger ones before smaller ones.
        """
        for first in sorted(self.sizes, key=lambda f: (self.places[f] / self.sizes[f], -self.sizes[f])):
            if self.entries <= keep:
                return
            root = self.roots.pop(first)
            if first in self.burst:
                self.burst.discard(first)
                root = {second << ID | third: n for second, held in root.items() for third, n in held.items()}
            self.entries -= self.sizes.pop(first)
            self.places.pop(first)
            keys = np.fromiter(root.keys(), "i8", len(root))
            order = np.argsort(keys)
            yield keys[order] | first << self.rest, np.fromiter(root.values(), "i8", len(root))[order]


class Filter:
    """A bit filter of fixed size with two places for a hash."""

    def __init__(self, bits: int, slots: np.ndarray):
        self.bits, self.slots = bits, slots

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            found &= (self.slots[(at >> np.uint64(6)).astype("i8")] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def filter_of(df: DataFrame, of: Column, bits: int) -> Filter:
    """The filter that holds every hash `of`; 2^bits bits come to the driver at most."""
    whole = F.lit((1 << bits) - 1)
    at = F.explode(F.array(of.bitwiseAND(whole), F.shiftrightunsigned(of, 32).bitwiseAND(whole)))
    slot = F.shiftright("at", 6).cast("int").alias("slot")
    # shiftleft takes a number, not a column, in this API.
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    found = df.select(at.alias("at")).groupBy(slot).agg(F.bit_or(bit).alias("bits")).toArrow()
    slots = np.zeros(1 << (bits - 6), "u8")
    slots[found["slot"].to_numpy()] = found["bits"].to_numpy().view("u8")
    return Filter(bits, slots)


def word_hash(lang: str, word: str) -> Column:
    return F.xxhash64(F.col(lang), F.col(word))


def pair_hash(first: Column, second: Column) -> Column:
    """Of two word hashes; order counts."""
    return first.bitwiseXOR(F.shiftleft(second, 17).bitwiseOR(F.shiftrightunsigned(second, 47)))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ ((second << np.uint64(17)) | (second >> np.uint64(47)))


def _source(df: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"),
    )


def word_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for of, counts in held.items():
                counts.pop(b"", 0), counts.pop(b"\n", 0)
                words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                langs = pa.array([of] * len(counts), pa.string())
                yield pa.RecordBatch.from_arrays([langs, words, pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(of, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > WORDS:
                yield from out()
        yield from out()

    found = _source(df, text, lang).mapInArrow(count, "lang string, word string, n bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """A language's words by number in a task: 0 ends a piece, 1 is nothing."""

    def __init__(self, task: "Task"):
        super().__init__({b"\n": 0, b"": 1})
        self.task = task

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.task.words)
        self.task.words.append(word)
        return found


class Task:
    """Words of a task, of all languages, by number: their hashes and whether they may be frequent."""

    def __init__(self, common: Filter):
        self.common = common
        self.by_lang: dict[str, Numbers] = {}
        self.words: list[bytes] = [b"\n", b""]
        self.langs: list[tuple[int, str]] = []
        self.hashes, self.frequent = np.zeros(2, "u8"), np.zeros(2, bool)

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, without those of nothing."""
        import xxhash

        known = self.by_lang.setdefault(lang, Numbers(self))
        before = len(self.words)
        ids = np.fromiter(map(known.__getitem__, words), "i8", len(words))
        if new := self.words[before:]:
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            self.langs.append((before, lang))
            if len(self.words) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self.words), "u8")])
                self.frequent = np.concatenate([self.frequent, np.zeros(len(self.words), bool)])
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in new), "u8", len(new))
            self.hashes[before : len(self.words)] = hashes
            self.frequent[before : len(self.words)] = self.common.has(hashes)
        return ids[ids != 1]

    def lang_of(self, ids: np.ndarray) -> pa.Array:
        starts = np.array([at for at, _ in self.langs])
        names, codes = np.unique([lang for _, lang in self.langs], return_inverse=True)
        return pa.DictionaryArray.from_arrays(pa.array(codes[np.searchsorted(starts, ids, "right") - 1]), pa.array(names.tolist(), pa.string())).cast(pa.string())


def phrase_counts(df: DataFrame, size: int, common: Filter, pairs: Filter | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1 ... w`size`, n) of the phrases of frequent words, and of frequent pairs where `pairs` is given."""
    names = [f"w{i + 1}" for i in range(size)]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((common, pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, pairs = shared.value
        task, trie = Task(common), Trie(size)

        def out(keep: int) -> Iterator[pa.RecordBatch]:
            runs = list(trie.spill(keep))
            if not runs:
                return
            # Runs leave in the order of their first words, so that they are read in order where they meet.
            runs.sort(key=lambda run: task.words[int(run[0][0]) >> trie.rest])
            words = pa.array(task.words, pa.binary()).cast(pa.string())
            for at in range(0, len(runs), 2_000):
                packed, n = (np.concatenate([r[c] for r in runs[at : at + 2_000]]) for c in (0, 1))
                columns = [packed >> ID * (size - 1 - i) & ((1 << ID) - 1) for i in range(size)]
                arrays = [task.lang_of(columns[0]), *(words.take(pa.array(c)) for c in columns), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", *names, "n"])

        waiting: list[np.ndarray] = []

        def take() -> None:
            if not waiting:
                return
            ids = np.concatenate([x for part in waiting for x in (part, np.zeros(1, "i8"))])
            waiting.clear()
            common_ = task.frequent[ids]
            starts = np.flatnonzero(_runs(common_, size))
            if pairs is not None:
                near = np.zeros(len(ids), bool)
                two = np.flatnonzero(_runs(common_, 2))
                near[two] = pairs.has(pair_hashes(task.hashes[ids[two]], task.hashes[ids[two + 1]]))
                starts = starts[near[starts] & near[starts + 1]]
            packed = ids[starts]
            for i in range(1, size):
                packed = packed << ID | ids[starts + i]
            trie.add(packed)

        many = 0
        for batch in batches:
            for of, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for block in _blocks(words_of(body), size):
                    many += len(block)
                    if len(task.words) + len(block) > WORDS:
                        take()
                        yield from out(0)
                        task, trie, many = Task(common), Trie(size), len(block)
                    waiting.append(task.numbers(of, block))
                    if many > TOGETHER:
                        take()
                        many = 0
                        if trie.entries > SPILL:
                            yield from out(SPILL // 2)
        take()
        yield from out(0)

    schema = f"lang string, {', '.join(f'{n} string' for n in names)}, n bigint"
    runs = _source(df, text, lang).mapInArrow(count, schema)
    return runs.repartition("lang", "w1", "w2").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _blocks(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The words of a text in blocks, each with those that its last phrases need; so every phrase starts in one block."""
    if len(words) <= BLOCK:
        yield words
        return
    words = [w for w in words if w]
    for at in range(0, len(words), BLOCK):
        yield words[at : at + BLOCK + size - 1]


def _runs(of: np.ndarray, size: int) -> np.ndarray:
    """Where `size` in a row are true."""
    found = of.copy()
    for i in range(1, size):
        found[:-i] &= of[i:]
        found[-i:] = False
    return found


def score_of(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact: products have up to 38 digits."""
    return F.expr(
        f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)))"
        f" DIV (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0))) AS BIGINT)"
    )


def best_of_each(df: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each lang by score, a and phrase, with their rank; parts are cut before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    cut = df.withColumn("place", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = cut.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).drop("place")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    counted = stored(word_counts(df, text, lang))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(counted.where(F.col("n") >= LEAST))
    common = filter_of(frequent, word_hash("lang", "word"), WORD_BITS)
    twos = stored(phrase_counts(df, 2, common, None, text, lang).where(F.col("n") >= LEAST))
    near = filter_of(twos, pair_hash(word_hash("lang", "w1"), word_hash("lang", "w2")), PAIR_BITS)
    threes = stored(phrase_counts(df, 3, common, near, text, lang).where(F.col("n") >= LEAST))

    def words(name: str, count: str) -> DataFrame:
        return frequent.select("lang", F.col("word").alias(name), F.col("n").alias(count))

    def pairs(first: str, second: str, count: str) -> DataFrame:
        return twos.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("n").alias(count))

    # A pair goes where a frequent triple stands for most of its places.
    parts = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    within = threes.select("lang", "n", parts.alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("n").alias("longer"))
    kept = twos.join(within, ["lang", "w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {COVERED} * n")
    two = kept.join(words("w1", "l"), ["lang", "w1"]).join(words("w2", "r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", score_of("n", "l", "r").alias("score"))
    three = threes.withColumnRenamed("n", "a").join(pairs("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(pairs("w2", "w3", "r1"), ["lang", "w2", "w3"])
    three = three.join(words("w1", "l1"), ["lang", "w1"]).join(words("w3", "r2"), ["lang", "w3"])
    three = three.withColumn("s1", score_of("a", "l1", "r1")).withColumn("s2", score_of("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    best = stored(best_of_each(two.unionByName(three), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    forget(counted, frequent, twos, threes)
    return best


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM listed, (SELECT unnest([1, 2, 3]) AS k)
), f AS (
    SELECT lang, k, phrase, count(*)::BIGINT AS n FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}
), cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.w, p AS cut, array_to_string(c.w[1:p], ' ') AS head, array_to_string(c.w[p + 1:], ' ') AS tail
    FROM candidates c, (SELECT unnest([1, 2]) AS p) WHERE p < c.k
), scored AS (
    SELECT cuts.*, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (
    SELECT lang, inner_phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM candidates WHERE k = 3
    ) GROUP BY lang, inner_phrase
), kept AS (
    SELECT s.* FROM lowest s LEFT JOIN covered c ON c.lang = s.lang AND c.inner_phrase = s.phrase
    WHERE c.longer IS NULL OR 100 * c.longer < {COVERED} * s.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": _SQL}
