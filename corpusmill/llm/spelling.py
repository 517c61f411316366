"""Spelling variants: words one code point apart, by pairs of trie nodes.

The nodes of a trie of all words, and of one of all reversed words, have numbers.
A word without its i-th place is the pair (node of what stands before, node of
what stands behind); a whole word cut at i is such a pair as well. Two words
differ by a replaced code point exactly if they share a pair without a place, and
by an inserted one exactly if the longer one's pair without a place is a cut of
the shorter one. Words with the same pair differ in one letter, so a pair is held
by no more words than there are letters: no group grows with the input.

A trie is numbered where it lies in order: tasks hold ranges of sorted words. The
first SHORT letters fit into a number by themselves, and words that share them
lie in one task, so no node gets two numbers. A word's own number is its place in
that order.

Nulls and edge cases: a null text has no words; a null key is written as nothing
in a run's hash; equal rows count each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import forget, small_batches, stored, table

#: Least code points of a word and least occurrences; a form stands at least so many times as often as its variant.
LENGTH, LEAST, TIMES = 7, 2, 10
#: Of so many runs one loses a code point.
DAMAGED = 31
#: Letters that are a node's number by themselves, a byte each.
SHORT = 7
#: Different words that a task counts before it passes them on.
HELD = 1_000_000
#: Bits for what a task numbers.
TASK = 36
_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LENGTH)


def words_of(key: object, text: bytes) -> Counter[str]:
    """Words of a text with their occurrences; some have lost a code point, as the hash of key and word says."""
    found: Counter[str] = Counter()
    start = crc32(b"%s:" % str("" if key is None else key).encode())
    for run, n in Counter(_RUNS.findall(text.lower().decode())).items():
        h = crc32(run.encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LENGTH:
                continue
        found[run] += n
    return found


def vocabulary(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of the words that stand LEAST times or more."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for of, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in words_of(of, body).items():
                    held[word] += n
            if len(held) > HELD:
                yield out()
        yield out()

    source = df.select(F.col(f"`{key}`").cast("string"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))
    return source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def trie_nodes(words: Iterator[str], task: int) -> Iterator[tuple[int, list[int]]]:
    """(place, numbers of the nodes from the root to the word's end) of words in order."""
    last, nodes, made = b"", [0], 0
    for place, word in enumerate(words):
        letters = word.encode("latin-1")
        same = 0
        for a, b in zip(last, letters):
            if a != b:
                break
            same += 1
        nodes = nodes[: same + 1]
        for depth in range(same + 1, len(letters) + 1):
            if depth <= SHORT:
                nodes.append(nodes[-1] << 8 | letters[depth - 1])
            else:
                made += 1
                nodes.append(-(task << TASK | made))
        last = letters
        yield task << TASK | place, nodes


def numbered(words: DataFrame, of: str) -> DataFrame:
    """The rows of `words` with (id, nodes): place of `of` in code-point order, and its trie nodes, the root first."""
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "id bigint", "nodes array<bigint>"])
    at = words.columns.index(of)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        waiting: list[pa.RecordBatch] = []

        def one_by_one() -> Iterator[str]:
            for batch in batches:
                waiting.append(batch)
                yield from batch.column(at).to_pylist()

        ids: list[int] = []
        paths: list[list[int]] = []
        for place, nodes in trie_nodes(one_by_one(), task):
            ids.append(place)
            paths.append(nodes)
            if len(ids) == waiting[0].num_rows:
                batch = waiting.pop(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], [*kinds, "id", "nodes"])
                ids, paths = [], []

    in_order = words.repartitionByRange(F.substring(of, 1, SHORT)).sortWithinPartitions(of)
    return in_order.mapInArrow(number, schema)


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, id) of every word, and (id, n_near, near_n, near_id) of those with near words: their number, the best one's n and id."""
    forward = stored(numbered(words.select("word", "n"), "word"))
    backward = numbered(words.select("word", F.reverse("word").alias("drow")), "drow").select("word", F.col("nodes").alias("back"))
    both = forward.join(backward, "word")
    # kind 0: a cut of the whole word; else a place left out, 2 where it is the last of equal letters in a row, so that a
    # longer word meets a shorter one once.
    places = F.expr(
        """concat(
            transform(sequence(0, length(word)), i -> struct(nodes[i] AS p, back[length(word) - i] AS s, 0 AS kind)),
            transform(sequence(0, length(word) - 1), i -> struct(nodes[i] AS p, back[length(word) - i - 1] AS s,
                IF(substring(word, i + 1, 1) = substring(word, i + 2, 1), 1, 2) AS kind)))"""
    )
    pairs = both.select("id", "n", F.explode(places).alias("at")).select("at.p", "at.s", F.struct("id", "n", "at.kind").alias("m"))
    held = pairs.groupBy("p", "s").agg(F.collect_list("m").alias("m")).where("size(m) > 1")
    near = "y.id <> x.id AND ((x.kind > 0 AND y.kind > 0) OR x.kind + y.kind = 2)"
    each = held.select(
        F.expr(f"inline(transform(m, x -> struct(x.id AS id, transform(filter(m, y -> {near}), y -> struct(y.n AS n, -y.id AS id)) AS near)))")
    )
    found = each.where("size(near) > 0").select("id", F.size("near").alias("n_near"), F.array_max("near").alias("best"))
    best = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    return forward.select("word", "n", "id"), best.select("id", "n_near", F.col("best.n").alias("near_n"), (-F.col("best.id")).alias("near_id"))


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of different words (word, n).

    A form is the near word that stands most often, if TIMES as often or more as
    the word; the root is where forms lead to in the end.
    """
    every, near = near_words(words)
    joined = stored(every.join(near, "id", "left"))
    has_form = F.col("near_n") >= TIMES * F.col("n")
    steps = stored(joined.where(has_form).select("id", F.col("near_id").alias("root")))
    # A form stands TIMES as often as what it is the form of, so chains are short; each round doubles the reach.
    while True:
        on = steps.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = stored(steps.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not longer.where("moved").isEmpty()
        forget(steps)
        steps = longer
        if not moved:
            break
    names = joined.select("id", "word")
    forms = joined.where(has_form).join(steps.select("id", "root"), "id").select("id", "near_id", "near_n", F.col("root").alias("root_id"))
    forms = forms.join(names.toDF("near_id", "form"), "near_id").join(names.toDF("root_id", "root"), "root_id")
    found = joined.select("id", "word", "n", "n_near").join(forms.select("id", "form", F.col("near_n").alias("form_n"), "root"), "id", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(vocabulary(table(spark, sf_dir, "documents"))))


QUERIES = {"op12_spelling": op12_spelling}
ORACLES: dict[str, str] = {}
