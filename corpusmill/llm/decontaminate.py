"""Benchmark decontamination with the q-gram lemma.

A text that holds a passage of m characters within e edits shares at least
m + 1 - q - q*e of its q-grams, on diagonals (place in the text less place in the
passage) at most e apart. Hits are counted in overlapping bands of diagonals;
bands that reach the bound are regions, which a banded alignment then verifies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_schema, per_text, small_batches, stored, table
from .rolling import window_hashes

#: Characters in a q-gram; edits allowed for each character of a passage.
Q, EDITS = 8, 0.1
#: Characters of benchmark passages in one block, which every task holds; more passages go in more blocks.
BLOCK_CHARS = 4_000_000
#: Characters of documents whose q-grams are looked up together.
SLICE = 1 << 20
_BITS = 22
#: Stands between texts; no character's code.
OUTSIDE = 0x110000


def normal(text: str) -> str:
    """Small letters, and one space for any white space."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Passages:
    """Index of the q-grams of a block of passages."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.codes = [], []
        #: Passages too short for a q-gram; they have no edits to spare, and are looked up as they are.
        self.short: list[tuple[int, str]] = []
        for item, text in items:
            passage = normal(text)
            found = codes(passage)
            if len(found) >= Q:
                self.ids.append(item)
                self.codes.append(found)
            elif passage:
                self.short.append((item, passage))
        self.size = np.array([len(c) for c in self.codes], "i8")
        # At least one shared q-gram must be asked for.
        self.edits = np.minimum((self.size * EDITS).astype("i8"), (self.size - Q) // Q)
        self.least = self.size + 1 - Q - Q * self.edits
        grams = [window_hashes(c, Q) for c in self.codes]
        sizes = [len(g) for g in grams]
        every = np.concatenate(grams) if grams else np.empty(0, "u8")
        owner = np.repeat(np.arange(len(grams)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if grams else np.empty(0, "i8")
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.gram)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - _BITS)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, passage, place in the passage) of every shared q-gram."""
        at = np.flatnonzero(self.maybe[self._slot(hashes)])
        slot = np.searchsorted(self.gram, hashes[at])
        slot[slot == len(self.gram)] = 0
        same = self.gram[slot] == hashes[at]
        at, slot = at[same], slot[same]
        n = self.count[slot]
        rows = np.repeat(np.arange(len(at)), n)
        post = self.first[slot][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return at[rows], self.owner[post], self.place[post]

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of the bands that reach the bound, runs of bands joined."""
        if not len(self.gram):
            return []
        place, item, inner = self.hits(window_hashes(text, Q))
        diagonal, edits = place - inner, self.edits[item]
        step = edits + 1
        band = diagonal // step
        also = diagonal - band * step < edits
        item_all = np.concatenate([item, item[also]])
        band_all = np.concatenate([band, band[also] - 1])
        key, n = np.unique(item_all << 40 | (band_all + (1 << 38)), return_counts=True)
        key = key[n >= self.least[key >> 40]]
        item, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 38)
        found: list[tuple[int, int, int]] = []
        for i, b in zip(item.tolist(), band.tolist()):
            edits = int(self.edits[i])
            low, high = b * (edits + 1), b * (edits + 1) + 2 * edits
            if found and found[-1][0] == i and low <= found[-1][2] + 1:
                found[-1] = (i, found[-1][1], high)
            else:
                found.append((i, low, high))
        return found

    def align(self, text: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place of a passage on diagonals low..high; None beyond its budget.

        Rows are the passage's characters, columns diagonals; a cell holds the
        edits and, in its low half, where the place starts. The fewest edits
        count, then the first start.
        """
        passage, budget = self.codes[item], int(self.edits[item])
        low, high = low - budget, high + budget
        width = high - low + 1
        window = np.full(width + len(passage), OUTSIDE, "u4")
        first, last = max(low, 0), min(low + len(window), len(text))
        if first < last:
            window[first - low : last - low] = text[first:last]
        # A place without edits needs no table.
        whole, part = window.tobytes(), passage.tobytes()
        at = whole.find(part)
        while at >= 0 and at % 4:
            at = whole.find(part, at + 1)
        if at >= 0:
            return 0, at // 4 + low, at // 4 + low + len(passage)
        one = 1 << 32
        cell = np.arange(width, dtype="i8")  # row 0: the place may start anywhere
        ramp = cell * one
        for i, char in enumerate(passage.tolist()):
            step = cell + (window[i : i + width] != char) * one
            # The passage's character is missing in the text: the diagonal falls by one.
            step[:-1] = np.minimum(step[:-1], cell[1:] + one)
            # The text has a character more: the diagonal rises by one, any number of times.
            cell = np.minimum.accumulate(step - ramp) + ramp
        best = int(cell.argmin())
        edits, start = divmod(int(cell[best]), one)
        if edits > budget:
            return None
        return edits, max(start + low, 0), min(best + low + len(passage), len(text))

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, edits, start, end) of the best place of each passage that it holds."""
        plain = [normal(t) for t in texts]
        bodies = [codes(t) for t in plain]
        gap = np.full(1, OUTSIDE, "u4")
        starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])
        every = np.concatenate([part for b in bodies for part in (b, gap)]) if bodies else gap
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in bodies]
        for item, low, high in self.regions(every):
            reach = [max(low, 0), max(high + len(self.codes[item]), 0)]
            from_, to = np.searchsorted(starts, reach, side="right") - 1
            for t in range(int(from_), min(int(to), len(bodies) - 1) + 1):
                shift = int(starts[t])
                found = self.align(bodies[t], item, low - shift, high - shift)
                if found and (item not in best[t] or found < best[t][item]):
                    best[t][item] = found
        found = [[(self.ids[i], *b[i]) for i in sorted(b)] for b in best]
        for t, body in enumerate(plain):
            for item, passage in self.short:
                at = body.find(passage)
                if at >= 0:
                    found[t].append((item, 0, at, at + len(passage)))
        return found


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters, or of one longer text."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def passage_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of at most about BLOCK_CHARS characters, by a hash; one after the other, at least one."""
    rows = benchmark.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    of = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield sorted(((r[0], r[1]) for r in rows.where(of == b).collect()), key=lambda r: (r[0] is None, str(r[0]), r[1]))


def contaminated(
    df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id"
) -> DataFrame:
    """(key, item_id, edits, start, end) for every row and passage that its whole text holds.

    Places are code points of the text after `normal`. Null and empty texts hold
    none, and a null or empty passage is held by none. A passage too short for a
    q-gram is held without edits. A passage with a null id is reported under
    null, and repeated passages and rows give repeated rows. Ids and keys keep
    their types. The passages are a query set: each block of them is compared
    with all rows; the driver holds one block at a time.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text") != "")
    kind = df.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {item_kind}, edits int, start bigint, end bigint"
    target = arrow_schema(df.sparkSession, schema)

    def of_block(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = _index(block)
            for batch in batches:
                rows: list[tuple] = []
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at, end in slices(texts):
                    for k, found in zip(keys[at:end], passages.matches(texts[at:end])):
                        rows += [(k, *m) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        return source.mapInArrow(run, schema)

    found = None
    for block, last in with_last(passage_blocks(benchmark, item)):
        part = of_block(block) if last else stored(of_block(block))
        found = part if found is None else found.unionByName(part)
    return found


def with_last(items: Iterator) -> Iterator[tuple]:
    """Each item with whether it is the last."""
    held = next(items)
    for item in items:
        yield held, False
        held = item
    yield held, True


def flagged(
    df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id"
) -> DataFrame:
    """(key, contaminated) for every row: whether its whole text holds any passage, with or without an id.

    See `contaminated` for odd cases.
    """

    def of_block(block: list[tuple[int, str]]):
        def work(texts: list[bytes]) -> list[tuple]:
            passages = _index(block)
            bodies = [t.decode() for t in texts]
            return [(bool(found),) for at, end in slices(bodies) for found in passages.matches(bodies[at:end])]

        return work

    # A block after the other; what is known of the rows is carried along.
    rows = df.select(F.struct(F.col(f"`{key}`").alias("key"), F.lit(False).alias("held")).alias("row"), F.col(f"`{text}`").alias("text"))
    for block, last in with_last(passage_blocks(benchmark, item)):
        if last:
            found = per_text(rows, of_block(block), "hit boolean", "row", "text")
            return found.select(F.col("row.key").alias(key), (F.col("row.held") | F.col("hit")).alias("contaminated"))
        carried = rows.select(F.struct("row", "text").alias("row"), "text")
        found = per_text(carried, of_block(block), "hit boolean", "row", "text")
        rows = stored(
            found.select(
                F.struct(F.col("row.row.key").alias("key"), (F.col("row.row.held") | F.col("hit")).alias("held")).alias("row"),
                F.col("row.text").alias("text"),
            )
        )


_INDEX: dict[int, Passages] = {}


def _index(block: list[tuple[int, str]]) -> Passages:
    """A worker's index of the block at hand, made once."""
    mark = hash(tuple(block))
    if mark not in _INDEX:
        _INDEX.clear()
        _INDEX[mark] = Passages(block)
    return _INDEX[mark]


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
