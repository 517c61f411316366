"""Exact substring dedup with per-shard suffix arrays.

Bytes covered by a string of 200 bytes that also starts elsewhere are removed.
Every window of 200 bytes picks an anchor, its 100-byte gram of least hash, and
equal windows pick equal anchors. So each window belongs to one anchor, whose
context is what its windows cover. An anchor that stands once rules its windows
out. A context that stands at several places is repeated as a whole. Of anchors
with several contexts, each context goes once to a shard, dealt out by anchor.

A shard sorts its suffixes (Larsson and Sadakane), takes the common prefixes of
neighbours (Kasai), and windows that share 200 bytes with a neighbour are
repeated. Where an anchor's contexts go on in the next shard, the two are merged
by binary search: the windows of the next are looked up among the sorted windows
of those before. An anchor with very many contexts is dealt out by longer grams,
which its windows have by their distance from the anchor, so that no shard or
merge grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import forget, small_batches, stored, table
from .rolling import window_hashes
from .suffixes import common_prefixes, packed, suffix_order

#: Bytes of a repeated string, and of an anchor.
LENGTH, GRAM = 200, 100
#: Bytes before and after an anchor that its windows reach.
REACH = LENGTH - GRAM
#: Window starts looked at together.
SLICE = 1 << 20
#: Bytes of contexts in one shard.
SHARD_BYTES = 1 << 21
#: Contexts of one anchor, or of one longer gram, that are merged in shards; beyond it they are dealt out further.
MOST_MERGED = 2_000
#: Distances from the anchor that one longer gram stands for.
STRIDE = 8


# --- anchors ----------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(places, hashes, first and last window) of the anchors of texts that lie in `data` one after the other."""
    picks = REACH + 1
    found = []
    low_bits = np.uint64((1 << 21) - 1)
    valid = np.zeros(len(data) + 1, "i4")
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    for at in range(0, max(len(data) - LENGTH + 1, 0), SLICE):
        part = data[at : at + SLICE + LENGTH - 1]
        hashes = window_hashes(part, GRAM)
        # The low bits hold the place, so the least key is the leftmost of the least hashes.
        keys = (hashes & ~low_bits) | np.arange(len(hashes), dtype="u8")
        n = len(keys) - picks + 1
        rows = -(-len(keys) // picks)
        square = np.full(rows * picks, np.iinfo("u8").max, "u8")
        square[: len(keys)] = keys
        square = square.reshape(rows, picks)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[picks - 1 : picks - 1 + n])
        windows = np.flatnonzero(valid[at : at + n])
        places = (least[windows] & low_bits).astype("i8")
        if len(places):
            # The windows that pick a place stand in one run.
            cut = np.flatnonzero(np.diff(places)) + 1
            first, last = np.append(0, cut), np.append(cut, len(places)) - 1
            found.append((places[first] + at, hashes[places[first]], windows[first] + at, windows[last] + at))
    if not found:
        return np.empty(0, "i8"), np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")
    places, hashes, first, last = map(np.concatenate, zip(*found))
    # A run that goes on in the next slice.
    new = np.append(True, places[1:] != places[:-1])
    return places[new], hashes[new], first[new], last[np.append(new[1:], True)]


def occurrences(df: DataFrame) -> DataFrame:
    """(anchor, context, src, size, place, before, after) of every anchor of every row's text.

    `df` has src, size and text (binary); before and after are the bytes that
    the context has before and from the place.
    """
    kinds = (("anchor", "i8", "bigint"), ("context", "i8", "bigint"), ("src", "i8", "bigint"), ("size", "i4", "int"), ("place", "i4", "int"), ("before", "i2", "smallint"), ("after", "i2", "smallint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash_ = xxhash.xxh3_64_intdigest
        for batch in batches:
            src, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("i8")
            joined = b"".join(batch.column(2).to_pylist())
            ends = np.cumsum(size)
            starts = ends - size
            places, hashes, first, last = anchors(np.frombuffer(joined, "u1"), starts, ends)
            if not len(places):
                continue
            row = np.searchsorted(ends, places, side="right")
            view = memoryview(joined)
            contexts = np.fromiter(
                (hash_(view[a : b + LENGTH], p - a) for a, b, p in zip(first.tolist(), last.tolist(), places.tolist())), "u8"
            )
            columns = (hashes.view("i8"), contexts.view("i8"), src[row], size[row], places - starts[row], places - first, last + LENGTH - places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(k)) for c, (_, k, _) in zip(columns, kinds)], [name for name, *_ in kinds]
            )

    return df.select("src", "size", "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in kinds))


# --- shards -----------------------------------------------------------------------------------------------------------


def _ranges(src: list[int], size: list[int], start: list[int], end: list[int]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip((src, size, start, end), kinds)], ["src", "size", "start", "end"]
    )


class Shards:
    """Contexts of one group after the other, sorted in shards; a group's windows are kept for the shard it goes on in."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, int, int, bytes]] = []  # group, text, its size, place of the context, its bytes
        self.bytes = 0
        self.group: int | None = None
        self.windows = np.empty(0, f"S{LENGTH}")
        self.places = np.empty((0, 3), "i8")

    def add(self, context: tuple[int, int, int, int, bytes]) -> bool:
        """Whether the shard is full."""
        self.held.append(context)
        self.bytes += len(context[4])
        return self.bytes >= SHARD_BYTES

    def flush(self) -> pa.RecordBatch:
        """(src, size, start, end) ranges of this shard's contexts that repeat, and of those kept before."""
        groups, src, size, low = (np.array([r[c] for r in self.held], "i8") for c in range(4))
        sizes = np.array([len(r[4]) for r in self.held])
        data = np.frombuffer(b"\0".join(r[4] for r in self.held) + b"\0" * (LENGTH + 1), "u1")
        total = int(sizes.sum()) + len(sizes)
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = data[:total].astype("i8") + 1
        codes[starts + sizes] = 0
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        left = np.append((starts + sizes)[owner] - np.arange(total), 0)
        words = packed(codes)
        order = suffix_order(words, left, LENGTH)
        same = common_prefixes(words, left, starts, order, LENGTH) >= LENGTH
        hit = np.zeros(len(order), bool)
        hit |= same
        hit[:-1] |= same[1:]

        def windows_of(group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(index in the order, windows, places) of a group, sorted."""
            own = np.flatnonzero(groups[owner[order]] == group)
            at = order[own]
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at])
            place = np.stack([src[owner[at]], size[owner[at]], low[owner[at]] + at - starts[owner[at]]], axis=1)
            return own, rows.view(f"S{LENGTH}").ravel(), place.reshape(-1, 3)

        earlier = np.empty((0, 3), "i8")
        if self.group == groups[0] and len(self.windows):
            own, windows, places = windows_of(self.group)
            at = np.minimum(np.searchsorted(self.windows, windows), len(self.windows) - 1)
            met = self.windows[at] == windows
            hit[own[met]] = True
            earlier = self.places[at[met]]
        if self.group == groups[0] == groups[-1]:
            into = np.searchsorted(self.windows, windows)
            self.windows = np.insert(self.windows, into, windows)
            self.places = np.insert(self.places, into, places, axis=0)
        else:
            self.group = int(groups[-1])
            _, self.windows, self.places = windows_of(self.group)

        covered = np.zeros(total + LENGTH + 1, "i4")
        covered[order[hit]] = 1
        covered[LENGTH:] -= covered[:-LENGTH].copy()
        on = np.cumsum(covered[:total]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype("i1"))).reshape(-1, 2)
        o = owner[edges[:, 0]]
        offset = low[o] - starts[o]
        self.held, self.bytes = [], 0
        return _ranges(
            np.concatenate([src[o], earlier[:, 0]]), np.concatenate([size[o], earlier[:, 1]]),
            np.concatenate([edges[:, 0] + offset, earlier[:, 2]]), np.concatenate([edges[:, 1] + offset, earlier[:, 2] + LENGTH]),
        )


def shard_ranges(contexts: DataFrame) -> DataFrame:
    """(src, size, start, end) ranges of texts that repeat, from (grp, src, size, low, bytes) contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, last = Shards(), None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                place = (*r[:4], len(r[4]))
                if place != last and shards.add(r):  # copies of a text may bring the same context again
                    yield shards.flush()
                last = place
        if shards.held:
            yield shards.flush()

    dealt = contexts.select("grp", "src", "size", "low", "bytes").repartition("grp")
    dealt = dealt.sortWithinPartitions("grp", "src", "size", "low", F.octet_length("bytes"))
    return dealt.mapInArrow(run, "src bigint, size int, start int, end int")


def longer_grams(place: int, low: int, data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(gram, start, end) of the parts of a context at `low` in which windows share a gram longer than the anchor."""
    last = low + len(data) - LENGTH
    for far in range(0, REACH + 1, STRIDE):  # windows from `far` to `far + STRIDE - 1` bytes before the anchor
        a, b = max(low, place - far - STRIDE + 1), min(last, place - far)
        if a <= b:
            yield data[place - far - low : place - far - STRIDE + 1 + LENGTH - low], a, b + LENGTH


def cut_contexts(asked: DataFrame) -> DataFrame:
    """(hot, grp, context, src, size, low, bytes) of the contexts that are asked for, cut from their texts.

    `asked` has src, size, text and asks. A context of a hot anchor comes in parts, grouped by longer grams.
    """
    kinds = (("hot", pa.bool_(), "boolean"), ("grp", pa.int64(), "bigint"), ("context", pa.int64(), "bigint"), ("src", pa.int64(), "bigint"), ("size", pa.int32(), "int"), ("low", pa.int32(), "int"), ("bytes", pa.binary(), "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash_ = lambda data, seed: xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)
        known: set[tuple[int, int]] = set()  # texts of this partition, as copies meet in it
        for batch in batches:
            out: list[tuple] = []
            for src, size, data, asks in zip(*(c.to_pylist() for c in batch.columns)):
                if (src, size) in known:
                    continue
                known.add((src, size))
                for ask in asks:
                    place = ask["place"]
                    low = place - ask["before"]
                    part = data[low : place + ask["after"]]
                    if not ask["hot"]:
                        out.append((False, ask["anchor"], 0, src, size, low, part))
                        continue
                    for gram, a, b in longer_grams(place, low, part):
                        # The context is known by its bytes and where in it the gram stands.
                        seed = (place - a) % (1 << 32)
                        group = hash_(gram, (ask["anchor"] + STRIDE * ((place - b + LENGTH) // STRIDE)) % (1 << 64))
                        out.append((True, group, hash_(part[a - low : b - low], seed), src, size, a, part[a - low : b - low]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, (_, k, _) in zip(zip(*out) if out else [()] * len(kinds), kinds)], [n for n, *_ in kinds]
            )

    return asked.select("src", "size", "text", "asks").mapInArrow(run, ", ".join(f"{n} {kind}" for n, _, kind in kinds))


def window_rows(contexts: DataFrame) -> DataFrame:
    """(grp, window, src, size, start): a hash of every single window of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = [
                (grp, xxhash.xxh3_64_intdigest(data[i : i + LENGTH]) - (1 << 63), src, size, low + i)
                for grp, src, size, low, data in zip(*(c.to_pylist() for c in batch.columns))
                for i in range(len(data) - LENGTH + 1)
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["grp", "window", "src", "size", "start"]
            )

    return contexts.select("grp", "src", "size", "low", "bytes").mapInArrow(
        run, "grp bigint, window bigint, src bigint, size int, start int"
    )


# --- the whole --------------------------------------------------------------------------------------------------------


def removal(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null and empty texts, and those under 200 bytes, lose nothing. Rows with the
    same text are copies of each other and lose all from 200 bytes on, whatever
    their keys, which may be null or repeated.
    """
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    # A text is known by its hash and its size.
    rows = df.select(F.col(f"`{key}`").alias("key"), body.alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("src"), F.octet_length("text").alias("size"), "text")
    place = F.struct("src", "size", "place", "before", "after")
    span = lambda at, before, after: F.struct((at - before).cast("int").alias("start"), (at + after).cast("int").alias("end"))

    seen = stored(occurrences(rows.where(F.col("size") >= LENGTH)))
    repeated = seen.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("several")
    )
    # Tables are written before a join, so that Spark can split a very common anchor there.
    repeated = stored(repeated.where("n > 1").select("anchor", "several"))
    shared = stored(seen.join(repeated, "anchor"))
    forget(seen, repeated)

    # Several contexts: those with more than one place are repeated as a whole; one place of each goes to the shards.
    several = shared.where("several").groupBy("anchor", "context")
    contexts = stored(several.agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")))
    many = stored(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MOST_MERGED).select("anchor"))
    # A merge join, as Spark splits a very common context there alone.
    again = contexts.where("n > 1").select("anchor", "context")
    whole = shared.where("NOT several").select("src", "size", "place", "before", "after").unionByName(
        shared.where("several").join(again.hint("merge"), ["anchor", "context"], "left_semi").select("src", "size", "place", "before", "after")
    )
    whole = whole.select("src", "size", span(F.col("place"), F.col("before"), F.col("after")).alias("range"))
    ask = F.struct("anchor", "one.place", "one.before", "one.after", F.col("hot").isNotNull().alias("hot"))
    asked = (
        contexts.join(many.withColumn("hot", F.lit(True)), "anchor", "left")
        .select("one.src", "one.size", ask.alias("ask"))
        .groupBy("src", "size")
        .agg(F.collect_list("ask").alias("asks"))  # no more than a text has anchors
    )
    asked = stored(asked)
    cut = stored(cut_contexts(rows.join(asked, ["src", "size"])))
    forget(asked, many)

    # Parts of hot anchors' contexts, which may come from several copies of a text.
    parts = cut.where("hot").dropDuplicates(["grp", "context", "src", "size", "low"])
    sizes = parts.groupBy("grp").agg(
        F.count(F.lit(1)).alias("m"), (F.min("context") != F.max("context")).alias("several")
    )
    parts = stored(cut.where("hot").join(stored(sizes.where("m > 1")), "grp"))
    alike = parts.where("NOT several").select(
        "src", "size", F.struct(F.col("low").alias("start"), (F.col("low") + F.octet_length("bytes")).alias("end")).alias("range")
    )
    windows = stored(window_rows(parts.where(F.col("several") & (F.col("m") > MOST_MERGED))).distinct())
    twice = stored(windows.groupBy("grp", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "window"))
    single = windows.join(twice, ["grp", "window"], "left_semi").select(
        "src", "size", F.struct("start", (F.col("start") + LENGTH).alias("end")).alias("range")
    )
    few = parts.where(F.col("several") & (F.col("m") <= MOST_MERGED))
    names = ("grp", "src", "size", "low", "bytes")
    sorted_ = shard_ranges(cut.where("NOT hot").select(*names).unionByName(few.select(*names)))
    sorted_ = sorted_.select("src", "size", F.struct("start", "end").alias("range"))

    found = whole.unionByName(alike).unionByName(single).unionByName(sorted_)
    # A table, so that Spark can split a text with very many copies in the join.
    per_src = stored(found.groupBy("src", "size").agg(F.collect_set("range").alias("ranges")))
    forget(shared, contexts, cut, parts, windows, twice)
    joined = rows.join(per_src, ["src", "size"], "left").select("key", "text", "ranges")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = merged(sorted((r["start"], r["end"]) for r in ranges or ()))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return joined.mapInArrow(finish, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))


QUERIES = {"op8_substrings": op8_substrings}
ORACLES: dict[str, str] = {}
