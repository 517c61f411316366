"""Near copies by the exact Jaccard similarity of word shingles.

Texts with one and the same set of shingles are one class, a node. With shingles
in any fixed order, two sets at least as similar as 4/5 share one of their first
n - ceil(4n/5) + 1 (prefix filter); the order is by hash, common shingles last.
Within a shared shingle, pairs are ruled out by their sizes and by the parity of
bucket counts, which differs in no more places than the sets do; then again by a
wider sketch. What is left is verified by the sets themselves, in rounds: nodes
meet by their first shingle alone at first, then by all of their prefixes where
no link has reached yet, and a node is tried with few others at first, with more
only while some are left. So a large group of near copies costs few pairs, and no
pair is left out.

Nodes are linked by SimHash too: those whose 64-bit fingerprints differ in 3 bits
or fewer are tried and verified with the pairs of the first round. Fingerprints
alone would lose near copies that differ in more bits; the rounds find these.

Shingles are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, per_text, small_batches, stored
from .simhash import components, fingerprint, key_rows, links

#: Words in a shingle; least similarity of near copies, as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Words of 64 buckets in a parity sketch.
SKETCH = 8
#: Nodes of one shingle up to which they are compared in one group; larger ones go in pairs of blocks.
BLOCK = 4_000
#: Others that a node is tried with within a shingle in the first round, and the growth from round to round.
TRIES, GROWTH = 4, 8
#: Common shingles come last in the order: one of so many documents is sampled, and so many of those hold them. Any
#: choice gives the same pairs.
SAMPLED, COMMON, MOST_COMMON = 16, 20, 20_000


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; none without words, one of all words if they are few."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, "u8")
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8"))


def node_of(hashes: np.ndarray) -> int:
    """Name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view("i8"))


def sketch_of(hashes: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 64 * SKETCH buckets."""
    counts = np.bincount((hashes >> np.uint64(32)).astype("i8") % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits(counts & 1 == 1).tobytes()


def wide_of(hashes: np.ndarray) -> bytes:
    """Parity in the next power of two buckets above 4 for a shingle; wide sketches fold onto narrower ones."""
    buckets = 1 << max(9, int(4 * len(hashes)).bit_length())
    counts = np.bincount((hashes >> np.uint64(24)).astype("i8") & (buckets - 1), minlength=buckets)
    return np.packbits(counts & 1 == 1).tobytes()


def may_be_near(size_a: int, wide_a: bytes, size_b: int, wide_b: bytes) -> bool:
    """False only for sets that aren't similar enough."""
    a, b = sorted((np.frombuffer(wide_a, "u1"), np.frombuffer(wide_b, "u1")), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    apart = int(np.bitwise_count(a ^ b).sum(dtype="i8"))
    return apart * (DENOMINATOR + NUMERATOR) <= (size_a + size_b) * (DENOMINATOR - NUMERATOR)


def prefix_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two near copies share one."""
    n = len(hashes)
    ordered = hashes[np.argsort(np.isin(hashes, common), kind="stable")] if len(common) else hashes
    return ordered[: n + NUMERATOR * -n // DENOMINATOR + 1 if n else 0]


def _common(df: DataFrame, text: str, key: str) -> np.ndarray:
    """Hashes of common shingles of a sample."""
    sample = df.where(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0)
    sets = per_text(sample, lambda texts: [(shingle_set(t).view("i8").tolist(),) for t in texts], "shingles array<bigint>", key, text)
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()
    return np.array([r["s"] for r in top], "i8").view("u8")


def _pairs(node: np.ndarray, size: np.ndarray, label: np.ndarray, sketch: np.ndarray, tries: int) -> tuple[list, list, bool]:
    """Pairs of nodes not yet linked that may be near copies, up to `tries` for the later one; whether there are more."""
    order = np.argsort(node)
    node, size, label, sketch = node[order], size[order], label[order], sketch[order]
    a, b, more = [], [], False
    if len(node) < 2 or (label == label[0]).all():
        return a, b, more
    for j in range(1, len(node)):
        total = size[:j] + size[j]
        fits = (label[:j] != label[j]) & (DENOMINATOR * np.minimum(size[:j], size[j]) >= NUMERATOR * np.maximum(size[:j], size[j]))
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        apart = np.bitwise_count(sketch[some] ^ sketch[j]).sum(axis=1, dtype="i8")
        some = some[apart * (DENOMINATOR + NUMERATOR) <= total[some] * (DENOMINATOR - NUMERATOR)]
        more |= len(some) > tries
        a += node[some[:tries]].tolist()
        b += [int(node[j])] * min(len(some), tries)
    return a, b, more


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that SimHash links; `prints` has node and fp. One node stands for all of its fingerprint."""
    low = stored(prints.groupBy("fp").agg(F.min("node").alias("low")))
    same = prints.join(low, "fp").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = links(key_rows(low)).join(low.toDF("a", "na"), "a").join(low.toDF("b", "nb"), "b")
    both = same.union(near.select("na", "nb")).where("a <> b")
    found = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(low)
    return found


def _candidates(shared: DataFrame, nodes: DataFrame, tries: int) -> DataFrame:
    """(key, a, b): pairs to be verified; a key with more of them has a row without a pair."""
    blocks = F.ceil(F.col("n_nodes") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    partners = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j"))
    )
    grouped = shared.join(nodes, "node").select("key", F.explode(partners).alias("pair"), "node", "size", "label", "sketch")

    def in_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; one is held at a time."""
        held: list[list] = []
        now = None

        def found() -> pa.RecordBatch | None:
            node, size, label = (np.concatenate([h[c] for h in held]) for c in range(3))
            sketch = np.frombuffer(b"".join(s for h in held for s in h[3]), "u8").reshape(-1, SKETCH)
            a, b, more = _pairs(node, size, label, sketch, tries)
            if not a:
                return None
            a, b = a + [None] * more, b + [None] * more
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"]
            )

        for batch in batches:
            key, i, j, node, size, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            sketch = batch.column(6).to_pylist()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(key)]):
                if at == end:
                    continue
                group = (int(key[at]), int(i[at]), int(j[at]))
                if group != now and held:
                    if (out := found()) is not None:
                        yield out
                    held.clear()
                now = group
                held.append([node[at:end], size[at:end], label[at:end], sketch[at:end]])
        if held and (out := found()) is not None:
            yield out

    spread = (
        grouped.select("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "size", "label", "sketch")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return spread.mapInArrow(in_group, "key bigint, a bigint, b bigint")


def _verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; `nodes` has node, first, size and wide."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            keep = [may_be_near(*x) for x in zip(*columns[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in range(2)], ["a", "b"])

    wide = nodes.select("node", "size", "wide")
    both = pairs.join(wide.toDF("a", "na", "wa"), "a").join(wide.toDF("b", "nb", "wb"), "b")
    left = stored(both.select("a", "b", "na", "wa", "nb", "wb").mapInArrow(near, "a bigint, b bigint"))

    # Whole sets only of what the sketches leave.
    needed = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = stored(nodes.select("node", F.col("first").alias(key)).join(needed, "node", "left_semi"))
    texts = df.select(key, F.col(text).alias("text")).join(rows, key).select("node", "text")
    sets = per_text(texts, lambda ts: [(node_of(s), s.view("i8").tolist()) for s in map(shingle_set, ts)], "own bigint, shingles array<bigint>", "node")
    # A key with several texts gives several sets, and equal rows the same one.
    sets = stored(sets.where("node = own").dropDuplicates(["node"]).select("node", "shingles"))
    with_sets = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    similar = shared * DENOMINATOR >= (F.size("sa") + F.size("sb") - shared) * NUMERATOR
    found = stored(with_sets.where(similar).select("a", "b"))
    forget(sets, left, rows)
    return found


def near_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component): the least key that links from near copy to near copy reach, for every row with a key.

    Null and empty texts are one class.
    """
    small_batches(df.sparkSession)
    df = df.where(F.col(key).isNotNull())
    common = _common(df, text, key)

    def work(texts: list[bytes]) -> list[tuple]:
        sets = [shingle_set(t) for t in texts]
        fps = np.array([fingerprint(t) for t in texts], "u8").view("i8").tolist()
        return [(node_of(s), len(s), fp, sketch_of(s), wide_of(s), prefix_of(s, common).view("i8").tolist()) for s, fp in zip(sets, fps)]

    schema = "node bigint, size bigint, fp bigint, sketch binary, wide binary, prefix array<bigint>"
    whole = stored(per_text(df, work, schema, key, text))
    prints = stored(whole.select(key, "node"))
    one = F.first(F.struct("size", "fp", "sketch", "wide", "prefix"))
    every = stored(whole.groupBy("node").agg(F.min(key).alias("first"), one.alias("x")).select("node", "first", "x.*"))
    forget(whole)
    firsts, nodes = every.select("node", "first"), every.select("node", "size", "sketch")
    # 40 bits of a shingle are enough for a key, and compress better.
    keys = every.select(F.posexplode("prefix").alias("at", "s"), "node").select("at", F.shiftrightunsigned("s", 24).alias("key"), "node")

    def in_common(keys: DataFrame) -> DataFrame:
        """(key, node, n_nodes) of the keys that several nodes have."""
        # Read from a table, so that Spark can split a key with very many nodes in the join.
        counts = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_nodes")).where("n_nodes > 1"))
        found = stored(keys.join(counts, "key").select("key", "node", "n_nodes"))
        forget(counts)
        return found

    # Near copies mostly have the same first shingle, so a first round by that alone links most of a large group; only then
    # do all shingles of the prefixes count.
    shared, first_round, tries = in_common(keys.where("at = 0")), True, TRIES

    def labelled(edges: DataFrame) -> DataFrame:
        roots = components(edges).withColumnRenamed("root", "label")
        return stored(firsts.join(roots, "node", "left").select("node", F.coalesce("label", "node").alias("label")))

    # SimHash's links and the first round's pairs are verified together: a verification of its own for the links costs
    # tens of Spark stages, and an executor's memory grows with every one.
    linked = _by_fingerprint(every.select("node", "fp"))
    edges, labels = None, firsts.select("node", F.col("node").alias("label"))
    while True:
        # A key whose nodes are all linked already has no pair left; in the first round none are linked.
        ends = shared.join(labels, "node").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        live = None if first_round else stored(ends.where("low < high").select("key"))
        left = shared if first_round else shared.join(live, "key", "left_semi")
        found = stored(_candidates(left, nodes.join(labels, "node"), tries))
        pairs = found.where("a IS NOT NULL").select("a", "b")
        pairs = stored((pairs.union(linked) if first_round else pairs).distinct())
        new = _verified(pairs, df, every, text, key)
        if first_round:
            edges, labels = new, labelled(new)
            forget(found, pairs, shared, linked)
            shared, first_round = in_common(keys), False
            continue
        both = stored(edges.union(new).distinct())
        forget(live, edges, new, labels)
        edges, labels = both, labelled(both)
        more = stored(found.where("a IS NULL").select("key").distinct())
        forget(found, pairs)
        if more.isEmpty():
            break
        left = stored(shared.join(more, "key", "left_semi"))
        forget(shared, more)
        shared, tries = left, tries * GROWTH
    rooted = firsts.join(labels, "node")
    rooted = stored(rooted)
    forget(every, labels, shared)
    least = stored(rooted.groupBy("label").agg(F.min("first").alias("component")))
    named = stored(rooted.join(least, "label").select("node", "component"))
    forget(rooted, least)
    return prints.select(key, "node").join(named, "node").select(key, "component")
