"""SimHash near-duplicates with Golay-code keys.

A fingerprint is cut into four segments of 16 bits. Two fingerprints that differ
in at most 3 bits have a segment i that is equal and whose next segment i+1 (in a
circle) differs in at most one bit: of the segments without an error, at most one
precedes the only one that may hold two or more. Each segment, padded to 23 bits,
is decoded in the perfect binary Golay code. A word within 2 bits of its codeword
keeps the codeword when one bit flips; a word at distance 3 also takes the five
codewords at distance 4, and so shares one with every word one bit away. So a
fingerprint has 1 or 6 keys for each i: (i, segment i, codeword near segment i+1),
and fingerprints to be linked share at least one of them. Pairs with a common key
are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored, per_text, small_batches, table

#: Words in a shingle; bits that linked fingerprints may differ in.
SHINGLE, RADIUS = 3, 3
#: Generator polynomial of the (23, 12) Golay code (fixed value).
GENERATOR = 0xC75
#: Fingerprints with one key up to which they are compared in one group; larger keys go in pairs of blocks.
BLOCK = 20_000


# --- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(data: bytes) -> int:
    """SimHash of a text's word shingles; 0 without words."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8")
    # Set bits per place, in slices so that a long text takes no more memory than a short one.
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long): the fingerprint of every whole text as a signed number. A null text is an empty one."""

    def work(texts: list[bytes]) -> list[tuple]:
        return [(f - (1 << 64) if f >> 63 else f,) for f in map(fingerprint, texts)]

    return per_text(df, work, "fp bigint", key, text)


# --- Golay keys -------------------------------------------------------------------------------------------------------


def _weight(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype("u8")).astype("i8")


def golay_codewords() -> np.ndarray:
    """All 4096 codewords by their message of 12 bits."""
    words = np.zeros(4096, "i8")
    for bit in range(12):
        words[(np.arange(4096) >> bit & 1) == 1] ^= GENERATOR << bit
    return words


def segment_keys() -> np.ndarray:
    """For every segment value its codewords' messages, six columns, -1 where there are fewer.

    The first is the codeword within distance 3; the others, for words at
    distance 3, are those at distance 4.
    """
    values, code = np.arange(1 << 16, dtype="u4"), golay_codewords().astype("u4")
    keys = np.full((1 << 16, 6), -1, "i4")
    for at in range(0, len(values), 256):  # a slice has 256 x 4096 distances, so that a worker's memory stays small
        far = np.bitwise_count(values[at : at + 256, None] ^ code[None, :])
        rows = np.arange(far.shape[0])
        near = far.argmin(axis=1)
        keys[at : at + 256, 0] = near
        edge = rows[far[rows, near] == 3]
        if len(edge):
            _, columns = np.nonzero(far[edge] == 4)
            keys[at + edge, 1:] = columns.reshape(len(edge), 5)
    return keys


_KEYS: list[np.ndarray] = []


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys of unsigned fingerprints."""
    if not _KEYS:
        _KEYS.append(segment_keys())
    rows, keys = [], []
    for i in range(4):
        same = (fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype("i8")
        near = (fps >> np.uint64(16 * ((i + 1) % 4)) & np.uint64(0xFFFF)).astype("i8")
        codes = _KEYS[0][near].astype("i8")
        row, column = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append(i << 28 | same[row] << 12 | codes[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def key_rows(distinct: DataFrame) -> DataFrame:
    """(key, fp) of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = keys_of(fps.view("u8"))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fps[row], pa.int64())], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


# --- links ------------------------------------------------------------------------------------------------------------


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the least of its component within this group.

    Every fingerprint is compared with those not yet reached, which ends soon
    where a group is dense, and where it is sparse the group is small.
    """
    order = np.argsort(fps)
    bits = fps[order].view("u8")
    label = np.full(len(bits), -1, "i8")
    left = np.arange(len(bits))
    while len(left):
        first, frontier, left = left[0], [left[0]], left[1:]
        label[first] = first
        while frontier and len(left):
            near = _weight(bits[left] ^ bits[frontier.pop()]) <= radius
            if near.any():
                hit = left[near]
                label[hit] = first
                frontier += hit.tolist()
                left = left[~near]
    out = np.empty(len(fps), "i8")
    out[order] = fps[order][label]
    return out


def links(keys: DataFrame) -> DataFrame:
    """(a, b) edges that connect what links within each key: each fingerprint with its group's least.

    A key held by more than BLOCK fingerprints is dealt out in blocks, and every
    pair of blocks is a group, so no task takes the whole of it.
    """
    # Read from a table, so that Spark can split a key with very many fingerprints in the join.
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    shared = keys.join(sizes, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    partners = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j"))
    )
    grouped = shared.select("key", "fp", F.explode(partners).alias("pair"))

    def in_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; one is held at a time."""
        held: list[np.ndarray] = []
        now = None

        def edges() -> pa.RecordBatch | None:
            fps = np.concatenate(held)
            if len(fps) < 2:
                return None
            least = linked(fps)
            keep = least != fps
            return pa.RecordBatch.from_arrays([pa.array(fps[keep]), pa.array(least[keep])], ["a", "b"]) if keep.any() else None

        for batch in batches:
            key, i, j, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(key)]):
                if at == end:
                    continue
                group = (key[at], i[at], j[at])
                if group != now and held:
                    if (out := edges()) is not None:
                        yield out
                    held.clear()
                now = group
                held.append(fp[at:end])
        if held and (out := edges()) is not None:
            yield out

    spread = (
        grouped.select("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "fp")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return spread.mapInArrow(in_group, "a bigint, b bigint").distinct()


# --- components -------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have an edge.

    Every round each node takes the least label among its neighbours, then the
    label of its label; rounds end when no label changes. Labels are written to
    the shared checkpoint folder each round.
    """
    both = stored(edges.union(edges.select(F.col("b"), F.col("a"))).toDF("node", "peer"))
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("root")))
    while True:
        offered = both.join(labels.toDF("peer", "offer"), "peer").groupBy("node").agg(F.min("offer").alias("offer"))
        taken = labels.join(offered, "node").select("node", "root", F.least("root", "offer").alias("taken"))
        taken = stored(taken)
        if taken.where("taken < root").isEmpty():
            return labels
        step = taken.select("node", F.col("taken").alias("via"))
        jump = taken.select(F.col("node").alias("via"), F.col("taken").alias("next"))
        labels = stored(step.join(jump, "via", "left").select("node", F.coalesce("next", "via").alias("root")))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component): every row's fingerprint and the least key that links reach from it.

    Equal fingerprints always link, those of texts without words (0) like any
    other. Null and empty texts have fingerprint 0. Rows with a null key get a
    component through their fingerprint, but never name one. Repeated rows stay.
    """
    small_batches(df.sparkSession)
    prints = stored(fingerprints(df, text, key))
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(links(key_rows(distinct)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component")))
    named = stored(rooted.join(least, "root").select("fp", "component"))
    return prints.join(named, "fp").select(key, "fp", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
