"""Fingerprints as trees of digests: equal corpora have equal roots, and two that differ are compared by going down.

A node covers a range of integer keys, FAN ranges of the level below, so no group holds
more than FAN digests, however large the corpus. Levels are the same for every
corpus, so their nodes can be compared. Rows that share a key have one digest made of
all of theirs, whatever their order; rows without a key have no part in the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.scratch import stored
from ..sources.tables import table

#: Children of a node, and levels below the root: keys of up to FAN ** LEVELS are parted to the end.
FAN, LEVELS = 100, 5


# --- operators --------------------------------------------------------------------------------------------------------


def keyed_digests(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, n, digest), one row for each key; a missing digest counts as that of nothing."""
    d = F.coalesce(F.col(digest), F.lit(""))
    sums = F.sum(F.xxhash64(d).cast("decimal(38,0)")).cast("string")
    agg = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("a"), F.max(d).alias("b"), sums.alias("s"))
    return agg.select("key", "n", F.when(F.col("n") == 1, F.col("a")).otherwise(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "a", "b", "s"), 256)).alias("digest"))


def digest_tree(rows: DataFrame, key: str, digest: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(level, block, n, digest): level 0 has the keys themselves, block b of a level the blocks b * fan and on below it.

    The root is block 0 of level `levels` + 1 and covers all; an empty corpus has
    none. n counts rows.
    """
    below = stored(keyed_digests(rows, key, digest).select(F.lit(0).alias("level"), F.col("key").alias("block"), "n", "digest"))
    every = below
    for level in range(1, levels + 2):
        up = F.floor(F.col("block") / fan) if level <= levels else F.lit(0).cast("bigint")
        line = F.struct("block", F.concat_ws(":", F.col("block").cast("string"), "digest").alias("line"))
        group = below.groupBy(up.alias("up")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(line)).alias("x"))
        node = F.sha2(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), 256)
        below = stored(group.select(F.lit(level).alias("level"), F.col("up").alias("block"), "n", node.alias("digest")))
        every = every.unionByName(below)
    return every


def differing(ours: DataFrame, theirs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(key, change): keys in which two trees differ, `added` by ours, `removed` from theirs or `changed`.

    Goes down from the root through nodes that differ alone; of a level it reads
    the children of those.
    """
    front = None
    for level in range(levels + 1, -1, -1):
        a, b = (t.where(F.col("level") == level).select("block", F.col("digest").alias(n)) for t, n in ((ours, "a"), (theirs, "b")))
        if front is not None:
            up = F.floor(F.col("block") / fan) if level < levels else F.lit(0).cast("bigint")
            a, b = (t.join(front.select(F.col("block").alias("up")), up == F.col("up"), "left_semi") for t in (a, b))
        front = stored(a.join(b, "block", "full").where("NOT a <=> b"))
        if front.isEmpty():
            break
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return front.select(F.col("block").alias("key"), change.alias("change"))


# --- queries ----------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.text_of("text"), 256).alias("h"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's digest of the documents."""
    root = digest_tree(_documents(spark, sf_dir), "doc_id", "h").where(F.col("level") == LEVELS + 1)
    return root.select("n", F.col("digest").alias("fingerprint"))


def digest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes above the documents themselves."""
    return digest_tree(_documents(spark, sf_dir), "doc_id", "h").where("level > 0")


def edition_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ from the edition before (`lexical_index`), found by going down two trees."""
    from .lexical_index import _earlier

    before = _earlier(spark, sf_dir).select("doc_id", F.sha2(T.text_of("text"), 256).alias("h"))
    return differing(digest_tree(_documents(spark, sf_dir), "doc_id", "h"), digest_tree(before, "doc_id", "h"))


QUERIES = {f.__name__: f for f in (corpus_fingerprint, digest_levels, edition_changes)}

_TREE = "l0 AS (SELECT doc_id AS block, 1::BIGINT AS n, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL)" + "".join(
    f""", l{i} AS (SELECT {f'block // {FAN}' if i <= LEVELS else '0::BIGINT'} AS up, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(block || ':' || digest, chr(10) ORDER BY block)) AS digest
        FROM {'l0' if i == 1 else f'(SELECT up AS block, n, digest FROM l{i - 1})'} GROUP BY 1)"""
    for i in range(1, LEVELS + 2)
)
ORACLES = {
    "corpus_fingerprint": f"WITH {_TREE} SELECT n, digest AS fingerprint FROM l{LEVELS + 1}",
    "digest_levels": f"WITH {_TREE} " + " UNION ALL ".join(f"SELECT {i} AS level, up AS block, n, digest FROM l{i}" for i in range(1, LEVELS + 2)),
    "edition_changes": """WITH b AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' earlier edition' ELSE text END AS text FROM documents WHERE source <> 'src0'
          UNION ALL SELECT -1 - item_id, text FROM benchmark)
        SELECT coalesce(d.doc_id, b.doc_id) AS key, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM documents d FULL JOIN b USING (doc_id) WHERE d.doc_id IS NULL OR b.doc_id IS NULL OR d.text IS DISTINCT FROM b.text""",
}
