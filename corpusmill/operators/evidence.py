"""Fenced evidence: blocks that say which file they were taken from, held against that file as it is now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..sources.scratch import stored
from ..sources.tables import table

#: A closed block: from a line that begins with a fence to the next line that begins with the same one. An open one is none.
FENCE = r"(?ms)^(```+|~~~+)([^\n]*)\n(.*?)^\1[^\n]*$"
#: What the opening line of evidence ends with (fixed pattern); blocks looked at in a text, and paths named for it.
MARKER = r"evidence:\s*([^\s:]+):(\d+)-(\d+)\s*$"
MOST_BLOCKS, MOST_PATHS = 16, 4


# --- operators --------------------------------------------------------------------------------------------------------


def evidence_fences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, path, start, end, content) of the first MOST_BLOCKS blocks of a text with a marker, places from 1.

    Fences may hold shorter ones; blocks without a marker are documentation. A
    null text has none.
    """
    body = T.text_of(text)
    blocks = F.arrays_zip(F.regexp_extract_all(body, F.lit(FENCE), F.lit(2)).alias("info"), F.regexp_extract_all(body, F.lit(FENCE), F.lit(3)).alias("content"))
    marked = F.slice(F.filter(blocks, lambda b: F.rlike(b["info"], F.lit(MARKER))), 1, MOST_BLOCKS)
    # Most texts have no marker at all.
    some = docs.where(F.contains(body, F.lit("evidence:"))).select(F.col(key).alias("key"), F.posexplode(marked).alias("place", "b"))
    part = lambda n: F.regexp_extract("b.info", MARKER, n)
    return some.select(
        F.col("key").alias(key), (F.col("place") + 1).alias("place"), part(1).alias("path"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end"),
        F.regexp_replace("b.content", r"\n\z", "").alias("content"),
    )


def diff_post_image(content: Column) -> Column:
    """What a block that looks like a diff leaves: added and kept lines without their marks; null for other blocks."""
    lines = F.filter(F.split(content, "\n", -1), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^(diff --git|index |--- |\+\+\+ |@@)")))
    first = lambda x: F.substring(x, 1, 1)
    shaped = F.exists(lines, lambda x: first(x).isin("+", "-")) & F.forall(lines, lambda x: first(x).isin("+", "-", " "))
    kept = F.transform(F.filter(lines, lambda x: first(x).isin("+", " ")), lambda x: F.substr(x, F.lit(2)))
    post = F.btrim(F.array_join(kept, "\n"), F.lit("\n"))
    return F.when(shaped & (post != ""), post)


def squeezed(text: Column) -> Column:
    """Lines with white space collapsed and ends trimmed, blank ones dropped."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def match_levels(fences: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content, level) of every different pair: how a block stands in the file (path, text) that it names.

    `exact`: it, or what its diff leaves, is a part of the file; `whitespace`: it
    is once white space within lines is collapsed on both sides; else `missing`,
    as for a file that isn't there. A pair is looked at once, however many texts
    cite it; texts of files that nothing cites aren't read further than their path.
    """
    pairs = stored(fences.select("path", "content").distinct())
    held = files.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text")
    held = held.join(pairs.select("path").distinct(), "path", "left_semi")
    joined = pairs.join(held, "path", "left").withColumn("post", diff_post_image(F.col("content"))).withColumn("raw", F.btrim("content", F.lit("\n")))
    exact = ((F.col("raw") != "") & F.contains("text", "raw")) | F.contains("text", "post")
    flat = squeezed(F.col("text"))
    loose = ((squeezed(F.col("raw")) != "") & F.contains(flat, squeezed(F.col("raw")))) | ((squeezed(F.col("post")) != "") & F.contains(flat, squeezed(F.col("post"))))
    level = F.when(F.coalesce(exact, F.lit(False)), 0).when(F.coalesce(loose, F.lit(False)), 1).otherwise(2)
    # Of several files with a path, the best counts.
    best = joined.groupBy("path", "content").agg(F.min(level).alias("level"))
    return best.select("path", "content", F.element_at(F.lit(["exact", "whitespace", "missing"]), F.col("level") + 1).alias("level"))


def evidence_drift(docs: DataFrame, files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fences, missing, whitespace, paths) of texts with one or more missing blocks; paths of those, in order, joined by commas."""
    fences = stored(evidence_fences(docs, key, text))
    levels = fences.join(match_levels(fences, files), ["path", "content"])
    gone = F.col("level") == "missing"
    each = levels.groupBy(key).agg(
        F.count(F.lit(1)).alias("fences"), F.count_if(gone).alias("missing"), F.count_if(F.col("level") == "whitespace").alias("whitespace"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(gone, F.col("path")))), 1, MOST_PATHS), ",").alias("paths"),
    )
    return each.where("missing > 0")


# --- queries ----------------------------------------------------------------------------------------------------------


def document_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each is cited, with its first three lines, by those that come next with its first sentence, as
    they stand there; which of these citations don't hold."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    name = F.trim(F.regexp_extract(T.text_of("text"), r"^[^.!?\n]*", 0))
    lines = F.array_join(F.slice(F.split(T.text_of("text"), "\n", -1), 1, 3), "\n")
    named = d.select("doc_id", name.alias("name"), lines.alias("lines")).where("name <> ''")
    several = stored(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    before = F.lag("doc_id").over(W.partitionBy("name").orderBy("doc_id"))
    citing = named.join(several, "name").withColumn("cited", before).where("cited IS NOT NULL")
    block = F.concat(F.lit("~~~~~~ evidence: documents/"), F.col("cited").cast("string"), F.lit(":1-3\n"), "lines", F.lit("\n~~~~~~\n"))
    files = d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return evidence_drift(citing.select("doc_id", block.alias("text")), files)


QUERIES = {"document_drift": document_drift}

_FLAT = r"array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
ORACLES = {
    "document_drift": rf"""WITH n AS (SELECT doc_id, text, trim(regexp_extract(text, '^[^.!?\n]*')) AS name, trim(array_to_string(string_split(text, chr(10))[1:3], chr(10)), chr(10)) AS lines FROM documents),
        c AS (SELECT doc_id, lines, lag(doc_id) OVER (PARTITION BY name ORDER BY doc_id) AS cited FROM n WHERE name <> '' QUALIFY cited IS NOT NULL),
        l AS (SELECT c.doc_id, cited, CASE WHEN contains(f.text, lines) THEN 0 WHEN contains({_FLAT.format('f.text')}, {_FLAT.format('lines')}) THEN 1 ELSE 2 END AS level FROM c JOIN documents f ON f.doc_id = cited)
        SELECT doc_id, 1::BIGINT AS fences, 1::BIGINT AS missing, 0::BIGINT AS whitespace, 'documents/' || cited AS paths FROM l WHERE level = 2""",
}
