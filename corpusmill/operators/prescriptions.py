"""Sentences that say what people want, and whether the text gives a ground for them.

A span is a role with a verb of wanting in prose. Spans behind a condition or a
question, and those that set one thing off against another, don't count. A span is
grounded if the text has a rationale line, or if a content word of its sentence
stands in a fenced block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from .evidence import FENCE
from ..sources.tables import table

#: Roles, adverbs, verbs that need an adverb, verbs that don't, words of a condition before a span, and words of a
#: sentence that ground nothing (fixed values).
ROLES = "user owner maintainer developer author team reviewer".split()
ADVERBS = "always never really generally usually typically".split()
HABITS = r"wants? prefers? likes? dislikes? hates? needs? expects? insists? cares?\s+about values?".split()
WANTS = r"wants? prefers? insists?\s+on expects? requires? is\s+annoyed\s+by doesn't\s+want".split()
GUARDS = "if whether confirm unless when ask check does do would should what which".split()
SCAFFOLD = """
    the a an and or of to in on for with is are be it this that each such any all them they he she we you i
    user owner maintainer developer author team reviewer wants want prefers prefer always never needs need
    expects expect likes like values value insists insist
""".split()
#: Characters before a span in which a condition counts, and behind it in which a contrast does.
BEFORE, BEHIND = 40, 60
SPAN = rf"(?i)\bthe\s+(?:{'|'.join(ROLES)})\s+(?:(?:{'|'.join(ADVERBS)})\s+(?:{'|'.join(HABITS)})|(?:{'|'.join(WANTS)}))\b"
_GUARD = rf"(?i)\b(?:{'|'.join(GUARDS)})\s+\S*\s*$"
_CONTRAST = r"^\s+\S+[^\n]{0,40}?,\s*not\b"
_RATIONALE = r"(?mi)^\s*Rationale:\s*\S"


# --- operators --------------------------------------------------------------------------------------------------------


def _places(hits: Column, gaps: Column) -> Column:
    """Where each hit begins, from 0: passes of doubled reach over lengths, so a text with many hits stays cheap."""
    steps = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
    rounds = F.when(F.size(steps) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    add = lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    return F.aggregate(rounds, steps, add)


def prescriptive_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, span, sentence) of the spans that count, in prose, each wording of a text once (its first place).

    Texts without a span have no row, null texts none either. Places are those
    in the prose, in which every fenced block is one line break.
    """
    prose = F.regexp_replace(T.text_of(text), FENCE, "\n")
    cut = docs.select(F.col(key).alias("key"), prose.alias("prose")).where(F.rlike("prose", F.lit(SPAN)))
    found = cut.select("key", "prose", F.regexp_extract_all("prose", F.lit(SPAN), F.lit(0)).alias("hits"), F.split("prose", SPAN, -1).alias("gaps"))
    pairs = F.arrays_zip(F.col("hits").alias("span"), _places(F.col("hits"), F.col("gaps")).alias("start"))
    rows = found.select("key", "prose", F.explode(pairs).alias("x")).select("key", "prose", "x.span", "x.start")
    before = F.expr(f"substring(prose, greatest(start - {BEFORE}, 0) + 1, least(start, {BEFORE}))")
    behind = F.expr(f"substring(prose, start + length(span) + 1, {BEHIND})")
    counted = rows.where(~F.rlike(before, F.lit(_GUARD)) & ~F.rlike(behind, F.lit(_CONTRAST)))
    # The sentence: from the last stop or line break before the span to the next one.
    head = F.regexp_extract(F.expr("substring(prose, 1, start)"), r"[^.\n]*\z", 0)
    tail = F.regexp_extract(F.expr("substring(prose, start + 1)"), r"^[^.\n]*", 0)
    each = counted.select("key", "start", "span", F.concat(head, tail).alias("sentence"))
    first = each.groupBy("key", F.lower("span").alias("low")).agg(F.min(F.struct("start", "span", "sentence")).alias("x"))
    return first.select(F.col("key").alias(key), "x.start", "x.span", "x.sentence")


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_spans, n_ungrounded, kind): `observation` without spans, `grounded`, or `ungrounded`; a row for each key.

    Rows that share a key are one text after the other.
    """
    body = T.text_of(text)
    fenced = F.lower(F.array_join(F.regexp_extract_all(body, F.lit(FENCE), F.lit(3)), "\n"))
    rows = docs.select(F.col(key).alias("key"), F.rlike(body, F.lit(_RATIONALE)).alias("reason"), fenced.alias("fenced"))
    evidence = rows.groupBy("key").agg(F.max("reason").alias("reason"), F.array_join(F.array_sort(F.collect_set("fenced")), "\n").alias("fenced"))
    spans = prescriptive_spans(docs, key, text).select(F.col(key).alias("key"), "start", "sentence")
    words = F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit(r"([A-Za-z][A-Za-z0-9_-]{2,})"), F.lit(1)), lambda w: F.lower(w)))
    content = F.filter(words, lambda w: ~w.isin(SCAFFOLD))
    judged = spans.join(evidence, "key").select("key", (F.col("reason") | F.exists(content, lambda w: F.contains(F.col("fenced"), w))).alias("ground"))
    counts = judged.groupBy("key").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(~F.col("ground")).alias("n_ungrounded"))
    kind = F.when(F.col("n_spans") == 0, "observation").when(F.col("n_ungrounded") == 0, "grounded").otherwise("ungrounded")
    whole = evidence.select("key").join(counts, "key", "left").na.fill(0, ["n_spans", "n_ungrounded"])
    return whole.select(F.col("key").alias(key), "n_spans", "n_ungrounded", kind.alias("kind"))


# --- queries ----------------------------------------------------------------------------------------------------------


def prescription_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by class. The given texts are invented words, so a document also says what its source wants, and its
    language says how: some under a condition, some with a fenced block that holds a word of the sentence."""
    d = table(spark, sf_dir, "documents")
    role = F.element_at(F.lit(ROLES), (F.substring("source", 4, 3).cast("int") % len(ROLES) + 1).cast("int"))
    word = F.regexp_extract(T.text_of("text"), "([a-z]{4,})", 1)
    # A sentence comes first, so that the last words of a document's own text are no condition of what is said.
    said = F.concat(F.lit("\nIt is so. The "), role, F.lit(" always wants "), word, F.lit(" first.\n"))
    asked = F.concat(F.lit("\nAsk whether the "), role, F.lit(" wants "), word, F.lit(".\n"))
    fence = F.concat(F.lit("```\nrun "), word, F.lit("\n```\n"))
    end = F.when(F.col("lang") == "en", said).when(F.col("lang") == "de", asked).when(F.col("lang") == "fr", F.concat(said, fence)).otherwise("")
    found = classified(d.select("doc_id", F.concat(T.text_of("text"), end).alias("text")))
    return found.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_spans").alias("spans"))


QUERIES = {"prescription_classes": prescription_classes}

ORACLES = {
    # What the classes must be, from how the texts are made.
    "prescription_classes": """WITH d AS (SELECT lang, regexp_extract(coalesce(text, ''), '([a-z]{4,})', 1) AS word FROM documents)
        SELECT lang, CASE WHEN lang = 'en' OR lang = 'fr' AND length(word) < 3 THEN 'ungrounded' WHEN lang = 'fr' THEN 'grounded' ELSE 'observation' END AS kind,
          count(*) AS n, CAST(sum(CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END) AS BIGINT) AS spans FROM d GROUP BY 1, 2""",
}
