"""Text lint: invisible characters, mixed scripts, hidden markup, exfiltration shapes, portability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.oracle import tokens_sql
from ..sources.tables import table

#: Character classes (fixed values).
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]"
TAGS = r"[\x{E0000}-\x{E007F}]"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
#: Shapes of text that carries data out, and of text bound to one machine.
EXFIL = r"(?i)!\[[^\]]*\]\(https?://[^)\s]*\?[^)\s]*=[^)\s]*\)|https?://\S+\?(?:\S*&)?(?:data|token|secret|payload|key)=\S+"
HOME_PATH = r"(/(?:Users|home)/[A-Za-z0-9._/-]+)"
GIT_REMOTE = r"(git@[A-Za-z0-9_.-]+:[A-Za-z0-9_./~-]+)"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def invisible(text: Column) -> Column:
    """struct of counts; a joiner between two emoji isn't counted."""
    joined = F.regexp_replace(text, rf"({EMOJI})\x{{200D}}(?={EMOJI})", "$1")
    return F.struct(
        count_of(joined, ZERO_WIDTH).alias("zero_width"),
        count_of(text, BIDI).alias("bidi"),
        count_of(text, TAGS).alias("tags"),
        count_of(text, PRIVATE).alias("private_use"),
    )


def mixed_script(text: Column) -> Column:
    """Words that mix Latin with Cyrillic or Greek letters."""
    word = r"(?U)\b(?=\w*\p{IsLatin})(?=\w*[\p{IsCyrillic}\p{IsGreek}])\w+\b"
    return count_of(text, word)


def html_comments(text: Column) -> Column:
    return count_of(T.mask_code(text), r"(?s)<!--.*?-->")


def lint_flags(text: Column) -> Column:
    """Kinds of findings in a fixed order, each once."""
    i = invisible(text)
    kinds = F.array(
        F.when(i["zero_width"] > 0, "zero-width"), F.when(i["bidi"] > 0, "bidi"), F.when(i["tags"] > 0, "tag"),
        F.when(i["private_use"] > 0, "private-use"), F.when(mixed_script(text) > 0, "mixed-script"),
        F.when(html_comments(text) > 0, "html-comment"), F.when(F.rlike(text, F.lit(EXFIL)), "exfil"),
    )
    return F.filter(kinds, lambda k: k.isNotNull())


# --- queries ----------------------------------------------------------------------------------------------------------


def page_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    t = T.text_of("html")
    return p.select(
        "page_id", html_comments(t).alias("n_comments"), F.rlike(t, F.lit(EXFIL)).alias("exfil"),
        count_of(t, r"(?i)<script\b").alias("n_scripts"), F.array_join(lint_flags(t), ",").alias("flags"),
    )


def invisible_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = invisible(T.text_of("text"))
    return d.select("doc_id", i.alias("i")).select("doc_id", "i.zero_width", "i.bidi", "i.private_use")


def non_latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each document and the share outside A-Z, among documents of forty letters or more."""
    t = T.text_of("text")
    d = table(spark, sf_dir, "documents").select("doc_id", count_of(t, r"\p{L}").alias("letters"), count_of(t, "[A-Za-z]").alias("plain"))
    return d.where("letters >= 40").select("doc_id", "letters", F.round(1 - F.col("plain") / F.col("letters"), 6).alias("share"))


def portability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses, user paths and remotes named in documents, each once."""
    d = table(spark, sf_dir, "documents")
    t = T.text_of("text")
    mail = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+)"), F.lit(1))
    found = lambda kind, xs: F.transform(F.array_distinct(xs), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    every = F.concat(
        found("mail", mail),
        found("path", F.regexp_extract_all(t, F.lit(HOME_PATH), F.lit(1))),
        found("remote", F.regexp_extract_all(t, F.lit(GIT_REMOTE), F.lit(1))),
    )
    return d.select("doc_id", F.explode(every).alias("f")).select("doc_id", "f.kind", "f.value")


def intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How query-like each passage is: share of identifier-like tokens, and the weights of lexical and dense ranking."""
    b = table(spark, sf_dir, "benchmark")
    toks = T.tokens(T.text_of("text"))
    ids = F.size(F.regexp_extract_all(T.text_of("text"), F.lit(r"([A-Za-z]+_[A-Za-z_]+|[a-z]+[A-Z][A-Za-z]*|[A-Za-z]+\d+)"), F.lit(1)))
    r = b.select("item_id", F.size(toks).alias("n"), ids.alias("ids"))
    share = F.col("ids") / F.greatest("n", F.lit(1))
    lexical = F.when(F.col("n") < 8, 1.0).when(share >= 0.35, 1.3).when(share <= 0.10, 0.7).otherwise(1.0)
    return r.select("item_id", F.col("n").cast("bigint").alias("n"), lexical.alias("lexical"), (2 - lexical).alias("dense"))


def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First meaningful line of each document, cut to 220 characters with an ellipsis."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.first_line(T.text_of("text")).alias("x"))
    cut = F.when(F.length("x") > 220, F.concat(F.substring("x", 1, 219), F.lit("…"))).otherwise(F.col("x"))
    return d.select("doc_id", cut.alias("line"))


def mined_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight identifiers (dotted names, hex digests, mixed words) of each document, longest first, then first seen."""
    d = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all(T.text_of("text"), F.lit(r"([A-Za-z0-9]+(?:[._@-][A-Za-z0-9]+)+|[0-9a-f]{12,})"), F.lit(1))
    ranked = F.array_sort(F.transform(F.array_distinct(found), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("at"), x.alias("x"))))
    best = F.array_join(F.transform(F.slice(ranked, 1, 8), lambda r: r["x"]), " ")
    return d.select("doc_id", best.alias("ids")).where("ids <> ''")


QUERIES = {
    f.__name__: f
    for f in (page_lint, invisible_unicode, non_latin_share, portability, intent_weights, line_summary, mined_identifiers)
}

ORACLES = {
    "invisible_unicode": r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]')) AS zero_width,
        len(regexp_extract_all(text, '[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]')) AS bidi,
        len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]')) AS private_use FROM documents""",
    "non_latin_share": r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '[A-Za-z]')) AS plain FROM documents)
        SELECT doc_id, letters, round(1 - plain / letters, 6) AS share FROM d WHERE letters >= 40""",
    "portability": r"""SELECT DISTINCT doc_id, kind, unnest(vs) AS value FROM (
        SELECT doc_id, 'mail' AS kind, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+') AS vs FROM documents UNION ALL
        SELECT doc_id, 'path', regexp_extract_all(text, '/(?:Users|home)/[A-Za-z0-9._/-]+') FROM documents UNION ALL
        SELECT doc_id, 'remote', regexp_extract_all(text, 'git@[A-Za-z0-9_.-]+:[A-Za-z0-9_./~-]+') FROM documents)""",
    "intent_weights": rf"""WITH t AS (SELECT item_id, count(*) AS n FROM ({tokens_sql('item_id', 'benchmark')}) GROUP BY 1),
        r AS (SELECT item_id, coalesce(n, 0) AS n, len(regexp_extract_all(text, '[A-Za-z]+_[A-Za-z_]+|[a-z]+[A-Z][A-Za-z]*|[A-Za-z]+\d+')) / greatest(coalesce(n, 0), 1) AS share
          FROM benchmark LEFT JOIN t USING (item_id)),
        w AS (SELECT item_id, n, CASE WHEN n < 8 THEN 1.0 WHEN share >= 0.35 THEN 1.3 WHEN share <= 0.10 THEN 0.7 ELSE 1.0 END::DOUBLE AS lexical FROM r)
        SELECT item_id, n, lexical, 2 - lexical AS dense FROM w""",
    "line_summary": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        f AS (SELECT doc_id, arg_min(trim(x), i) AS x FROM l WHERE length(trim(x)) >= 8 AND NOT starts_with(trim(x), '```') GROUP BY 1)
        SELECT doc_id, CASE WHEN length(x) > 220 THEN left(x, 219) || '…' ELSE x END AS line FROM documents LEFT JOIN f USING (doc_id)""",
    "mined_identifiers": r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+(?:[._@-][A-Za-z0-9]+)+|[0-9a-f]{12,}') AS xs FROM documents),
        u AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM m) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) AS n FROM u)
        SELECT doc_id, string_agg(x, ' ' ORDER BY n) AS ids FROM r WHERE n <= 8 GROUP BY 1""",
}
