"""Text analysis as column expressions: tokens, stems, chunks, slugs, code masking.

All of it stays in the JVM. A null text behaves like an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: English words that carry no content (fixed values).
STOPWORDS = """
    a an the of to in on for and or but is are was were be been being it its this that these those
    with without within into onto from by as at via per vs not no nor so than then thus too very
    can could should would may might must will shall do does did done has have had having
    if else when while where which who whom whose what why how all any each few more most other some
    such only own same about above below over under again further once here there both
    we you they i he she them our your their he's also new now use used using up out off down
""".split()
#: Plurals in -ies whose singular isn't in -y (fixed values).
IES_WORDS = "series species movies cookies selfies veggies zombies genies rookies calories ties pies prairies".split()

WORD = r"[\p{L}\p{N}_]+"
#: Scripts without spaces between words: Han, Hiragana, Katakana, Hangul (fixed ranges).
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7A3}"


def text_of(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def keeps(word: Column) -> Column:
    """Whether a plain word is a token: two characters or more, and no stopword."""
    return (F.length(word) >= 2) & ~word.isin(STOPWORDS)


def cjk_bigrams(run: Column) -> Column:
    """Overlapping pairs of a run's characters; the run itself if it is one character."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))
    )
    return F.when(F.length(run) < 2, F.array(run)).otherwise(pairs)


def _mixed(word: Column) -> Column:
    runs = F.regexp_extract_all(word, F.lit(f"([{CJK}]+|[^{CJK}]+)"), F.lit(1))
    cut = F.transform(
        runs,
        lambda r: F.when(F.rlike(r, F.lit(f"[{CJK}]")), cjk_bigrams(r)).otherwise(
            F.when(keeps(r), F.array(r)).otherwise(F.array().cast("array<string>"))
        ),
    )
    return F.flatten(cut)


def tokens(text: Column) -> Column:
    """Content tokens in order, repeats kept; runs of unspaced scripts as bigrams."""
    found = words(text)
    plain = F.filter(found, keeps)
    mixed = F.flatten(F.transform(found, lambda w: _mixed(w)))
    return F.when(F.rlike(text, F.lit(f"[{CJK}]")), mixed).otherwise(plain)


def stem(token: Column) -> Column:
    """Token with plural and -ing/-ed endings taken off, by the longest rule that holds."""
    cut = lambda w, n: F.substr(w, F.lit(1), F.length(w) - n)
    ends = lambda w, *tails: reduce(Column.__or__, [F.endswith(w, F.lit(t)) for t in tails])
    size = F.length(token)
    single = (
        F.when(ends(token, "sses"), cut(token, 2))
        .when(ends(token, "ches", "shes", "xes") & (size > 4), cut(token, 2))
        .when(ends(token, "ies") & (size > 4), F.concat(cut(token, 3), F.lit("y")))
        .when(ends(token, "s") & ~ends(token, "ss", "us", "is", "as") & (size > 3), cut(token, 1))
        .otherwise(token)
    )

    def bare(w: Column, n: int) -> Column:
        # A doubled last consonant falls to one, but l, s and z stay.
        return F.regexp_replace(cut(w, n), r"([^aeioulsz])\1$", "$1")

    def verb(w: Column) -> Column:
        vowel = lambda n: F.rlike(cut(w, n), F.lit("[aeiou]"))
        return (
            F.when(ends(w, "ing") & (F.length(w) > 6) & vowel(3), bare(w, 3))
            .when(ends(w, "ed") & ~ends(w, "ing") & (F.length(w) > 5) & vowel(2), bare(w, 2))
            .otherwise(w)
        )

    # Most words have none of the endings and need no rule.
    return F.when(token.isin(IES_WORDS) | ~ends(token, "s", "ing", "ed"), token).otherwise(verb(single))


def terms(text: Column) -> Column:
    """Stemmed tokens, repeats kept."""
    return F.transform(tokens(text), stem)


def mask_code(text: Column) -> Column:
    """Text without fenced blocks and inline code spans."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(```|\z)", " "), r"`[^`\n]*`", " ")


def slug(text: Column) -> Column:
    """Lower-case name with hyphens: no .md, white space and underscores as hyphens, runs of them as one."""
    low = F.regexp_replace(F.lower(F.trim(text)), r"\.md$", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"[\s_]+", "-"), "-+", "-"), F.lit("-"))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] outside code, without display text and anchor, each once, in order."""
    inner = F.regexp_extract_all(mask_code(text), F.lit(r"\[\[([^\]\[]+)\]\]"), F.lit(1))
    bare = F.transform(inner, lambda x: F.trim(F.regexp_extract(x, r"^([^|#]*)", 1)))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) > 0))


def chunks(text: Column, most: int = 3, chars: int = 1500, least: int = 80) -> Column:
    """Paragraphs of the first `chars` characters, of `least` characters or more, `most` at most."""
    parts = F.split(F.substr(text, F.lit(1), F.lit(chars)), r"\n\s*\n")
    return F.slice(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= least), 1, most)


def first_line(text: Column) -> Column:
    """First line of eight characters or more that isn't a fence; null if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: (F.length(x) >= 8) & ~x.startswith("```")), F.lit(0))


def citations(text: Column) -> Column:
    """Path-like tokens with a file ending, without line suffix, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+)(?::\d+)?"), F.lit(1))
    return F.array_distinct(found)
