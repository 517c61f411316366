"""Secret scans in DataFrame functions only.

Named patterns give the base spans. Further spans come from two character Markov
models, one of random strings and one of ordinary identifiers: a run of 20 or
more token characters with a digit is a secret if the log-likelihood ratio of any
part of it is high enough. Shorter runs and runs of letters alone aren't judged.

All is linear in the text and its matches, but for a logarithm in the number of
matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Base patterns in their listed order (fixed values).
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8
#: Runs that the models judge: 20 or more token characters with a digit among them.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "markov")

#: Model symbols: small letters as they are, U a capital, 0 a digit, _ any other.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzU0_"
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=-"
_TO = "U" * 26 + "0" * 10 + "_" * 4
#: Labelled samples of each class, smoothing of the counts, least log-likelihood ratio of a secret.
SAMPLES, SMOOTH, LEAST = 4000, 0.5, 12.0
#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "get set list item name value index count total user account order line table column row key file path data "
    "text page http https www com org html image photo video media style script main test version release build "
    "config server client request response message error status time date year month day start end first last next "
    "report document section chapter article figure model number group class type object method function string "
    "buffer stream reader writer parser token session cache query update delete insert create default public private"
).split()


def labelled_samples(spark: SparkSession) -> DataFrame:
    """(sample, is_random): digests in several notations, and identifiers of common words with numbers."""
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    words = F.lit(IDENTIFIER_WORDS)
    at = lambda n: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(n)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(i, F.lit("n")), F.lit(2030)).cast("string")
    pick = F.pmod(i, F.lit(4))
    ids = spark.range(SAMPLES)
    random = ids.select(
        F.when(pick == 0, F.substring(digest, 1, 40))
        .when(pick == 1, coded)
        .when(pick == 2, F.regexp_replace(coded, "[+/=]", ""))
        .otherwise(F.upper(F.substring(F.regexp_replace(coded, "[+/=]", ""), 1, 24)))
        .alias("sample"),
        F.lit(True).alias("is_random"),
    )
    ordinary = ids.select(
        F.when(pick == 0, F.concat_ws("_", at(0), at(1), at(2), number))
        .when(pick == 1, F.concat_ws("-", at(0), at(1), number, at(2)))
        .when(pick == 2, F.concat(at(0), F.initcap(at(1)), F.initcap(at(2)), F.initcap(at(3)), number))
        .otherwise(F.concat_ws("/", at(0), at(1), number, at(2)))
        .alias("sample"),
        F.lit(False).alias("is_random"),
    )
    return random.unionByName(ordinary)


def symbols(token: Column) -> Column:
    return F.translate(token, _FROM, _TO)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every symbol pair, random over ordinary, row by first symbol.

    The counts are taken by Spark; at most two per symbol pair reach the driver.
    """
    coded = samples.select("is_random", symbols(F.col("sample")).alias("s")).where(F.length("s") > 1)
    pairs = coded.select(
        "is_random", F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))")).alias("pair")
    )
    counts = {
        (r["is_random"], r["pair"]): r["n"]
        for r in pairs.groupBy("is_random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    }

    def log_p(kind: bool, a: str, b: str) -> float:
        row = sum(counts.get((kind, a + c), 0) for c in SYMBOLS)
        return math.log((counts.get((kind, a + b), 0) + SMOOTH) / (row + SMOOTH * len(SYMBOLS)))

    return [log_p(True, a, b) - log_p(False, a, b) for a in SYMBOLS for b in SYMBOLS]


def log_ratio(token: Column, weights: list[float]) -> Column:
    """Highest log-likelihood ratio of any part of a token of the run's characters, in one pass over it."""
    alphabet, table_ = F.lit(SYMBOLS), F.lit([float(w) for w in weights])
    codes = F.transform(F.split(symbols(token), ""), lambda c: F.instr(alphabet, c) - 1)
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("now"), F.lit(0.0).alias("best"))

    def step(state: Column, code: Column) -> Column:
        gain = F.coalesce(F.get(table_, state["last"] * len(SYMBOLS) + code), F.lit(0.0))
        now = F.greatest(state["now"] + gain, F.lit(0.0))
        return F.struct(code.alias("last"), now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(codes, zero, step, lambda state: state["best"])


def running_sums(values: Column) -> Column:
    """Sums of each prefix of an array, in passes of doubled reach; each pass makes one array of the same size."""
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1))
    return F.aggregate(
        F.coalesce(passes, F.array().cast("array<int>")),
        values,
        lambda sums, k: F.transform(
            sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))
        ),
    )


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array<struct<start,kind,end,value>> of a pattern's leftmost non-overlapping matches, in code points.

    The texts between the matches give their places.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = running_sums(
        F.zip_with(F.slice(between, 1, F.size(between) - 1), hits, lambda gap, hit: F.length(gap) + F.length(hit))
    )
    found = F.zip_with(
        ends,
        hits,
        lambda end, hit: F.struct(
            (end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
            (F.regexp_extract(hit, pattern, group) if group else hit).alias("value"),
        ),
    )
    kind_of = "array<struct<start:int,kind:int,end:int,value:string>>"
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(kind_of))


def is_secret(hit: Column, kind: int) -> Column:
    """Whether a match of a base pattern counts."""
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE if kind == 0 else F.lit(True)


def replaced(text: Column, pattern: str, chosen, by) -> Column:
    """The text with `by(match)` in place of every match that is chosen."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The last text between matches has none behind it.
    one = lambda gap, hit: F.when(hit.isNull(), gap).otherwise(F.concat(gap, F.when(chosen(hit), by(hit)).otherwise(hit)))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(F.zip_with(F.split(text, pattern, -1), hits, one), "")).otherwise(text)


BASE = ((0, ASSIGN), (1, ACCESS), (2, HEX))


def find(df: DataFrame, weights: list[float], text: str = "text") -> DataFrame:
    """`df` with `secret_base` and `secret_all`: arrays of (start, kind, end) by start, then kind.

    A null text has no spans, like an empty one. Matches of different patterns
    may overlap. The models judge the runs of what base matches leave: these are
    blanked first, so the rest of a run that a match takes a part of is judged by
    itself. New columns replace existing ones of the same name.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    assigned = F.filter(spans(body, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
    base = F.array_sort(F.concat(bare(assigned), bare(spans(body, ACCESS, 1)), bare(spans(body, HEX, 2))))
    out = df.withColumn("secret_base", base).withColumn("secret_all", body)
    for kind, pattern in BASE:
        blank = replaced(F.col("secret_all"), pattern, lambda hit, kind=kind: is_secret(hit, kind), lambda hit: F.repeat(F.lit(" "), F.length(hit)))
        # Few texts have a base match; the others are judged as they are.
        out = out.withColumn("secret_all", F.when(F.size("secret_base") > 0, blank).otherwise(F.col("secret_all")))
    runs = F.filter(spans(F.col("secret_all"), RUN, 3), lambda x: log_ratio(x["value"], weights) >= LEAST)
    return out.withColumn("secret_all", F.array_sort(F.concat(F.col("secret_base"), bare(runs))))


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(
        F.transform(
            found,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


#: Stands for a character of a secret while spans that overlap are put together; no pattern matches it.
_HIDDEN = "\ue000"


def _overlapped(text: Column, found: Column) -> Column:
    """The places (of the characters) that any base match or any of the found runs covers, as booleans."""
    chars = F.split(text, "")
    hide = lambda hit: F.repeat(F.lit(_HIDDEN), F.length(hit))
    hidden = F.array_repeat(F.lit(False), F.size(chars))
    for kind, pattern in BASE:
        other = F.split(replaced(text, pattern, lambda hit, kind=kind: is_secret(hit, kind), hide), "")
        changed = F.zip_with(chars, other, lambda a, b: a != b)
        hidden = F.zip_with(hidden, changed, lambda a, b: a | b)
    # Runs don't overlap each other: places are inside one where the starts so far outnumber the ends so far.
    edges = F.concat(
        F.transform(found, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("step"))),
        F.transform(found, lambda x: F.struct(x["end"].alias("at"), F.lit(-1).alias("step"))),
    )
    steps = F.map_from_entries(F.transform(edges, lambda x: F.struct(x["at"], x["step"])))
    moves = F.transform(hidden, lambda _, i: F.coalesce(F.element_at(steps, i), F.lit(0)))
    inside = F.when(F.size(found) > 0, F.transform(running_sums(moves), lambda n: n > 0)).otherwise(F.transform(hidden, lambda _: F.lit(False)))
    return F.zip_with(hidden, inside, lambda a, b: a | b)


def redact(df: DataFrame, weights: list[float], mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """`df` with a mark in place of every stretch of its texts that spans of `find` cover; spans that overlap or touch may share one.

    No character of a span stays. A null text stays null.
    """
    found = find(df, weights, text)
    # Step by step, as an expression in an expression would be worked out again for each use.
    for kind, pattern in BASE:
        found = found.withColumn("secret_mark", replaced(F.col("secret_mark") if kind else F.col(f"`{text}`"), pattern, lambda hit, kind=kind: is_secret(hit, kind), lambda hit: F.lit(mark)))
    found = found.withColumn("secret_mark", replaced(F.col("secret_mark"), RUN, lambda hit: log_ratio(hit, weights) >= LEAST, lambda hit: F.lit(mark)))
    # Few texts have spans that overlap; kind after kind would leave the rest of the later one there.
    crossed = F.exists(F.transform("secret_base", lambda x, i: F.get(F.col("secret_base"), i + 1)["start"] < x["end"]), lambda x: x)
    runs = F.filter("secret_all", lambda x: x["kind"] == 3)
    chars, hidden = F.split(F.col(f"`{text}`"), ""), _overlapped(F.col(f"`{text}`"), runs)
    begins = lambda i: F.when((i > 0) & F.get(F.col("secret_hidden"), i - 1), "").otherwise(mark)
    shown = F.array_join(F.transform(chars, lambda c, i: F.when(F.get(F.col("secret_hidden"), i), begins(i)).otherwise(c)), "")
    found = found.withColumn("secret_hidden", F.when(crossed, hidden))
    whole = F.when(F.col("secret_hidden").isNotNull(), shown).otherwise(F.col("secret_mark"))
    return found.withColumn(text, whole).select(*df.columns)


def scan(df: DataFrame, weights: list[float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `df`: counts of the base kinds, the digest of the base spans, and all spans.

    A null or empty text has counts of 0, the digest of nothing and no spans. A
    null key stays null, and repeated rows give equal rows.
    """
    found = find(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")), weights)
    n = lambda kind: F.size(F.filter(F.col("secret_base"), lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        F.col(f"`{key}`"),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("secret_base")), 256).alias("base_sha256"),
        joined(F.col("secret_all")).alias("spans"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(labelled_samples(spark)))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
