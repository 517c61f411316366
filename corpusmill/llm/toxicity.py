"""Toxicity by maximum-scoring segments.

Training counts in how many toxic and clean texts each word and each word
beginning stands, and takes their log-odds ratio with a Dirichlet prior, less
what chance may add to it. A text is scanned once: every word adds its log-odds
to the running score, less a cost that makes the score of clean text fall, and
the scan yields every maximal-scoring segment. How often clean texts have
segments of a score gives the extreme-value tail that says which segments are
significant, and turns all segments of a text into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import forget, per_text, small_batches, stored, table

#: Labelled rows that the weights, and of these the rows that the tail, are fitted on, by a hash of their id.
TRAIN_ROWS, TAIL_ROWS = 40_000, 10_000
#: Strength of the prior as a share of the texts; least texts of a weight; standard errors that a weight is lessened by.
PRIOR_SHARE, LEAST_TEXTS, ERRORS = 0.025, 5, 1.5
#: Lengths of word beginnings, longest first; what every word costs.
BEGINNINGS, COST = (6, 5, 4), 0.25
#: Least score of a segment; chance segments of a clean text of its length at which one is no longer significant.
LEAST_SCORE, SIGNIFICANT = 1.0, 0.01
#: Entries of a worker's caches.
CACHE = 300_000

_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def features(words: set[str]) -> set[str]:
    """Words as they are, and their beginnings marked with a star."""
    found = set(words)
    for n in BEGINNINGS:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


@dataclass
class Model:
    """Weights of words and beginnings, and the tail that clean texts' segments follow."""

    weights: dict[str, float] = field(default_factory=dict)
    #: Segments for each word of clean texts, fall of their log-number as the score rises, evidence at which a score is 0.5.
    rate: float = 1e-6
    decay: float = 1.0
    threshold: float = 3.0

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.weights.get(word)
        if found is None:
            found = next((w for n in BEGINNINGS if len(word) > n and (w := self.weights.get(word[:n] + "*")) is not None), 0.0)
        if len(self._known) >= CACHE:
            self._known.clear()
        found = self._known[word] = found - COST
        return found

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, score) of all maximal-scoring segments from LEAST_SCORE up, in order."""
        scores = list(map(self._known.get, words))
        for at, score in enumerate(scores):
            if score is None:
                known = self._known.get(words[at])
                scores[at] = self.weight(words[at]) if known is None else known
        values = np.array(scores, "f8")
        if not len(values) or values.max() <= 0:
            return []
        return [x for x in maximal_segments(values) if x[2] >= LEAST_SCORE]

    def chance(self, score: float, n_words: int) -> float:
        """Segments of this score or more that a clean text of this length has on average."""
        return self.rate * max(n_words, 1) * math.exp(-self.decay * (score - LEAST_SCORE))

    def evidence(self, scores: list[float], n_words: int) -> float:
        """Minus the log-probability that a clean text of this length has segments of such scores.

        The number of segments from a score up is Poisson in clean texts. For each
        r the r-th best score tells how unlikely r such segments are; the
        unlikeliest r counts, at the price of having been chosen from all.
        """
        if not scores:
            return 0.0
        r = np.arange(1, len(scores) + 1)
        mean = np.maximum(self.rate * max(n_words, 1) * np.exp(-self.decay * (np.sort(scores)[::-1] - LEAST_SCORE)), 1e-300)
        # Tail of the Poisson distribution: its first term, and a geometric bound of the rest.
        rest = np.where(mean < r + 1, np.log1p(-np.minimum(mean / (r + 1), 0.999)), 0.0)
        log_p = np.where(mean < r, r * np.log(mean) - mean - np.cumsum(np.log(r)) - rest, 0.0)
        return float(np.maximum(-log_p - np.log(r * (r + 1) / 2), 0.0).max())

    def score(self, scores: list[float], n_words: int) -> float:
        return 1 / (1 + math.exp(min(self.threshold - self.evidence(scores, n_words), 700)))


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence, in linear time.

    Only positive places open a segment, so the rest enters through sums. The
    list holds candidates with the sums before and after each; a new one is
    joined to the nearest earlier one with a smaller sum before it, if that
    one's sum after it is smaller than the new one's.
    """
    sums = np.concatenate([[0.0], np.cumsum(values)])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest with a smaller sum before
    for at in np.flatnonzero(values > 0).tolist():
        start, end = at, at + 1
        low, high = float(sums[start]), float(sums[end])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high, j))
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, high - low) for s, e, low, high, _ in held]


# --- training ---------------------------------------------------------------------------------------------------------


def held_out(key: str = "doc_id"):
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(df: DataFrame, labels: DataFrame, rows: int, text: str, key: str) -> DataFrame:
    """(text, toxic) of at most `rows` labelled rows that aren't held out, one of each group of copies.

    They are the rows with the least hashes of their ids; a row labelled twice
    is toxic if any label says so. Copies would make their own odd words look
    telling, so of texts of one label whose word triples have the same least
    hash, as near copies mostly have, one counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    picked = (
        known.groupBy(F.col(key).alias("train_id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("train_id"), "train_id")
        .limit(rows)
    )
    # At most `rows` ids and flags, so the broadcast is bounded.
    found = df.select(F.col(f"`{key}`").alias("train_id"), F.col(f"`{text}`").alias("text")).where("text != ''")
    found = found.join(F.broadcast(picked), "train_id").select("text", (F.col("toxic") > 0).alias("toxic"))
    words = F.split(F.lower("text"), r"\s+")
    triples = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))),
        lambda i: F.xxhash64(F.array_join(F.slice("words", i, 3), " ")),
    )
    found = found.withColumn("words", words).withColumn("least", F.array_min(triples)).drop("words")
    return found.groupBy("least", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n_toxic, n_clean): texts with each feature; the feature "" counts all texts."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(toxic: Counter, clean: Counter) -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            columns = [pa.array(names), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["feature", "n_toxic", "n_clean"])

        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features(set(words_of(text)))
                found.add("")
                (toxic if flag else clean).update(found)
                if len(toxic) + len(clean) > CACHE:
                    yield out(toxic, clean)
                    toxic, clean = Counter(), Counter()
        if toxic or clean:
            yield out(toxic, clean)

    counts = rows.select("text", "toxic").mapInArrow(run, "feature string, n_toxic bigint, n_clean bigint")
    return counts.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(feature, weight, z): log-odds ratio of toxic to clean texts with a Dirichlet prior, and its z-score."""
    mass = PRIOR_SHARE * (n_toxic + n_clean)
    prior = PRIOR_SHARE * (F.col("n_toxic") + F.col("n_clean"))
    odds = lambda n, total: (n + prior) / F.greatest(F.lit(total + mass) - n - prior, F.lit(0.5))
    weight = F.log(odds(F.col("n_toxic"), n_toxic)) - F.log(odds(F.col("n_clean"), n_clean))
    spread = F.sqrt(1 / (F.col("n_toxic") + prior) + 1 / (F.col("n_clean") + prior))
    sure = F.signum(weight) * F.greatest(F.abs(weight) - ERRORS * spread, F.lit(0.0))
    return counts.select("feature", "n_toxic", "n_clean", sure.alias("weight"))


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit a model on bounded samples of labelled rows. Without labels of both kinds it calls nothing toxic."""
    counts = feature_counts(training_rows(df, labels, TRAIN_ROWS, text, key))
    counts = stored(counts.where((F.col("n_toxic") + F.col("n_clean") >= LEAST_TEXTS) | (F.col("feature") == "")))
    total = counts.where("feature = ''").first()
    if total is None or not total["n_toxic"] or not total["n_clean"]:
        forget(counts)
        return Model(threshold=50.0)
    scored = log_odds(counts.where("feature != ''"), total["n_toxic"], total["n_clean"])
    # No more features than the sample of labelled rows has.
    telling = scored.where("weight != 0")
    weights = {r["feature"]: r["weight"] for r in telling.select("feature", "weight").collect()}
    # Words and longer beginnings that tell nothing, though a telling beginning covers them.
    begun = F.array(*[F.concat(F.substring("feature", 1, n), F.lit("*")) for n in BEGINNINGS])
    silent = (
        scored.where("weight = 0")
        .select("feature", F.explode(begun).alias("begun"))
        .where("begun != feature")
        .join(telling.select(F.col("feature").alias("begun")), "begun", "left_semi")
        .select("feature")
        .distinct()
    )
    weights |= {r["feature"]: 0.0 for r in silent.collect()}
    forget(counts)
    model = Model(weights)

    # The tail: segments of at most TAIL_ROWS training texts.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                rows.append((flag, len(words), [s for *_, s in model.segments(words)]))
            kinds = [pa.bool_(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["toxic", "n", "scores"])

    sample = training_rows(df, labels, TAIL_ROWS, text, key).select("text", "toxic")
    seen = sample.mapInArrow(run, "toxic boolean, n bigint, scores array<double>").collect()
    clean = [r for r in seen if not r["toxic"]]
    found = [s for r in clean for s in r["scores"]]
    # One segment of an average weight is taken as seen beforehand, so that neither figure is 0.
    rises = [w for w in model.weights.values() if w > 0]
    usual = max(sum(rises) / len(rises) if rises else 1.0, 0.1)
    model.rate = (len(found) + 0.5) / (sum(r["n"] for r in clean) + 1)
    model.decay = (len(found) + 1) / (sum(s - LEAST_SCORE for s in found) + usual)
    evidence = [(model.evidence(r["scores"], r["n"]), r["toxic"]) for r in seen]
    model.threshold = best_threshold(evidence)
    return model


def best_threshold(rows: list[tuple[float, bool]]) -> float:
    """Evidence that parts the training rows with the fewest errors, midway between its neighbours."""
    rows = sorted(rows)
    errors = least = sum(not toxic for _, toxic in rows)
    places = [0]
    for i, (_, toxic) in enumerate(rows, 1):
        errors += 1 if toxic else -1
        if i < len(rows) and rows[i][0] == rows[i - 1][0]:
            continue
        if errors < least:
            least, places = errors, [i]
        elif errors == least:
            places.append(i)
    at = places[0]
    low = rows[at - 1][0] if at else 0.0
    high = rows[at][0] if at < len(rows) else low + 2.0
    return max((low + high) / 2, 0.1)


# --- scoring ----------------------------------------------------------------------------------------------------------


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, passages) of every whole text.

    Passages are the word ranges of the significant segments with their scores,
    in order; the score of a text takes all its segments. Null and empty texts
    have none and the least score. The score depends on the text alone, so
    repeated rows score alike.
    """

    def work(texts: list[bytes]) -> list[tuple]:
        rows = []
        for data in texts:
            words = words_of(data.decode())
            found = model.segments(words)
            value = model.score([s for *_, s in found], len(words))
            passages = [{"first": a, "after": b, "score": s} for a, b, s in found if model.chance(s, len(words)) <= SIGNIFICANT]
            rows.append((value, int(value >= 0.5), passages))
        return rows

    schema = "score double, predicted int, passages array<struct<first:bigint,after:bigint,score:double>>"
    return per_text(df, work, schema, key, text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").cast("bigint").alias("n_passages")
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
