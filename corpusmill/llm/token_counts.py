"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton names every vocabulary piece that ends at each
character. A dynamic program carries the best score and the number of pieces up
to there, without the pieces themselves. Ties follow the unigram tokenizers'
rule: a later candidate must be strictly better, and candidates for an end come
from the earliest start on.

The box has no unigram vocabulary, so pieces and scores are those of a public
sentencepiece file, read as a unigram table with byte fallback.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

#: Stands for a space (fixed value); what an unknown character scores below the worst piece (fixed value).
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words in a worker's cache, in each of two generations.
CACHE = 200_000


def pieces(path: str) -> tuple[list[tuple[str, float]], float]:
    """(piece, score) of the ordinary pieces of a sentencepiece file, and the lowest score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    ordinary = [
        i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    found = [(model.id_to_piece(i), model.get_score(i)) for i in ordinary]
    return found, min(score for _, score in found)


class Counter:
    """Counts pieces of texts; makes the automaton once."""

    def __init__(self, vocabulary: list[tuple[str, float]], lowest: float):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        # No piece goes on into the next word's spaces, so words part the search without changing it.
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in vocabulary):
            self.words = re.compile(r"(?s).+")
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            ends[end + 1].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, number, single = -float("inf"), 0, False
            for length, own in ends[end]:
                total = score[end - length] + own
                if total > top:
                    top, number = total, count[end - length] + 1
                single = single or length == 1
            if not single:
                total = score[end - 1] + self.unknown
                if total > top:
                    top, number = total, count[end - 1] + len(word[end - 1].encode())
            score[end], count[end] = top, number
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text; an unknown character counts as its bytes."""
        if not text:
            return 0, 0.0
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.known.get, words))
        for at, pair in enumerate(found):
            if pair is None:
                found[at] = self._add(words[at])
        return sum(n for n, _ in found), sum(s for _, s in found)

    def _add(self, word: str) -> tuple[int, float]:
        pair = self.known.get(word) or self.older.get(word) or self.best(word)
        if len(word) <= 64:
            if len(self.known) >= CACHE:
                self.known, self.older = {}, self.known
            self.known[word] = pair
        return pair


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(*pieces(path))
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, score) of every whole text. Null and empty texts have no tokens and a score of 0."""
    return per_text(
        df, lambda texts: [counter(path).count(t.decode()) for t in texts], "n_tokens bigint, score double", key, text
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
