"""License scans by template matching.

A template is a wording with markup: `[[ ... ]]` encloses an optional region,
`{name:n}` stands for a replaceable one of up to n words and `{name#n}` for one of
up to n numbers. Templates compile into
automata over words; a place in a text is accepted if all mandatory words stand
there, in order, with nothing else between them than the regions allow.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

#: Phrases counted by name (fixed values).
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the {thing:2} to deal in the {thing:2} without restriction including without limitation the rights to
use copy modify merge publish distribute sublicense and or sell copies of the {thing:2} and to permit persons to whom the
{thing:2} is furnished to do so subject to the following conditions the above copyright notice and this permission notice
[[including the next paragraph]] shall be included in all copies or substantial portions of the {thing:2} the {thing:2} is
provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall {holders:6} be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with
the {thing:2} or the use or other dealings in the {thing:2}"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met {item#1} redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer {item#1} redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution"""
_NAMES = """{item#1} neither the name of {holder:10} nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission"""
_BSD_END = """this software is provided by {holders:8} as is and any express or implied warranties including but not limited
to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
{holders:8} be liable for any direct indirect incidental special exemplary or consequential damages including but not
limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
any way out of the use of this software even if advised of the possibility of such damage"""
_ISC = """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby
granted"""
_ISC_KEEP = "provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = """the software is provided as is and {author:6} disclaims all warranties with regard to this software including
all implied warranties of merchantability and fitness in no event shall {author:6} be liable for any special direct
indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action
of contract negligence or other tortious action arising out of or in connection with the use or performance of this
software"""

#: (label, wording with markup) of whole license texts and of notices that name a license.
TEMPLATES = [
    ("mit", _MIT),
    ("bsd-2", f"{_BSD} {_BSD_END}"),
    ("bsd-3", f"{_BSD} {_NAMES} {_BSD_END}"),
    ("isc", f"{_ISC} {_ISC_KEEP} {_ISC_END}"),
    ("0bsd", f"{_ISC} {_ISC_END}"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
    ),
    (
        "apache-2",
        "you may not use {file:4} except in compliance with the license [[you may obtain a copy of the license at "
        "{address:12}]] unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
        "license for the specific language governing permissions and limitations under the license",
    ),
    ("mit", "[[released]] [[distributed]] [[licensed]] under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]]"),
    (
        "gpl-3",
        "[[this work is]] [[this program is]] [[licensed]] [[distributed]] under the [[terms of the]] gnu general "
        "public license version 3",
    ),
    (
        "gpl-3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license [[or at your option any later version]]",
    ),
    ("gpl-2", "under the [[terms of the]] gnu general public license version 2"),
    ("lgpl-3", "under the [[terms of the]] gnu lesser general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "[[released]] licensed under [[a]] [[creative commons]] [[the]] cc by nc {version#2}"),
    ("cc-by-nc", "creative commons attribution noncommercial {version#2} [[international]] license"),
    ("cc-by-nc", "creative commons attribution non commercial {version#2} [[international]] license"),
    ("cc-by-sa", "creative commons attribution sharealike {version#2} [[international]] license"),
    ("cc-by-sa", "creative commons attribution share alike {version#2} [[international]] license"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution {version#2} [[international]] license"),
]
#: Score of a phrase alone, and the mandatory words at which a template's score is halfway from there to 1.
PHRASE_SCORE, HALF_WORDS = 0.5, 6

#: All bytes that no word holds, and A-Z, which are lower-cased before.
_SPACES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_SPACES).split()


#: Step on any number; no word has this sign.
NUMBER = b"#"


class Automaton:
    """Word automaton of one template; states are numbered, the last one accepts."""

    def __init__(self, label: str, wording: str):
        self.label = label
        self.steps: list[dict[bytes | None, set[int]]] = [{}]
        self.jumps: dict[int, set[int]] = defaultdict(set)
        self.mandatory = 0
        open_at: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\w+[:#]\d+\}|[^\s\[\]{}]+", wording):
            here = len(self.steps) - 1
            if part == "[[":
                open_at.append(here)
            elif part == "]]":
                self.jumps[open_at.pop()].add(here)
            elif part[0] == "{":
                n = int(re.split("[:#]", part[1:-1])[1])
                for i in range(n):
                    self._add(NUMBER if "#" in part else None)
                    self.jumps[here + i].add(here + n)
            else:
                self._add(part.encode())
                self.mandatory += not open_at
        self.last = len(self.steps) - 1
        self.starts = self.closed({0})

    def _add(self, word: bytes | None) -> None:
        here = len(self.steps) - 1
        self.steps[here].setdefault(word, set()).add(here + 1)
        self.steps.append({})

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.jumps.get(todo.pop(), ()):
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def first_words(self) -> set[bytes]:
        return {w for s in self.starts for w in self.steps[s] if w not in (None, NUMBER)}

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the shortest accepted run of words from `at`; None if there is none."""
        now = self.starts
        for i in range(at, len(words) + 1):
            if self.last in now:
                return i
            if i == len(words) or not now:
                return None
            after: set[int] = set()
            for s in now:
                after |= self.steps[s].get(words[i], set()) | self.steps[s].get(None, set())
                if words[i].isdigit():
                    after |= self.steps[s].get(NUMBER, set())
            now = self.closed(after)
        return None


class Scanner:
    def __init__(self, templates=None, phrases=None):
        self.phrases = [(label, tuple(p.encode().split())) for label, p in (phrases or PHRASES).items()]
        self.automata = [Automaton(*t) for t in (templates or TEMPLATES)]
        # A template is tried where a mandatory word of it stands; the rarest-looking one is its longest.
        self.anchors: dict[bytes, list[Automaton]] = defaultdict(list)
        for automaton in self.automata:
            words = {w for step in automaton.steps for w in step if w not in (None, NUMBER)}
            jumped = {s for a, bs in automaton.jumps.items() for b in bs for s in range(a, b)}
            needed = {w for s, step in enumerate(automaton.steps) if s not in jumped for w in step if w in words}
            self.anchors[max(needed or words, key=lambda w: (len(w), w))].append(automaton)
        self.first = {p[0] for _, p in self.phrases}
        self.any = frozenset(self.anchors) | {p[-1] for _, p in self.phrases}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]]]:
        """Places of phrases as (label, start); accepted templates as (label, start, end, mandatory words)."""
        if self.any.isdisjoint(words):
            return [], []
        base = []
        for label, phrase in self.phrases:
            head, n, at = phrase[0], len(phrase), -1
            while True:
                try:
                    at = words.index(head, at + 1)
                except ValueError:
                    break
                if tuple(words[at : at + n]) == phrase:
                    base.append((label, at))
        present = set(words)
        found = []
        for anchor, automata in self.anchors.items():
            if anchor not in present:
                continue
            for automaton in automata:
                firsts = automaton.first_words()
                places = [i for i, w in enumerate(words) if w in firsts]
                covered = -1
                for at in places:
                    if at < covered:
                        continue
                    end = automaton.match(words, at)
                    if end is not None:
                        found.append((automaton.label, at, end, automaton.mandatory))
                        covered = end
        return base, found


_SCANNER: list[Scanner] = []


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Licenses named or worded in every whole text.

    Null and empty texts have no words, null places, empty labels and a score of
    0. Repeated rows give equal rows. The score is 0 without a label, 0.5 for a
    phrase, and rises towards 1 with the mandatory words of an accepted template.
    """

    def work(texts: list[bytes]) -> list[tuple]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        rows = []
        for data in texts:
            words = words_of(data)
            base, found = _SCANNER[0].scan(words)
            places = [at for _, at in base]
            named = sorted({label for label, _ in base})
            strongest = max((m for *_, m in found), default=0)
            score = PHRASE_SCORE * bool(base)
            if strongest:
                score = PHRASE_SCORE + (1 - PHRASE_SCORE) * strongest / (strongest + HALF_WORDS)
            rows.append((
                len(words), len(base), min(places, default=None), max(places, default=None), ",".join(named),
                ",".join(sorted({*named, *(label for label, *_ in found)})), score,
            ))
        return rows

    schema = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double"
    )
    return per_text(df, work, schema, key, text)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
