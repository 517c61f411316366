"""Suffix arrays of many short texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Codes packed in one number, of 9 bits each: bytes from 1 up, and 0 between texts.
PACKED, BITS = 7, 9
_STEPS = np.array([1 << BITS * i for i in range(1, PACKED)], "i8")


def packed(codes: np.ndarray) -> np.ndarray:
    """At every place the next PACKED codes as one number; past the end stand zeros."""
    wide = np.zeros(len(codes) + PACKED, "i8")
    wide[: len(codes)] = codes
    out = np.zeros(len(codes), "i8")
    for i in range(PACKED):
        out = out << BITS | wide[i : i + len(codes)]
    return out


def suffix_order(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes with `depth` or more codes left in their text, in the order of these.

    Larsson and Sadakane's refinement: suffixes ordered by h codes are ordered by
    2h from the ranks h further on, and only groups that aren't single yet are
    sorted again. `words` are packed codes. A refinement ranks only the suffixes
    whose ranks a later one reads.
    """
    n, heights = len(words), [PACKED]
    while heights[-1] < depth:
        heights.append(2 * heights[-1])
    needs = [depth]
    for h in reversed(heights[:-1]):
        needs.append(needs[-1] - h)
    needs.reverse()

    order = np.argsort(words)
    sorted_words = words[order]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.full(n + heights[-1] + 1, -1, "i8")
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    for h, need in zip(heights[:-1], needs[1:]):
        if need > 0:
            order = order[left[order] >= need]
        ordered = rank[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        single = new.copy()
        single[:-1] &= new[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        # Groups are runs of places in the order; sorting by (rank, rank h on) leaves each in its run.
        who = order[open_]
        key = ordered[open_] * (n + 1) + rank[who + h] + 1
        sub = np.argsort(key)
        order[open_], key = who[sub], key[sub]
        new[open_[1:]] |= key[1:] != key[:-1]
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[left[order] >= depth]


def common_prefixes(words: np.ndarray, left: np.ndarray, starts: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Codes that each suffix of `order` shares with the one before it, `depth` at most.

    Kasai's rule, for all texts side by side: the next suffix of a text shares at
    least one code less with the one before it, so only what goes beyond is
    compared. Where the one before ends, or goes on behind it (their order may be
    open beyond `depth`), counting starts anew.
    """
    place = np.full(len(words) + 2, len(words), "i8")
    place[order] = np.arange(len(order))
    before = np.full(len(words) + 1, -1, "i8")
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(words), "i8")
    known, peer = np.zeros(len(starts), "i8"), np.full(len(starts), -1, "i8")
    texts, at = np.flatnonzero(left[starts] >= depth), 0
    while len(texts):
        here = starts[texts] + at
        other = before[here]
        goes_on = (peer[texts] >= 0) & (place[peer[texts] + 1] < place[here])
        count = np.where(goes_on, np.maximum(known[texts] - 1, 0), 0)
        live = np.flatnonzero(other >= 0)
        while len(live):
            apart = words[here[live] + count[live]] ^ words[other[live] + count[live]]
            same = apart == 0
            count[live] += np.where(same, PACKED, PACKED - 1 - np.searchsorted(_STEPS, apart, side="right"))
            live = live[same & (count[live] < depth)]
        count = np.minimum(count, depth)
        shared[here], known[texts], peer[texts] = count, count, other
        at += 1
        texts = texts[left[starts[texts]] - at >= depth]
    return shared[order]
