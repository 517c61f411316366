"""Byte-level BPE encoding and decoding.

Encoding runs a transducer over the bytes of each pattern match. After a prefix
of bytes is read, the last token of that prefix's encoding is unique: it is the
vocabulary token that ends there and may stand beside the last token of the
prefix before it. A state is the set of boundaries which a later token can still
start from. States are interned and transitions made on first use (lazy
determinisation). Tokens leave when no later token can cross the boundary after
them, a lookahead that the longest token bounds.

Decoding streams tokens through a UTF-8 state machine: the state says which
continuation bytes are due, and each token maps a state to the next.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

#: Entries kept in a worker's caches; a full cache is emptied, results stay the same.
MAX_STATES = 120_000
MAX_PIECES = 100_000
MAX_PAIRS = 150_000
#: Times as many for a query that encodes only; in the pipeline earlier stages have filled the executors' memory.
ROOM = 3
#: Bits of a token in a boundary, and where a move has its next state, in eights for the byte that follows.
TOKEN_BITS, TOKEN_MASK, STATE_MASK = 24, (1 << 24) - 1, 0xFFFFFF00
#: Bytes after which tokens leave at the next final boundary; shorter pieces leave at their end.
LONG = 256


class Ranks:
    """Merge ranks, with the merge that last made each token."""

    def __init__(self, path: str, room: int = 1):
        self.room = room
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {r: t for t, r in self.rank.items()}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._pair: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Token ids of `data` by repeatedly merging the pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(
                ((self.rank.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            )
            if best == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; itself twice if it's a byte, None if merges never reach it."""
        if token not in self._split:
            data = self.bytes[token]
            found: tuple[int, int] | None = (token, token)
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    best, at = min(
                        ((self.rank.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
                    )
                    if best >= token:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
                if found and not (self.split(found[0]) and self.split(found[1])):
                    found = None
            self._split[token] = found
        return self._split[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether an encoding may hold `left` next to `right`.

        Undo the merges of both from the latest to the earliest; if the parts at
        their border would have merged before the next undone merge, it may not.
        """
        key = left << 32 | right
        known = self._pair.get(key)
        if known is None:
            known, limit, a, b = True, sys.maxsize, left, right
            while True:
                joint = self.rank.get(self.bytes[a] + self.bytes[b], sys.maxsize)
                if joint < limit:
                    known = False
                    break
                a_made, b_made = len(self.bytes[a]) > 1, len(self.bytes[b]) > 1
                if not a_made and not b_made:
                    break
                # Of equal ranks the left one merged first, so the right one is undone first.
                if a_made and (not b_made or a > b):
                    limit, a = a, self.split(a)[1]
                else:
                    limit, b = b + 1 if joint != b else b, self.split(b)[0]
            if len(self._pair) > MAX_PAIRS * self.room:
                self._pair.clear()
            self._pair[key] = known
        return known


class Transducer:
    """Lazily determinised transducer from the bytes of one piece to token ids.

    A state holds the boundaries from which a vocabulary token can still go on:
    where in the prefix tree of the vocabulary the bytes since each stand, and
    the token that ends at it. A transition gives the token that ends at the byte
    just read. Once only one boundary is left, no token can cross it, so what
    lies before it is final and leaves.

    States and moves are numbers: a move is the token, whether all before it is
    final, and the next state; it is known by state and byte.
    """

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.sizes = [len(ranks.bytes.get(i, b"")) for i in range(max(ranks.bytes) + 1)]
        #: The prefix tree: (node, byte) to node, and the token that a node's bytes are.
        self.tree: dict[int, int] = {}
        self.token = [-1]
        for token, data in ranks.bytes.items():
            node = 0
            for byte in data:
                at = node << 8 | byte
                node = self.tree.get(at, 0)
                if not node:
                    node = self.tree[at] = len(self.token)
                    self.token.append(-1)
            self.token[node] = token
        self.inner = {at >> 8 for at in self.tree}
        self._reset()

    def _reset(self) -> None:
        # A boundary is (node, token + 1) in one number; at the start no token ends.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.ids = {(0,): 0}
        self.moves: dict[int, int] = {}

    def _make(self, state: int, byte: int) -> int:
        ranks, tree, found, live = self.ranks, self.tree, -1, []
        for bound in self.states[state]:
            node, before = tree.get((bound >> TOKEN_BITS) << 8 | byte), (bound & TOKEN_MASK) - 1
            if node is None:
                continue
            if found < 0 and (token := self.token[node]) >= 0:
                if ranks.split(token) and (before < 0 or ranks.beside(before, token)):
                    found = token
            if node in self.inner:
                live.append(node << TOKEN_BITS | before + 1)
        if found < 0:
            raise ValueError("no token ends at this byte")
        target = (*live, found + 1)
        at = self.ids.get(target)
        if at is None:
            at = self.ids[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = found << 33 | (not live) << 32 | at << 8
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES * self.ranks.room:
            self._reset()
        state, out, get = 0, [], self.moves.get
        path: list[int] = []  # moves since the last boundary known to be final
        for byte in piece:
            move = get(state | byte)
            if move is None:
                move = self._make(state >> 8, byte)
            state = move & STATE_MASK
            path.append(move)
            if len(path) > LONG and move >> 32 & 1:
                out += self._back(path)
                path.clear()
        out += self._back(path)
        return tuple(out)

    def _back(self, path: list[int]) -> list[int]:
        """The tokens of the last boundary's chain, found from its end."""
        at, found, sizes = len(path) - 1, [], self.sizes
        while at >= 0:
            token = path[at] >> 33
            found.append(token)
            at -= sizes[token]
        found.reverse()
        return found


#: UTF-8 by states: 0 between characters; others name what continuation bytes are due.
_DUE = {0xE0: "E0", 0xED: "ED", 0xF0: "F0", 0xF4: "F4"}
_RANGES = {
    "1": (0x80, 0xBF, "0"), "2": (0x80, 0xBF, "1"), "3": (0x80, 0xBF, "2"),
    "E0": (0xA0, 0xBF, "1"), "ED": (0x80, 0x9F, "1"), "F0": (0x90, 0xBF, "2"), "F4": (0x80, 0x8F, "2"),
}


def utf8_step(state: str, byte: int) -> str:
    """Next state of the UTF-8 machine; "bad" where no text goes on so."""
    if state == "0":
        if byte < 0x80:
            return "0"
        if 0xC2 <= byte <= 0xDF:
            return "1"
        if 0xE0 <= byte <= 0xEF:
            return _DUE.get(byte, "2")
        return _DUE.get(byte, "3") if 0xF0 <= byte <= 0xF4 else "bad"
    if state == "bad":
        return "bad"
    low, high, then = _RANGES[state]
    return then if low <= byte <= high else "bad"


class Decoder:
    """Tokens to bytes; text leaves as soon as its characters are whole."""

    def __init__(self, ranks: Ranks):
        self.bytes = [ranks.bytes.get(i, b"") for i in range(max(ranks.bytes) + 1)]
        self._moves: dict[tuple[str, int], str] = {}
        self.whole = np.array([self.move("0", token) == "0" for token in range(len(self.bytes))])

    def move(self, state: str, token: int) -> str:
        """State after the bytes of `token`."""
        found = self._moves.get((state, token))
        if found is None:
            found = state
            for byte in self.bytes[token]:
                found = utf8_step(found, byte)
            self._moves[state, token] = found
        return found

    def stream(self, tokens):
        """Yield text for each run of tokens that ends between characters."""
        state, held = "0", []
        for token in tokens:
            held.append(self.bytes[token])
            state = self.move(state, token)
            if state == "bad":
                raise ValueError("the tokens are not UTF-8")
            if state == "0":
                yield b"".join(held).decode()
                held = []
        if held:
            raise ValueError("the tokens end inside a character")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of `ids`, checked by the state machine where a token isn't whole characters."""
        state, last = "0", -1
        for at in np.flatnonzero(~self.whole[ids]).tolist():
            if at <= last:
                continue
            state, last = self.move("0", int(ids[at])), at
            while state not in ("0", "bad") and last + 1 < len(ids):
                last += 1
                state = self.move(state, int(ids[last]))
            if state != "0":
                raise ValueError("the tokens are not whole UTF-8 characters")
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Pieces(dict):
    """Ids of pieces as bytes, encoded when first asked for."""

    def __init__(self, ranks: Ranks, machine: Transducer, older: dict):
        super().__init__()
        self.ranks, self.machine, self.older = ranks, machine, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.ranks.rank.get(data)
            ids = array("I", (whole,) if whole is not None else self.machine.encode(data)).tobytes()
        if len(piece) <= 64 and len(self) < 2 * MAX_PIECES * self.ranks.room:  # one long text may hold more pieces
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str, room: int = 1):
        import regex

        self.ranks = Ranks(path, room)
        self.machine, self.decoder = Transducer(self.ranks), Decoder(self.ranks)
        self.findall = regex.compile(pattern).findall
        # Pieces seen lately, and those of the time before; frequent ones move from the old to the new.
        self.known = Pieces(self.ranks, self.machine, {})

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) >= MAX_PIECES * self.ranks.room:
            older, self.known.older = self.known, {}
            self.known = Pieces(self.ranks, self.machine, older)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.findall(text))), np.uint32).astype("<u4", copy=False)


_CODECS: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, room: int = 1) -> Codec:
    """The codec of this worker process, made once."""
    if (path, pattern, room) not in _CODECS:
        _CODECS[path, pattern, room] = Codec(path, pattern, room)
    return _CODECS[path, pattern, room]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token ids of every whole text: (key, ids array<long>). A null text has none."""

    def work(texts: list[bytes]) -> list[tuple]:
        own = codec(path, pattern)
        return [(own.encode(t.decode()).astype("i8"),) for t in texts]

    return per_text(df, work, "ids array<bigint>", key, text)


def tokenized(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode the ids again: (key, ids, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts give no ids and the digests of nothing. Repeated rows
    give equal rows; a null key stays null. An id sequence that isn't UTF-8 as a
    whole raises, which a text's own encoding never is.
    """
    return _round_trip(df, path, pattern, text, key, True)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As `tokenized`, without the ids."""
    return _round_trip(df, path, pattern, text, key, False)


def _round_trip(df: DataFrame, path: str, pattern: str, text: str, key: str, with_ids: bool) -> DataFrame:
    def work(texts: list[bytes]) -> list[tuple]:
        own = codec(path, pattern, 1 if with_ids else ROOM)
        rows = []
        for data in texts:
            ids = own.encode(data.decode())
            back = own.decoder.decode(ids)
            digests = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())
            rows.append((ids.astype("i8"), *digests) if with_ids else digests)
        return rows

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return per_text(df, work, "ids array<bigint>, " + schema if with_ids else schema, key, text)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLES: dict[str, str] = {}
