"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder (operator 6).

A sequence of tokens is the BPE encoding of its bytes exactly if no merge across the border of two neighbours
comes before the merges that made them.  So every prefix of a piece has one right last token.  The nondeterministic
transducer starts, at each byte, one walk down the vocabulary's trie; its deterministic states are the sets of
nodes that these walks have reached, made when first needed.  A state lists the tokens that may end
here; the compiled merges pick the one that may follow the last token of the prefix before it.  Walks still
open all lead back to one common border after a bounded lookahead (no token is longer than the trie is deep);
the tokens before that border are emitted.

The decoder turns ids into bytes, and an incremental UTF-8 state machine turns bytes into text across any cut; the query's
digests are those of what it emits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Encodes pieces of bytes; ``piece`` gives the ids of one."""

    def __init__(self, ranks: dict[bytes, int], pair_limit: int = 500_000):
        self.ranks, self._pair_limit = ranks, pair_limit
        #: No walk is longer than the longest token, so what lies farther back than one lookahead has a common border.
        self.lookahead = max(map(len, ranks))
        self.tokens = {i: t for t, i in ranks.items()}
        self._child: dict[int, int] = {}  # node << 8 | byte to node of the trie; 0 is the root
        self._token_at: dict[int, int] = {}
        nodes = 1
        for token, i in ranks.items():
            node = 0
            for b in token:
                node, at = self._child.get(node << 8 | b, nodes), node
                if node == nodes:
                    self._child[at << 8 | b] = node
                    nodes += 1
            self._token_at[node] = i
        self._follows: dict[int, dict[int, bool]] = {}  # by token: whether it may follow another
        self._n_pairs = 0
        self._splits: dict[int, tuple[int, int] | None] = {}
        # a state: the walks' nodes, longest walk first; what may end here: (token, its length, what it may follow)
        self._states: dict[tuple[int, ...], int] = {(0,): 0}
        self._walks: list[tuple[int, ...]] = [(0,)]
        self._ends: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()]
        self._moves: dict[int, int] = {}

    def _move(self, state: int, byte: int) -> int:
        """The next state; walks that cannot go on end, and a new one starts."""
        walks = tuple(n for w in self._walks[state] if (n := self._child.get(w << 8 | byte)) is not None)
        at = self._states.get((*walks, 0))
        if at is None:
            at = self._states[(*walks, 0)] = len(self._walks)
            ends = tuple((t, len(self.tokens[t]), self._follows.setdefault(t, {})) for w in walks if (t := self._token_at.get(w)) is not None)
            if not ends:
                raise ValueError("the vocabulary lacks a byte")
            self._walks.append((*walks, 0))
            self._ends.append(ends)
        self._moves[state << 8 | byte] = at
        return at

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge made this one of."""
        if token not in self._splits:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._splits[token]

    def _joins(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across their border comes before those that made them.

        The border's two sides are taken apart, latest merge first; equal ranks merge from the left.
        """
        left, right, before, ok = a, b, 1 << 60, True
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < before:
                ok = False
                break
            l, r = self._split(left), self._split(right)
            if l is not None and (left > right or r is None):
                left, before = l[1], left
            elif r is not None:
                right, before = r[0], right + 1
            else:
                break
        if self._n_pairs >= self._pair_limit:
            for known in self._follows.values():
                known.clear()
            self._n_pairs = 0
        self._n_pairs += 1
        self._follows[b][a] = ok
        return ok

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        last = [(-1, 0)]  # by border: the token that ends there, and its length
        out: list[int] = []
        state = at = 0
        base = False  # whether tokens have been emitted
        moves, every = self._moves, self._ends
        lookahead, due = self.lookahead, 2 * self.lookahead
        for b in data:
            key = state << 8 | b
            state = moves[key] if key in moves else self._move(state, b)
            at += 1
            for token, n, known in every[state]:
                start = at - n
                if start <= 0 and not base:
                    if start:
                        continue
                    break
                before = last[start][0]
                ok = known.get(before)
                if ok or ok is None and self._joins(before, token):
                    break
            else:
                raise ValueError("no encoding")
            last.append((token, n))
            if len(last) > due:
                border = self._agreed(last, lookahead)
                if border:
                    out += self._back(last, border)
                    last, at, base = last[border:], at - border, True
        return out + self._back(last, len(last) - 1)

    @staticmethod
    def _agreed(last: list[tuple[int, int]], longest: int) -> int:
        """The latest border that the sequences of all open walks share."""
        borders = set(range(len(last) - longest, len(last)))
        while len(borders) > 1:
            late = max(borders)
            borders.remove(late)
            borders.add(late - last[late][1])
        return borders.pop()

    @staticmethod
    def _back(last: list[tuple[int, int]], border: int) -> list[int]:
        ids = []
        while border > 0:
            token, n = last[border]
            ids.append(token)
            border -= n
        return ids[::-1]


class Utf8Machine:
    """An incremental UTF-8 decoder, byte by byte: the bytes of an unfinished character wait; what cannot become one is replaced.

    A state is the number of bytes still due and the range of the next: after E0, ED, F0 and F4 it is narrower, so
    that overlong forms, surrogates and numbers beyond U+10FFFF are met at their second byte.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def take(self, data: bytes) -> str:
        out: list[str] = []
        due, low, high, code = self.due, self.low, self.high, self.code
        for b in data:
            if due:
                if low <= b <= high:
                    due, low, high, code = due - 1, 0x80, 0xBF, code << 6 | b & 0x3F
                    if not due:
                        out.append(chr(code))
                    continue
                out.append("\ufffd")  # the beginning of a character that does not go on; b is looked at anew
                due, low, high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                due, code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                due, code, low, high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                due, code, low, high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("\ufffd")
        self.due, self.low, self.high, self.code = due, low, high, code
        return "".join(out)

    def end(self) -> str:
        torn, self.due = self.due, 0
        return "\ufffd" if torn else ""


class _WholeTokens(dict):
    """By token: its text, if it begins and ends between characters and holds no other bytes, else None; run once through the machine."""

    def __init__(self, tokens: dict[int, bytes]):
        super().__init__()
        self._tokens = tokens

    def __missing__(self, token: int) -> str | None:
        machine = Utf8Machine()
        text = machine.take(self._tokens[token])
        self[token] = None if machine.due or "\ufffd" in text else text
        return self[token]


class StreamDecoder:
    """Ids to text, token by token; a character cut by a token's end waits in the state machine for the rest."""

    def __init__(self, tokens: dict[int, bytes], whole: _WholeTokens | None = None):
        self._tokens, self._whole, self._machine = tokens, _WholeTokens(tokens) if whole is None else whole, Utf8Machine()

    def feed(self, ids: Iterable[int]) -> str:
        ids, machine = list(ids), self._machine
        texts = list(map(self._whole.__getitem__, ids))
        if machine.due or None in texts:
            texts = [t if t is not None and not machine.due else machine.take(self._tokens[i]) for i, t in zip(ids, texts)]
        return "".join(texts)

    def end(self) -> str:
        return self._machine.end()


_codecs: dict[tuple[str, str], "Codec"] = {}


class _Memo(dict):
    """Pieces to their ids, in at most so many entries."""

    def __init__(self, encode, limit: int = 600_000):
        super().__init__()
        self._encode, self._limit = encode, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self._encode(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= self._limit:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Texts to ids and back under one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self._find, self._ids = regex.compile(pattern).findall, _Memo(self.transducer.piece)
        self._whole = _WholeTokens(self.transducer.tokens)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._ids.__getitem__, self._find(text))))

    def decoder(self) -> StreamDecoder:
        return StreamDecoder(self.transducer.tokens, self._whole)


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """Per document: ids, decoded text, and digests of both.

    Null or empty text: no ids.  Null ids, repeated rows and very long texts pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        names = {i: str(i) for i in coder.transducer.tokens}
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                decoder = coder.decoder()
                decoded = decoder.feed(ids) + decoder.end()
                for c, v in zip(cols, (len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), None if digest_only else ids, None if digest_only else decoded)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return out.drop("ids", "decoded") if digest_only else out
