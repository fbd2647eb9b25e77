"""Byte-level BPE by a lazily determinised finite-state transducer, and decoding by an incremental UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay apart when their bytes are merged alone. So
the encoding of each prefix ends with the one token that fits the encoding of what is before it. The transducer reads a byte at a
time; the beginnings of tokens that may be open at once are determinised into one state, when first met. Each state lists the
tokens that end there, and whether two neighbours stay apart is worked out when first asked and kept. Tokens are emitted as soon
as every open beginning lies behind them, looking ahead no further than the longest token may run.

Rows: a null or empty text has no tokens; its decoded text is empty. Null ids decode like no ids; ids outside the vocabulary fail.
Bytes that are not UTF-8 decode to U+FFFD, as in Python. Equal texts have equal tokens.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns

#: Pairs of neighbours, and pieces, whose outcome is kept per worker. (The states are at most the beginnings of tokens.)
MAX_PAIRS = 1 << 18
MAX_PIECES = 1 << 18
#: Bytes held before the tokens that are settled are emitted.
LOOKAHEAD = 1024
#: Longest piece that is kept, and longest text whose pieces are listed at once, in characters.
KEPT_PIECE = 48
LISTED_TEXT = 1 << 20
BYTES = [bytes((b,)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge_piece(piece: bytes, ranks: dict[bytes, int], below: int) -> list[int]:
    """Plain BPE of a few bytes by the ranks under ``below``: the neighbours with the lowest rank merge, the leftmost first."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        merged = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        if min(merged) >= below:
            break
        best = merged.index(min(merged))
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class State:
    """All beginnings of tokens that the bytes read may end with, named by the longest of them. ``ends`` lists the tokens, longest
    first, that end here: (length, token, tokens before it -> whether the two stay apart)."""

    __slots__ = ("ends", "moves", "name")

    def __init__(self, name: bytes, ends: list[tuple[int, int, dict[int, bool]]]):
        self.name, self.ends, self.moves = name, ends, {}


class Transducer:
    """Bytes in, tokens out; states are made when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.begun = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.apart: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.states: dict[bytes, State] = {b"": State(b"", [])}

    def _move(self, state: State, byte: int) -> State:
        name = state.name + BYTES[byte]
        while name not in self.begun:
            if not name:
                raise ValueError("the ranks have no token for a byte")
            name = name[1:]
        target = self.states.get(name)
        if target is None:
            tokens = ((len(name) - k, self.ranks[name[k:]]) for k in range(len(name)) if name[k:] in self.ranks)
            target = self.states[name] = State(name, [(n, t, self.apart.setdefault(t, {-1: True})) for n, t in tokens])
        state.moves[byte] = target
        return target

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte."""
        if token not in self.halves:
            parts = merge_piece(self.bytes[token], self.ranks, token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, merged alone, give these two again.

        Seen backwards in time: a pair across the boundary must not merge before the younger of its two sides is made; then that
        side is taken apart, and what it had at the boundary is the next to look at. Of equal ranks the left side is made first.
        """
        left, right, before = a, b, (len(self.ranks), 1)
        while True:
            pair = self.ranks.get(self.bytes[left] + self.bytes[right])
            if pair is not None and (pair, 0) < before:
                return False
            one, two = self._halves(left), self._halves(right)
            if two is not None and (one is None or right >= left):
                before, right = (right, 1), two[0]
            elif one is not None:
                before, left = (left, 0), one[1]
            else:
                return True

    def _fits(self, left: int, token: int) -> bool:
        if self.pairs >= MAX_PAIRS:
            for known in self.apart.values():
                known.clear()
                known[-1] = True  # before the first token of a piece there is nothing to merge with
            self.pairs = 0
        self.pairs += 1
        fits = self.apart[token][left] = self.stays_apart(left, token)
        return fits

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece. ``last[i]`` is the token that the encoding of the bytes up to i, counted from the last token
        emitted, ends with; what lies before every beginning of a token that is still open is emitted now and then."""
        out: list[int] = []
        last, state = [-1], self.states[b""]
        for at in range(0, len(piece), LOOKAHEAD):
            if at:
                last = self._emit(last, len(state.name), out)
            n = len(last)
            for byte in piece[at:at + LOOKAHEAD]:
                state = state.moves.get(byte) or self._move(state, byte)
                for length, token, known in state.ends:
                    if length <= n:
                        left = last[-length]
                        fits = known.get(left)
                        if self._fits(left, token) if fits is None else fits:
                            break
                else:
                    raise ValueError("the ranks have no token for a byte")
                last.append(token)
                n += 1
        return out + self._way(last, len(last) - 1) if out else self._way(last, len(last) - 1)

    def _way(self, last: list[int], end: int) -> list[int]:
        way, names = [], self.bytes
        while end:
            token = last[end]
            way.append(token)
            end -= len(names[token])
        return way[::-1]

    def _emit(self, last: list[int], reach: int, out: list[int]) -> list[int]:
        """Emit the tokens that the ways to all boundaries share from which a token may still run, at most ``reach`` bytes back."""
        ways = [self._way(last, end) for end in range(len(last) - 1 - reach, len(last))]
        shared = 0
        for tokens in zip(*ways):
            if min(tokens) != max(tokens):
                break
            shared += 1
        new = ways[0][:shared]
        out += new
        done = sum(len(self.bytes[t]) for t in new)
        return [new[-1], *last[done + 1:]] if new else last


class Known(dict):
    """Tokens, as packed ints, of the strings met, up to MAX_PIECES short ones; ``work`` gives those of others."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> bytes:
        tokens = self.work(key)
        if len(key) <= KEPT_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[key] = tokens
        return tokens


class Encoder:
    """Splits by the pattern and encodes each piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.pieces = Known(lambda piece: array("i", self.transducer.encode(piece.encode())).tobytes())

    def encode(self, text: str) -> np.ndarray:
        found: Iterable[str] = self.pattern.findall(text) if len(text) <= LISTED_TEXT else (m.group() for m in self.pattern.finditer(text))
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), np.int32)


def follow(pending: bytes) -> tuple[int, int, int]:
    """For the bytes of a sequence that has begun: lowest and highest next byte, and bytes that the sequence has in all."""
    lead = pending[0]
    low, high = 0x80, 0xBF
    if len(pending) == 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    return low, high, 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Utf8Stream:
    """Incremental UTF-8 state machine: the state is the begun sequence, at most three bytes. Moves by whole tokens are kept."""

    def __init__(self):
        self.moves: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    @staticmethod
    def step(pending: bytes, byte: int) -> tuple[str, bytes]:
        if pending:
            low, high, size = follow(pending)
            if low <= byte <= high:
                pending += bytes((byte,))
                return (pending.decode("utf-8"), b"") if len(pending) == size else ("", pending)
            text, rest = Utf8Stream.step(b"", byte)
            return "�" + text, rest
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes((byte,))) if 0xC2 <= byte <= 0xF4 else ("�", b"")

    def feed(self, pending: bytes, data: bytes) -> tuple[str, bytes]:
        known = self.moves.get((pending, data))
        if known is None:
            text, state = [], pending
            for byte in data:
                new, state = self.step(state, byte)
                text.append(new)
            if len(self.moves) >= MAX_PIECES:
                self.moves.clear()
            known = self.moves[pending, data] = "".join(text), state
        return known


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {r: t for t, r in ranks.items()}
        self.machine = Utf8Stream()
        self.whole: dict[int, str] = {}  # tokens that begin and end between characters
        for rank, token in self.bytes.items():
            try:
                self.whole[rank] = token.decode("utf-8")
            except UnicodeDecodeError:
                pass

    def decode(self, tokens: list[int]) -> str:
        parts = list(map(self.whole.get, tokens))
        if None in parts:
            pending = b""
            for i, part in enumerate(parts):
                if part is None or pending:
                    parts[i], pending = self.machine.feed(pending, self.bytes[tokens[i]])
            if pending:
                parts.append("�")
        return "".join(parts)


@lru_cache(maxsize=2)
def encoder(ranks: tuple, pattern: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(dict(ranks), pattern)


@lru_cache(maxsize=2)
def decoder(ranks: tuple) -> Decoder:
    return Decoder(dict(ranks))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the tokens of its text as a list of ints; one pass. The vocabulary is broadcast (some MB, whatever the data)."""
    held = df.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def make():
        worker = encoder(held.value, pattern)

        def work(values):
            ids = [worker.encode(v) if v else np.zeros(0, np.int32) for v in values.to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))]

        return work

    return append_columns(df, [text], [T.StructField(name, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text that its tokens stand for."""
    held = df.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def make():
        worker = decoder(held.value)

        def work(values):
            ends, flat = values.offsets.to_numpy(), values.values.to_numpy()
            return [pa.array([worker.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())]

        return work

    return append_columns(df, [ids], [T.StructField(name, T.StringType())], make)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass of the same workers: the tokens are not sent there and back."""
    held = df.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def make():
        forth, back = encoder(held.value, pattern), decoder(held.value)

        def work(values):
            ids = [forth.encode(v) if v else np.zeros(0, np.int32) for v in values.to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))),
                    pa.array([back.decode(some.tolist()) for some in ids], pa.string())]

        return work

    return append_columns(df, [text], [T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())], make)
