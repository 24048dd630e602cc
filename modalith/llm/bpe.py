"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is what BPE makes of its bytes exactly if every two neighbours are what BPE makes of theirs. So the last token of
the encoding of every prefix is the one that is a suffix of it and fits the last token of what stands before; going back from the end
of the text gives the encoding. Read forwards, every prefix has one way, the tokens of its encoding, and reading a byte adds one. Which
ways can still be part of the whole text's is decided by the few bytes to come: those from whose end on a longer token could still
run. What all of them begin with is certain and emitted.

A state of the transducer is what its live ways hold beyond that, each with the node of the tokens' trie that the bytes after it have
reached, and, if a token may still begin right behind what was emitted, the last token emitted. States and moves are made when they
are first needed, and all bytes are read by moves. Moves that are used stay, in two generations: when the young one is full it becomes
the old one, whose moves come back one by one as they are used again. A pre-token ends with a flush to the start state.

The decoder reads tokens one by one and emits text as soon as characters are complete. It is a UTF-8 state machine over bytes; its
moves over whole tokens are composed when first needed.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.llm.common import col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{L}\p{N}\s]+|\s+(?!\S)|\s+"
#: The same for texts without the characters of odd_characters(), in terms of the faster standard module.
_FAST = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: What a worker remembers at most, in a young and an old generation of so many each: pre-tokens, moves; and pairs of tokens.
MEMO, MOVES, PAIRS = 200_000, 80_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def odd_characters() -> tuple[str, str]:
    """Two character classes: those that the two patterns may class differently, and a simpler one that holds all of these."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    odd: set[str] = set()
    for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(a, every)) ^ set(re.findall(b, every))
    spans: list[list[int]] = []
    for c in sorted(map(ord, odd)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    named = lambda spans: "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"
    return named(spans), named([*(x for x in spans if x[1] < 256), [256, sys.maxunicode]])


def split_table(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens that every longer token is merged from."""
    pairs: dict[tuple[int, int], int] = {}
    splits: dict[int, tuple[int, int]] = {}
    for t, r in sorted(ranks.items(), key=lambda x: x[1]):
        for i in range(1, len(t)):
            a, b = ranks.get(t[:i], r), ranks.get(t[i:], r)
            if a < r and b < r and _may_meet(a, b, pairs, splits):
                pairs[a, b] = r
                splits[r] = a, b
                break
    return splits


def _may_meet(a: int, b: int, pairs: dict[tuple[int, int], int], splits: dict[int, tuple[int, int]]) -> bool:
    """Whether no merge reaches over the border of a and b before each of them is whole.

    The parts of a at its right end and of b at its left end are followed back through time, the later merge first: a pair of them that
    stood side by side must not have been able to merge at that time.
    """
    until = 1 << 60
    while True:
        if pairs.get((a, b), until) < until:
            return False
        later, earlier = (a, b) if a > b else (b, a)
        right = a > b
        if later not in splits:
            right, later = not right, earlier
            if later not in splits:
                return True
        # the piece of the left token at the border is its right half, and the other way round; of two merges of one rank the left
        # one comes first
        if right:
            until, a = a, splits[a][1]
        else:
            until, b = b + 1, splits[b][0]


#: What has been emitted plays no part.
ANY = -2

#: Live ways, each as (its tokens beyond what was emitted, node reached behind them), longest bytes behind them first.
Ways = tuple[tuple[tuple[int, ...], int], ...]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], splits: dict[int, tuple[int, int]] | None = None) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks = ranks
        self.splits = split_table(ranks) if splits is None else splits
        self.pairs = {v: k for k, v in self.splits.items()}
        self.meet: dict[int, bool] = {}
        #: The trie of tokens: node << 8 | byte -> node; of every node its token or -1, and whether it goes on.
        self.trie: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for t, r in ranks.items():
            at = 0
            for b in t:
                self.goes_on[at] = True
                key = at << 8 | b
                at = self.trie.get(key, 0)
                if not at:
                    at = self.trie[key] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
            self.token[at] = r
        self.read = self.made = 0
        self.forget()

    def forget(self) -> None:
        """state << 8 | byte -> (tokens emitted, next state)."""
        self.moves: dict[int, tuple[tuple[int, ...], int]] = {}
        self.old: dict[int, tuple[tuple[int, ...], int]] = {}
        #: Of states, by number: (last token emitted or ANY or -1 for none, live ways); and the other way round.
        self.states: list[tuple[int, Ways]] = []
        self.numbers: dict[tuple[int, Ways], int] = {}
        self.start = self._number((-1, (((), 0),)))

    def _number(self, state: tuple[int, Ways]) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def _age(self) -> None:
        """The young generation becomes the old one; states that no move of it leads from or to are forgotten, the others renumbered."""
        kept, self.old = self.moves, {}
        states, numbers = self.states, {}
        self.moves, self.states, self.numbers = {}, [], {}
        self.start = self._number((-1, (((), 0),)))

        def new(n: int) -> int:
            if n not in numbers:
                numbers[n] = self._number(states[n])
            return numbers[n]

        for key, (emitted, to) in kept.items():
            self.old[new(key >> 8) << 8 | key & 255] = emitted, new(to)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: the pair with the lowest rank merges, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            rank, i = min((r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1], 1 << 60)) is not None)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def _move(self, at: int, b: int) -> tuple[tuple[int, ...], int]:
        """The move from a state that is not in the young generation."""
        key = at << 8 | b
        move = self.old.get(key)
        if move is None:
            self.made += 1
            move = self._made(at, b)
        self.moves[key] = move
        return move

    def _made(self, at: int, b: int) -> tuple[tuple[int, ...], int]:
        prev, ways = self.states[at]
        step, token, goes_on, meet = self.trie.get, self.token, self.goes_on, self.meet
        still, mine = [], None
        for way in ways:
            path, node = way
            node = step(node << 8 | b)
            if node is None:
                continue
            t = token[node]
            if mine is None and t >= 0:
                before = path[-1] if path else prev
                if before < 0:
                    mine = (*path, t)
                else:
                    pair = before << 32 | t
                    fits = meet.get(pair)
                    if fits is None:
                        fits = meet[pair] = _may_meet(before, t, self.pairs, self.splits)
                    if fits:
                        mine = (*path, t)
            if goes_on[node]:
                still.append((path, node))
        if not still:
            return mine, self._number((mine[-1], (((), 0),)))
        still.append((mine, 0))
        first = still[0][0]
        if not first:
            # a token may still begin right behind what was emitted
            return (), self._number((prev, tuple(still)))
        paths = [p for p, _ in still]
        low, high = min(paths), max(paths)
        if low[0] != high[0]:
            return (), self._number((ANY, tuple(still)))
        cut = 1
        for x, y in zip(low[1:], high[1:]):
            if x != y:
                break
            cut += 1
        rest = tuple([(p[cut:], n) for p, n in still])
        return low[:cut], self._number((low[cut - 1] if len(first) == cut else ANY, rest))

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(self.moves) > MOVES:
            self._age()
        if len(self.meet) > PAIRS:
            self.meet.clear()
        self.read += len(data)
        at, get, make, out = self.start, self.moves.get, self._move, []
        for b in data:
            emitted, at = get(at << 8 | b) or make(at, b)
            if emitted:
                out += emitted
        # the last way is that of all bytes
        return (*out, *self.states[at][1][-1][0])


class Encoder:
    def __init__(self, ranks: dict[bytes, int], odd: tuple[str, str], splits: dict[int, tuple[int, int]] | None = None) -> None:
        self.transducer, (self.odd, self.wide) = Transducer(ranks, splits), map(re.compile, odd)
        self.fast, self.full = re.compile(_FAST), regex.compile(PATTERN)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        get, out = self.young.get, []
        for piece in (self.full if self.wide.search(text) and self.odd.search(text) else self.fast).findall(text):
            out += get(piece) or self._encoded(piece)
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        return out

    def _encoded(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece) or self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self.young[piece] = ids
        return ids


#: State 0 waits for a character. (state, least next byte, greatest) -> state; a lead byte's state says what may follow it.
_LEADS = [(0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
_FOLLOW = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
_LEAD = {b: s for lo, hi, s in _LEADS for b in range(lo, hi + 1)}


class Decoder:
    """Text from tokens that come one by one. A byte that can't go on a character begins anew, and what was broken off becomes
    U+FFFD, as does every byte that can begin none."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.moves: dict[tuple[tuple[int, bytes], int], tuple[str, tuple[int, bytes]]] = {}
        self.whole = {i: t.decode() for i, t in tokens.items() if self._read((0, b""), t)[1] == (0, b"") and "�" not in t.decode("utf-8", "replace")}
        self.reset()

    def reset(self) -> None:
        self.state = (0, b"")

    @staticmethod
    def _read(state: tuple[int, bytes], data: bytes) -> tuple[str, tuple[int, bytes]]:
        s, held = state
        out: list[str] = []
        for b in data:
            if s:
                lo, hi, to = _FOLLOW[s]
                if lo <= b <= hi:
                    s, held = to, held + bytes([b])
                    if not s:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                s, held = 0, b""
            if b < 0x80:
                out.append(chr(b))
            elif b in _LEAD:
                s, held = _LEAD[b], bytes([b])
            else:
                out.append("�")
        return "".join(out), (s, held)

    def feed(self, token: int) -> str:
        """The text that this token completes."""
        key = (self.state, token)
        move = self.moves.get(key)
        if move is None:
            move = self.moves[key] = self._read(self.state, self.tokens[token])
        self.state = move[1]
        return move[0]

    def finish(self) -> str:
        out = "�" if self.state[0] else ""
        self.reset()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        out, state, whole, feed, start = [], True, self.whole.get, self.feed, (0, b"")
        self.reset()
        for i in ids:
            t = whole(i) if state else None
            if t is None:
                t = feed(i)
                state = self.state == start
            out.append(t)
        return "".join(out) + self.finish()


_MADE: dict[str, tuple[Encoder, Decoder]] = {}


def _codec(vocabulary: str, shared: object) -> tuple[Encoder, Decoder]:
    """A worker makes them once; what they have learned serves its later tasks."""
    if vocabulary not in _MADE:
        ranks, splits, odd = shared.value
        _MADE.clear()
        _MADE[vocabulary] = Encoder(ranks, odd, splits), Decoder({v: k for k, v in ranks.items()})
    return _MADE[vocabulary]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, verify: bool = True, text: bool = True) -> DataFrame:
    """docs with tokens (array<int>), n_tokens (int) and, if verify, round_trip (boolean): whether the decoder gives the text again.
    Columns of these names in docs are replaced. Without text, the column text is left out.

    A null text has null tokens, an empty one none. Strings of special tokens are ordinary text. Repeated rows are encoded alike; an
    empty table gives an empty table. The vocabulary is read by the driver alone.
    """
    ranks = load_ranks(vocabulary)
    # about 3 MB, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((ranks, split_table(ranks), odd_characters()))
    mark = f"{vocabulary} {hash(frozenset(ranks.items()))}"
    docs = docs.drop("tokens", "n_tokens", "round_trip")
    names = [c for c in docs.columns if text or c != "text"]
    plain = docs.select(col("text").alias("text"), *(col(c).alias(f"c{i}") for i, c in enumerate(names) if c != "text"))
    kept = [i for i, c in enumerate(names) if c != "text"]
    extra = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), *([T.StructField("round_trip", T.BooleanType())] if verify else [])]
    out = T.StructType([*(f for f in plain.schema if text or f.name != "text"), *extra])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(mark, shared)
        for whole in batches:
            at = 0
            while at < len(whole):
                # pieces of a batch, so that little more than one text's tokens is ever held
                some = whole.slice(at, 128)
                at += len(some)
                offsets, ids, right, nulls = [0], array("i"), [], []
                for t in some["text"].to_pylist():
                    mine = [] if t is None else encoder.encode(t)
                    ids.extend(mine)
                    offsets.append(len(ids))
                    nulls.append(t is None)
                    right.append(None if t is None or not verify else decoder.decode(mine) == t)
                none, ends = np.array(nulls), np.array(offsets, np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, np.int32)) if ids else pa.array([], pa.int32()), mask=pa.array(none))
                columns = [*(c for c, f in zip(some.columns, some.schema) if text or f.name != "text"), tokens, pa.array(np.diff(ends), mask=none), *([pa.array(right, pa.bool_())] if verify else [])]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    made = plain.mapInArrow(encoded, out)
    place = {names[i]: f"c{i}" for i in kept}
    return made.select(*(F.col(place.get(c, "text")).alias(c) for c in names), *(f.name for f in extra))


def decode_documents(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """tokens with text: what the column tokens spells. Null tokens give a null text, no tokens an empty one; an unknown token is an
    error. A column text is replaced."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder({v: k for k, v in shared.value.items()})
        for rows in batches:
            yield pd.Series([None if r is None else decoder.decode(map(int, r)) for r in rows], dtype=object)

    return tokens.withColumn("text", decoded(F.col("tokens")))
