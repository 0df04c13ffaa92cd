"""Token counts by a finite-state transducer compiled from a piece vocabulary.

A token sequence is the BPE result of a text exactly if each adjacent pair of its
tokens is, so the tokenization of a prefix is fixed by the last tokens of the few
prefixes that an unfinished piece may still reach back to.  Those last tokens, with the
counts at them relative to the current one, are the state; reading a character moves to
one next state and emits the change in the number of tokens (negative where a longer
piece replaces several).  States and transitions are compiled when first met and kept.

Texts are cut into chunks.  A chunk's state map says what it does to any state before
it.  It is made without knowing that state: the chunk is run from the start state, and
the states on the way are kept up to the first reset (a place that no piece crosses),
where all states meet.  Another state reads along until it meets the kept one, mostly
after a few characters, and from there on both have the same future.  State maps compose
associatively, and a balanced scan combines those of a text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches, strings

#: Code points in a chunk, states kept, words kept with their counts, and the longest word kept.
CHUNK, STATES, CACHE_ENTRIES, CACHE_CHARS = 1 << 12, 250_000, 800_000, 48
#: Chunks that are scanned together.
BLOCK = 64
#: Pairs of tokens, and shapes of open parts, that are remembered at a time.
MEMO = 400_000
SPACE = "▁"
NORMAL, BYTE = 1, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b, i = data[i], i + 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = {1: (8, i), 5: (4, i)}.get(key & 7) or varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_model(data: bytes) -> dict[str, float]:
    """Piece -> score of a model file; refuses models whose rules this module does not follow."""
    pieces, kinds = {}, set()
    for field, value in _fields(data):
        if field == 1:
            entry = dict(_fields(value))
            kinds.add(kind := entry.get(3, NORMAL))
            if kind == NORMAL:
                pieces[entry[1].decode()] = struct.unpack("<f", entry[2])[0]
        elif field == 3:
            rules = dict(_fields(value))
            if rules.get(1) != b"identity" or not rules.get(3, 1) or rules.get(4, 1):
                raise ValueError("only models with the identity normalizer, a leading space and kept white space are supported")
    if BYTE not in kinds or any(p.find(SPACE, len(p) - len(p.lstrip(SPACE))) > 0 for p in pieces):
        raise ValueError("only models with byte fallback whose pieces hold spaces at their front are supported")
    return pieces


class StateMap(NamedTuple):
    """What a chunk does to the state before it.

    ``head`` is the chunk up to its first reset, or all of it; ``met[i]`` is the state
    before its i-th character and the tokens until there when it is read from the start
    state, ``met[-1]`` those after it.  Behind the head ``count`` tokens follow, and if
    there is a reset, the state after the chunk is ``exit`` (else None).
    """

    head: str
    met: list[tuple[int, int]]
    count: int
    exit: int | None


class _Words(dict):
    """Word -> tokens that it emits from the start state."""

    def __init__(self, machine: CountTransducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.run(0, word)[1]
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n


class CountTransducer:
    """Deterministic transducer from characters to emitted-token counts."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.starts = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        # these two have no more entries than the vocabulary
        self.canonical: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shapes: dict[str, tuple] = {}
        self.split: dict[str, tuple[str, str]] = {}
        self.rank = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: -pieces[p]))}
        self.forget()
        #: tokens after whose end some piece of the vocabulary can still be cut differently
        ends = {p[:k] for p in pieces for k in range(1, len(p))}
        self.joins = {p for p in self.pieces if any(p[j:] in ends for j in range(len(p)))}
        inside = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = "".join(c for c in map(chr, range(128)) if c not in inside and c != " ")
        cut = re.escape(self.alone)
        self.words = re.compile(f"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+")
        self.reset = re.compile(f"[{cut}]|(?<!{SPACE}){SPACE}")
        self.known = _Words(self)

    def forget(self) -> None:
        """Back to the start state alone; numbers of states before it mean nothing any more."""
        # state: (characters that may still be part of a piece, last tokens and relative counts at and before them)
        self.states: list[tuple] = [("", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    # -- compilation

    def bpe(self, text: str) -> list[str]:
        """Tokens of a short text: best score first, leftmost first."""
        symbols = list(text)
        while True:
            best = max(((s, -i) for i in range(len(symbols) - 1) if (s := self.pieces.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                return symbols
            symbols[-best[1] : -best[1] + 2] = [symbols[-best[1]] + symbols[-best[1] + 1]]

    def follows(self, last: str | None, piece: str) -> bool:
        """Can ``piece`` stand after ``last`` in a result?  None: nothing that it could merge with."""
        if last is None:
            if piece not in self.canonical:
                self.canonical[piece] = self.bpe(piece) == [piece]
            return self.canonical[piece]
        key = last, piece
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.follows(None, piece) and self.stable(last, piece)
        return known

    def stable(self, a: str, b: str) -> bool:
        """Does BPE keep the border of ``a`` and ``b``?  It unmakes the later of the two merges that
        gave them, again and again, and looks for a merge across the border that came first."""
        if SPACE in (a[-1], b[0]):
            return self.bpe(a + b) == [a, b]  # pieces of spaces have equal scores
        rank, limit = self.rank, 1 << 40
        while True:
            if (across := rank.get(a + b)) is not None and across < limit:
                return False
            ra, rb = rank.get(a, -1) if len(a) > 1 else -1, rank.get(b, -1) if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves(a)[1]
            else:
                limit, b = rb + 1, self.halves(b)[0]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two symbols whose merge gives a piece."""
        if piece not in self.split:
            symbols = list(piece)
            while len(symbols) > 2:
                _, i = max((s, -i) for i in range(len(symbols) - 1) if (s := self.pieces.get(symbols[i] + symbols[i + 1])) is not None)
                symbols[-i : -i + 2] = [symbols[-i] + symbols[-i + 1]]
            self.split[piece] = symbols[0], symbols[1]
        return self.split[piece]

    def shape(self, grown: str) -> tuple:
        """What holds for any state that reads into ``grown``: the tokens that may end here, longest
        first, with their costs; where the part begins that a piece may still grow from (None for its
        places: nothing can, as after a character that falls back to bytes); the places that matter."""
        if grown[-1] not in self.starts:
            return [(len(grown) - 1, grown[-1], len(grown[-1].encode()))], len(grown), None
        ends = [(j, p, 1) for j in range(len(grown)) if (p := grown[j:]) in self.pieces]
        if len(ends) == 0 or len(ends[-1][1]) > 1:
            ends.append((len(grown) - 1, grown[-1], len(grown[-1].encode())))
        keep = next(j for j in range(len(grown)) if grown[j:] in self.starts)
        return ends, keep, [j if grown[j:] in self.starts else -1 for j in range(keep, len(grown))]

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state on a character."""
        open_, lasts, counts = self.states[state]
        grown = open_ + char
        if (found := self.shapes.get(grown)) is None:
            if len(self.shapes) >= MEMO:
                self.shapes.clear()
            found = self.shapes[grown] = self.shape(grown)
        ends, keep, live = found
        for j, piece, cost in ends:
            if self.follows(lasts[j], piece):
                emitted = counts[j] + cost
                break
        else:
            raise AssertionError(f"no token ends after {grown!r}")
        if live is None:
            to = self.states[0]
        else:
            if piece not in self.joins:
                piece = None  # no piece begins with the end of this one and what may follow
            kept_lasts = [lasts[j] if j >= 0 else None for j in live]
            if grown[keep:] == SPACE and open_[-1:] != SPACE:
                kept_lasts[0] = None  # no piece crosses the place before it
            to = (grown[keep:], (*kept_lasts, piece), (*[counts[j] - emitted if j >= 0 else 0 for j in live], 0))
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
            self.moves.append({})
        self.moves[state][char] = move = (self.number[to], emitted)
        return move

    # -- use

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State after a text and the tokens emitted."""
        moves, n = self.moves, 0
        for char in text:
            move = moves[state].get(char) or self.compile(state, char)
            state = move[0]
            n += move[1]
        return state, n

    def state_map(self, chunk: str) -> StateMap:
        """State map of a chunk of escaped text."""
        first = self.reset.search(chunk, 1)
        head = chunk[: first.start()] if first else chunk
        state, n, met = 0, 0, [(0, 0)]
        for char in head:
            state, more = self.moves[state].get(char) or self.compile(state, char)
            n += more
            met.append((state, n))
        if not first:
            return StateMap(head, met, 0, None)
        words = self.words.findall(chunk, first.start())
        exit_, last = self.run(0, words.pop())
        return StateMap(head, met, sum(map(self.known.__getitem__, words)) + last, exit_)

    def through(self, state: int, m: StateMap) -> tuple[int, int]:
        """State after a chunk that is entered in a state, and the tokens emitted."""
        n = 0
        for i, char in enumerate(m.head):
            if state == m.met[i][0]:  # from here on as it was read before
                state, n = m.met[-1][0], n + m.met[-1][1] - m.met[i][1]
                break
            state, more = self.moves[state].get(char) or self.compile(state, char)
            n += more
        return (state if m.exit is None else m.exit), n + m.count

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First ``a``, then ``b``: each the maps that wait for a state, tokens after them, and the state then (or None)."""
        waiting, n, state = a
        if state is None:
            return (*waiting, *b[0]), n + b[1], b[2]
        for m in b[0]:
            state, more = self.through(state, m)
            n += more
        return waiting, n + b[1], state if b[2] is None else b[2]

    def scan(self, state: int, maps: list[StateMap]) -> tuple[int, int]:
        """State and tokens after chunks in a row: neighbours are composed in turn, a balanced tree."""
        level = [((m,), 0, m.exit) for m in maps]
        while len(level) > 1:
            level = [self.compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return self.compose(((), 0, state), level[0])[2:0:-1]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text, in blocks of chunks; between blocks old states may be forgotten."""
        state = n = 0
        for i in range(0, len(text), BLOCK * chunk):
            escaped = SPACE * (i == 0) + text[i : i + BLOCK * chunk].replace(" ", SPACE)
            state, more = self.scan(state, [self.state_map(escaped[j : j + chunk]) for j in range(0, len(escaped), chunk)])
            n += more
            if len(self.states) > STATES:
                kept = self.states[state]
                self.forget()
                state = self.number.setdefault(kept, len(self.states))
                if state:
                    self.states.append(kept)
                    self.moves.append({})
        return n


@lru_cache(maxsize=4)
def load(model: bytes) -> CountTransducer:
    """One transducer for each model and Python worker."""
    return CountTransducer(read_model(model))


def count_tokens(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row's whole text.

    Null and empty texts have 0 bytes and tokens; repeated rows stay; null ids pass
    through; an empty table gives an empty result; no other column is read, so none can
    clash.  One pass without a shuffle; the model file is read on the driver and broadcast.
    """
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        count = load(shared.value).count

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column(1))
            tokens = [count(t) for t in texts]
            columns = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_bytes", "n_tokens", "over_limit"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
