"""Byte-level BPE by a lazily determinised finite-state transducer.

A tokenization is the one the merges give exactly if every two neighbouring
tokens are what the merges give for their joined bytes. So the last token of
every prefix is determined by the prefix, and a left-to-right machine can find
it. Its state is the last token written and the bytes read since. A token is
written as soon as all boundaries that a later byte can still extend agree on
it, so the delay is at most the longest token. States and moves are made when
they are needed again and kept in a bounded table; before that the boundaries
are followed one by one.

Texts are cut by the pattern first; a piece that is a token is that token.
Decoding goes token by token through a UTF-8 state machine that holds back an
unfinished character.

Null texts count as empty and give no ids. Repeated rows give repeated results.
"""

from __future__ import annotations

import array
import base64
import functools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import Bounded, map_batches, remember

# Entries kept by the tables of a worker; they start anew when full.
PIECES = 400_000
MOVES = 150_000
PAIRS = 150_000
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], moves: int | None = None):
        self.ranks = ranks
        self.most = MOVES if moves is None else moves
        # What bytes can be, in one lookup: the opening of a longer token (1), a token (2), or both.
        self.kinds = dict.fromkeys(ranks, 2)
        for token in ranks:
            for n in range(1, len(token)):
                self.kinds[token[:n]] = self.kinds.get(token[:n], 0) | 1
        self.edges = Bounded(self._edges, len(ranks) + 1)
        self.fits = Bounded(self._fits, PAIRS)
        self._forget()

    def _edges(self, token: bytes) -> tuple[bool, list, list]:
        """Whether the merges give the token, and what stands at its left and right edge until which merge."""
        parts = [token[i : i + 1] for i in range(len(token))]
        left, right = [], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) == 1, [*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)]

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether the merges leave the boundary between two tokens.

        The tokens are built side by side. While two edges face each other, the
        merge of both must not come before the merge that ends one of them; of
        equal merges the left one comes first.
        """
        ends, begins = self.edges[pair[0]][2], self.edges[pair[1]][1]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], begins[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank != NEVER and rank < x_until and rank <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _forget(self) -> None:
        # State 0: nothing read. A state: last token written, bytes since, and the tokens up to each live boundary.
        self.states: list[tuple[bytes, bytes, dict[int, tuple[bytes, ...]]]] = [(b"", b"", {0: ()})]
        self.numbers = {(b"", b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: set[int] = set()

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, seen, live = self.states[state]
        seen += bytes((byte,))
        end = len(seen)
        for start, before in live.items():
            token = seen[start:]
            if token in self.ranks and self.edges[token][0]:
                left = before[-1] if before else last
                if not left or self.fits[left, token]:
                    live = live | {end: (*before, token)}
                    break
        kinds = self.kinds
        live = {at: tokens for at, tokens in live.items() if at == end or kinds.get(seen[at:], 0) & 1}
        out, *others = live.values()
        for path in others:
            agreed, most = 0, min(len(out), len(path))
            while agreed < most and out[agreed] == path[agreed]:
                agreed += 1
            out = out[:agreed]
            if not out:
                break
        if out:
            cut = sum(map(len, out))
            last, seen = out[-1], seen[cut:]
            live = {at - cut: tokens[len(out) :] for at, tokens in live.items()}
        number = self.numbers.get((last, seen))
        if number is None:
            number = self.numbers[last, seen] = len(self.states)
            self.states.append((last, seen, live))
        move = self.moves[state << 8 | byte] = number, tuple(self.ranks[token] for token in out)
        return move

    def _rest(self, state: int, rest: bytes) -> list[int]:
        """The ids to the end of the piece, without making states: all live boundaries are followed at once.

        A boundary has one last token, so it only remembers where that begins; the
        tokens are read off from the end. Time and memory are linear in the piece.
        """
        last, seen, live = self.states[state]
        raw, paths, known = seen + rest, list(live), len(seen)
        lasts = {at: tokens[-1] if tokens else last for at, tokens in live.items()}
        begins = array.array("l", bytes(8 * (len(raw) + 1)))
        ranks, kind_of, fits, edges = self.ranks, self.kinds.get, self.fits, self.edges
        for end in range(known + 1, len(raw) + 1):
            following, found = [], False
            for at in paths:
                token = raw[at:end]
                kind = kind_of(token)
                if kind is None:
                    continue
                if kind & 2 and not found and edges[token][0]:
                    left = raw[begins[at] : at] if at > known else lasts[at]
                    if not left or fits[left, token]:
                        begins[end], found = at, True
                if kind & 1:
                    following.append(at)
            if found:
                following.append(end)
            paths = following
        at, out = paths[-1], []
        while at > known:
            out.append(ranks[raw[begins[at] : at]])
            at = begins[at]
        return [ranks[token] for token in live[at]] + out[::-1]

    def run(self, raw: bytes) -> list[int]:
        """The ids of a piece; each is written as soon as it is certain.

        A move that is met for the second time is entered into the table.
        """
        if raw in self.ranks:
            return [self.ranks[raw]]
        if len(self.moves) > self.most or len(self.met) > 4 * self.most:
            self._forget()
        state, moves, out = 0, self.moves, []
        for at, byte in enumerate(raw):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in self.met:
                    self.met.add(key)
                    return out + self._rest(state, raw[at:])
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        _, seen, live = self.states[state]
        return out + [self.ranks[token] for token in live[len(seen)]]


class Utf8:
    """Takes bytes in any cuts and gives the characters that are complete."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(raw: bytes) -> int:
        """Bytes at the end that begin a character and lack its rest."""
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if byte >= 0xC0:
                size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if size > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        keep = self.unfinished(raw)
        self.held = raw[len(raw) - keep :]
        return raw[: len(raw) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], text: dict[int, bytes]) -> Iterator[str]:
    """Characters as the ids come in; the text is their concatenation."""
    machine = Utf8()
    for number in ids:
        if piece := machine.feed(text[number]):
            yield piece
    if piece := machine.close():
        yield piece


@functools.cache
def tokenizer(path: str, pattern: str, pieces: int, moves: int):
    """A worker's transducer, its table of pieces and its pattern."""
    remember("bpe", tokenizer.cache_clear)
    transducer = Transducer(read_ranks(path), moves)

    def ids(piece: str) -> bytes:
        found = transducer.run(piece.encode())
        return struct.pack(f"<{len(found)}I", *found)

    return transducer, Bounded(ids, pieces), regex.compile(pattern)


def encode_text(text: str | None, path: str, pattern: str, pieces: int = PIECES, moves: int = MOVES) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    _, known, cut = tokenizer(path, pattern, pieces, moves)
    return b"".join(map(known.__getitem__, cut.findall(text or "")))


@functools.cache
def token_texts(path: str) -> dict[int, bytes]:
    remember("bpe-decode", token_texts.cache_clear)
    return {rank: token for token, rank in read_ranks(path).items()}


def decode_ids(ids: bytes, path: str, step: int = 1 << 16) -> str:
    text, machine = token_texts(path), Utf8()
    numbers = np.frombuffer(ids, "<u4")
    out = [machine.feed(b"".join(map(text.__getitem__, numbers[at : at + step].tolist()))) for at in range(0, len(numbers), step)]
    return "".join([*out, machine.close()])


def encode(docs: DataFrame, path: str, pattern: str, pieces: int = PIECES, moves: int = MOVES) -> DataFrame:
    """``doc_id``, ``ids`` (binary: little-endian unsigned 32-bit) of every text.

    Smaller tables of ``pieces`` and ``moves`` take less memory and more time; ids are the same.
    """

    def step(batches):
        for batch in batches:
            ids = [encode_text(text, path, pattern, pieces, moves) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), step, "doc_id long, ids binary", keeps=("bpe", "bpe-decode"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` they stand for."""

    def step(batches):
        for batch in batches:
            texts = [decode_ids(ids or b"", path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), step, "doc_id long, ids binary, text string", keeps=("bpe", "bpe-decode"))
