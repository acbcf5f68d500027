"""Byte-level BPE by longest matches and backtracking: the merges' own result, in linear time.

A vocabulary is a table of byte strings and ranks. Merging a piece pair by pair, lowest rank first, ends in tokens whose
neighbours all are *compatible*: merging the bytes of two neighbours alone gives just these two. Conversely only one cut
of a piece into tokens has that property, so it can be searched: take the longest token at each place (an Aho-Corasick
automaton over the bytes as Latin-1 characters finds the longest match of every place in one pass), fall back to its
longest proper prefix while it does not go with the token before it, and step back when no prefix does. A place that was
left once is marked and never entered again, which bounds the work by the places times the prefixes of a token.

Compatibility of two tokens is decided by undoing their merges, latest first, and asking at each step whether the two
tokens that then meet at the border would have merged earlier; answers are memoised.

Defined cases: a null text is empty (no ids); strings of special tokens are ordinary text; repeated rows and null ids are
kept as they are; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Generations, batches, id_text

MEMO_PAIRS = 500_000  # remembered answers of a worker
CACHE_PIECES = 150_000  # pieces of one cache generation of a worker
ROWS = 256  # texts a worker holds beside their Arrow batch
CACHED_BYTES = 64  # longer pieces are encoded anew each time
_NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Backtracker:
    """Encoder and decoder of one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], memo_pairs: int = MEMO_PAIRS) -> None:
        import ahocorasick

        self.token = {rank: b for b, rank in ranks.items()}
        self.size = {rank: len(b) for b, rank in ranks.items()}
        self.ranks = ranks
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.memo_pairs = memo_pairs
        automaton = ahocorasick.Automaton()
        for rank, b in sorted(self.token.items()):
            if len(b) == 1 or self._split(rank, b):
                automaton.add_word(b.decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: dict[int, int | None] = {}

    def _split(self, rank: int, b: bytes) -> bool:
        """Finds the last merge of a token, given those of lower rank. A token that no merge reaches stands for whole
        pieces only and is no match."""
        for i in range(1, len(b)):
            x, y = self.ranks.get(b[:i]), self.ranks.get(b[i:])
            if x is not None and y is not None and x < rank and y < rank and self._meet(x, y):
                self.left[rank], self.right[rank] = x, y
                self.merged[x, y] = rank
                return True
        return False

    def _meet(self, x: int, y: int) -> bool:
        """Whether merging leaves the border between ``x`` and ``y`` alone."""
        until = _NEVER  # the two stand side by side until the merge that is undone
        while True:
            across = self.merged.get((x, y))
            if across is not None and across < until:
                return False
            if x > y:
                if x not in self.right:
                    return True
                until, x = x, self.right[x]  # at equal rank the merge further left goes first
            else:
                if y not in self.left:
                    return True
                until, y = y + 1, self.left[y]

    def compatible(self, x: int, y: int) -> bool:
        pair = x << 32 | y
        known = self.memo.get(pair)
        if known is None:
            if len(self.memo) >= self.memo_pairs:
                self.memo.clear()
            known = self.memo[pair] = self._meet(x, y)
        return known

    def _prefix(self, rank: int) -> int | None:
        """The longest token that is a proper prefix."""
        if rank not in self.shorter:
            b = self.token[rank]
            found = None
            for n in range(len(b) - 1, 0, -1):
                found = self.ranks.get(b[:n])
                if found is not None and (n == 1 or found in self.left):
                    break
            self.shorter[rank] = found if len(b) > 1 else None
        return self.shorter[rank]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * len(piece)
        size, memo, compatible = self.size, self.memo, self.compatible
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            # a match that ends later at the same place is longer
            longest[end - size[rank] + 1] = rank
        open_ = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, take, before = 0, longest[0] if piece else None, None
        while at < len(piece):
            while take is not None:
                end = at + size[take]
                if open_[end]:
                    if before is None:
                        break
                    known = memo.get(before << 32 | take)
                    if known if known is not None else compatible(before, take):
                        break
                take = self._prefix(take)
            if take is not None:
                out.append(take)
                at, before = end, take
                take = longest[at] if at < len(piece) else None
            else:
                if before is None:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_[at] = 0  # nothing goes on from here
                take = self._prefix(out.pop())
                at -= size[before]
                before = out[-1] if out else None
        return out


class Encoder:
    """Whole texts: pieces of ``pattern``, each distinct short one encoded once per cache generation."""

    def __init__(self, path: str, pattern: str, cache_pieces: int = CACHE_PIECES) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.bpe = Backtracker(read_ranks(path))
        self.cache = Generations(cache_pieces)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.bpe.encode_piece(p.encode()), "<u4").tobytes() for p in pieces]

    def encode(self, text: str) -> bytes:
        """All ids as little-endian 32-bit integers."""
        pieces = self.find(text)
        if max(map(len, pieces), default=0) > CACHED_BYTES:
            return b"".join(self.cache.look_up([p], self._ids)[0] if len(p) <= CACHED_BYTES else self._ids([p])[0] for p in pieces)
        return b"".join(self.cache.look_up(pieces, self._ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, vocabulary and pattern."""
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes | None]:
    """The bytes of every id: all that decoding needs."""
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for b, rank in ranks.items():
        out[rank] = b
    return out


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(tokens(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _slices(it):
    for b in it:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: every text's ids as little-endian 32-bit integers."""
    def work(it):
        e = encoder(path, pattern)
        for b, texts in batches(_slices(it)):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([e.encode(t.decode("utf-8", "replace")) for t in texts], pa.binary())], ["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(work, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for."""
    def work(it):
        for b in _slices(it):
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([decode_ids(x, path) for x in b.column("ids").to_pylist()], pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(work, "doc_id long, ids binary, decoded binary")
