"""Public tokenizers by pre-token: a text is cut where its tokenizer's pre-tokenizer surely cuts it too, and each
distinct piece is encoded by the library once per worker.

The word tokenizer drops white space and never joins across it, so its pieces are the lower-cased words. In the
byte-level one a run of white space belongs with what follows it, and nothing joins a word to the run after it, so its
pieces are a run and the word behind it. Both hold for plain texts (Latin letters, ASCII punctuation, tab and line
ends). Other texts are normalised and cut by the tokenizer's own parts. Only a text that holds a special-token string is
encoded whole by the library.

The library makes an object of every string it encodes, which costs more than the encoding. So a plain piece is cut further,
into the tokenizer's own words, and unknown words are encoded side by side in one string; where a word's ids end shows by the
end-of-word suffix of its last token, or by the bytes its tokens stand for.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np

from .common import Generations

CACHE_PIECES = 400_000  # pieces of one cache generation of a worker

WORDS_OF_A_STRING = 256

_RUN_AND_WORD = re.compile(r"[\t\n\r ]*[^\t\n\r ]+|[\t\n\r ]+")
# outside it white space, case or composition may differ between Unicode versions and engines
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ]")
_NOT_PLAIN_ASCII = re.compile("[^\t\n\r\x20-\x7e]")


def _pattern(spec: dict) -> str | None:
    """The pattern of a tokenizer file's splitting step, None where the byte-level default holds."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    return next((p["pattern"]["Regex"] for p in steps if p["type"] == "Split"), None)


class Pieces:
    """Pre-tokens of one tokenizer and their ids (little-endian 32-bit bytes), with a bounded cache."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower = spec["normalizer"] is not None
        self.normalizer, self.pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.cache = Generations(cache_pieces)
        suffix = spec["model"].get("end_of_word_suffix")
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        of_id = np.zeros(max(tokens.values()) + 1, np.int64)
        for t, i in tokens.items():
            of_id[i] = t.endswith(suffix) if suffix else len(t)  # a character of a byte-level token is a byte
        self.suffix, self.of_id = bool(suffix), of_id
        # the pre-tokenizer's own pattern; words that stay apart when they are written side by side
        self.words = regex.compile(_pattern(spec) or "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+").findall
        self.apart = regex.compile(r"\S+" if suffix else r" \p{L}+").fullmatch
        self.word_cache = Generations(cache_pieces)

    def cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None if only the library may cut it."""
        if any(s in text for s in self.special):
            return None
        if (_NOT_PLAIN_ASCII if text.isascii() else _NOT_PLAIN).search(text):
            if self.normalizer is not None:
                text = self.normalizer.normalize_str(text)
                if any(s in text for s in self.special):
                    return None
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return text.lower().split() if self.lower else _RUN_AND_WORD.findall(text)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _batch(self, words: list[str]) -> list[bytes]:
        """The library's ids of each string; offsets, which nothing here reads, are not computed."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, those that stay apart in strings of many."""
        out: dict[str, bytes] = {}
        apart = [w for w in words if self.apart(w)]
        lots = [apart[k:k + WORDS_OF_A_STRING] for k in range(0, len(apart), WORDS_OF_A_STRING)]
        joined = [(" " if self.suffix else "").join(lot) for lot in lots]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            mark = self.of_id[ids]
            if self.suffix:
                ends = np.flatnonzero(mark) + 1
            else:
                ends = np.searchsorted(np.cumsum(mark), np.cumsum([len(w.encode()) for w in lot])) + 1
            if len(ends) == len(lot) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (ends * 4).tolist()
                out.update(zip(lot, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._batch(rest)))
        return [out[w] for w in words]

    def _cut_word(self, piece: str) -> list[str]:
        """The pre-tokens of a plain piece."""
        if piece.isalpha() if self.suffix else piece[:1] == " " and piece[1:].isalpha():
            return [piece]
        return self.words(piece)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of each piece."""
        if not _NOT_PLAIN.search("".join(pieces)):
            cut = list(map(self._cut_word, pieces))
            known = self.word_cache.look_up([w for c in cut for w in c], self._encode_words)
            if len(known) == len(pieces):
                return known
            known = iter(known)
            return [b"".join([next(known) for _ in c]) for c in cut]
        plain = [not _NOT_PLAIN.search(p) for p in pieces]
        known = iter(self.encode_pieces([p for p, ok in zip(pieces, plain) if ok]))
        other = iter(self._batch([p for p, ok in zip(pieces, plain) if not ok]))
        return [next(known) if ok else next(other) for ok in plain]

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit integers."""
        pieces = self.cut(text)
        return self.encode_whole(text) if pieces is None else b"".join(self.cache.look_up(pieces, self.encode_pieces))

    def ids_of(self, texts: list[str], lot: int = 64) -> Iterator[bytes]:
        """``ids`` of each text; unknown pieces of ``lot`` texts are encoded together."""
        for lo in range(0, len(texts), lot):
            cut = [self.cut(t) for t in texts[lo:lo + lot]]
            known = self.cache.look_up([p for c in cut for p in c or ()], self.encode_pieces)
            at = 0
            for t, c in zip(texts[lo:lo + lot], cut):
                if c is None:
                    yield self.encode_whole(t)
                else:
                    yield b"".join(known[at:at + len(c)])
                    at += len(c)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One per worker process and file: the cache outlives a task."""
    return Pieces(path)


def text_of(b: bytes) -> str:
    return b.decode("utf-8", "replace")
