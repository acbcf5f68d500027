"""Shared helpers of the training-data operators: column access, byte words, hashing, bounded sampling.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; ``bytes.lower`` folds A-Z only and ``bytes.split``
cuts at exactly those bytes, so ``text.lower().split()`` on UTF-8 bytes gives the words of the contracts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 400_000  # entries a worker keeps per cache before it starts anew

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def crc_mod(doc_id: Column, m: int) -> Column:
    """``crc32(doc_id as text) mod m``."""
    return F.crc32(doc_id.cast("string")) % F.lit(m)


def id_text(df: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """``(doc_id, text as UTF-8 bytes, extra...)``: only these columns are read, so other names cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *extra)


class WordHashes:
    """64-bit hashes of byte words with a bounded per-worker cache."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        c = self.cache
        try:
            return np.fromiter(map(c.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(c) > CACHE_WORDS:
                c.clear()
            digest = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in c:
                    c[w] = digest(w)
            return np.fromiter(map(c.__getitem__, words), np.uint64, len(words))


class Generations:
    """A cache of two generations: when the new one is full it becomes the old one, and what is asked for again moves over,
    so frequent keys are never forgotten. Holds at most ``2 * size`` entries and those of one call."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def look_up(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of ``keys``; ``make`` gives those of the distinct keys that are not known."""
        try:
            return list(map(self.new.__getitem__, keys))
        except KeyError:
            new, old = self.new, self.old
            unknown = list(set(keys).difference(new))
            if old:
                again = {k: old[k] for k in unknown if k in old}
                new.update(again)
                unknown = [k for k in unknown if k not in again]
            new.update(zip(unknown, make(unknown)))
            out = list(map(new.__getitem__, keys))
            if len(new) > self.size:
                self.old, self.new = new, {}
            return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, none without words."""
    if len(h) == 0:
        return h
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, np.uint64(m), np.uint64)
    for k in range(m):
        out = mix(out * _GOLD + h[k:len(h) - m + 1 + k])
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each Arrow batch with its texts as bytes (null: empty)."""
    for b in it:
        if b.num_rows:
            yield b, [t or b"" for t in b.column("text").to_pylist()]


def hash_fraction(id_col: Column, seed: int) -> Column:
    """A repeatable uniform draw in [0, 1) from an id."""
    return F.pmod(F.xxhash64(id_col.cast("string"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
