"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask keeps inside a window; the words it ignores may be substituted. Seeds
of the test set meet the seeds of the texts; at each hit the two texts are aligned, and any run of the aligned words
counts that holds ``MIN_WORDS`` words, or all of a shorter item, with a share of ``MIN_SHARE`` equal, whatever stands
beside it. One for a matching word and ``-MISMATCH`` for a substituted one add up to 0 or more in exactly those runs.

The seeds miss no such run. A run of twice ``MIN_WORDS`` or more has a half that counts too, so one of 13 to 25 words is
there; it has at most a fifth substituted, which leaves four equal words side by side, or else three equal words five
times in 15 words with one substituted between them; ``MASKS`` has one mask for each. Shorter items are cut into two
pieces more than the words that may be substituted, and have a mask for every two pieces.

The test set is read in parts of at most about ``PART_WORDS`` words. A part's seeds are broadcast (its size is the
bound) and each part takes one pass over the texts, so a larger test set means more passes, not a larger broadcast.

Defined cases: texts and items that are null or empty, or have fewer than ``MIN_ITEM`` words, overlap with nothing;
items of fewer than ``MIN_WORDS`` words are found where they stand whole, a share of ``MIN_SHARE`` equal; repeated texts, items and passages are all reported,
repeated rows of one id once; null ids never appear; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, WordHashes, batches, id_text, mix

# 1 keeps a word, 0 ignores it.
MASKS = ("1111", "111011101110111")
MIN_WORDS = 13
MIN_ITEM = 5
MIN_SHARE = 0.8
MISMATCH = 4  # MIN_SHARE / (1 - MIN_SHARE)
PART_WORDS = 500_000
_FILTER_BITS = 22
_HITS = 200_000  # looked at side by side


def short_masks(n: int) -> list[str]:
    """Masks of an item of ``n`` words, of which one at least ignores any words that may be substituted."""
    cut = np.array_split(np.arange(n), n - math.ceil(MIN_SHARE * n) + 2)
    return ["".join("01"[k in x or k in y] for k in range(n)) for x, y in combinations(cut, 2)]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed of every window of ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, np.uint64(int(mask, 2)), np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1":
            out = out * _GOLD + h[k:k + n]
    return mix(out)


@dataclass
class Part:
    """A part of the test set: item words one behind the other, and seeds by mask."""

    item_ids: np.ndarray
    start: np.ndarray          # of each item in ``words``, and the end of the last
    words: np.ndarray
    index: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]  # mask, filter, sorted seeds, their places


def index_items(items: list[tuple[int, bytes]]) -> Part:
    words = WordHashes()
    hs = [(i, words((t or b"").lower().split())) for i, t in items if i is not None]
    hs = [(i, h) for i, h in hs if len(h) >= MIN_ITEM]
    start = np.cumsum([0] + [len(h) for _, h in hs])
    masks = {m: [k for k, (_, h) in enumerate(hs) if len(h) >= max(MIN_WORDS, len(m))] for m in MASKS}
    for n in sorted({len(h) for _, h in hs if len(h) < MIN_WORDS}):
        masks |= dict.fromkeys(short_masks(n), [k for k, (_, h) in enumerate(hs) if len(h) == n])
    index = []
    for mask, members in masks.items():
        if not members:
            continue
        s = [seeds(hs[k][1], mask) for k in members]
        at = np.concatenate([start[k] + np.arange(len(x)) for k, x in zip(members, s)])
        s = np.concatenate(s)
        order = np.argsort(s, kind="stable")
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[s >> np.uint64(64 - _FILTER_BITS)] = True
        index.append((mask, bits, s[order], at[order]))
    return Part(np.array([i for i, _ in hs], np.int64), start,
                np.concatenate([h for _, h in hs]) if hs else np.empty(0, np.uint64), index)


def _best_run(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """The run of at least ``least`` words, a share of ``MIN_SHARE`` equal, with the most equal words.

    Substituted words at its ends are left out as far as ``least`` allows. None if there is no such run.
    """
    n = len(same)
    if n < least:
        return None
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    top = np.maximum.accumulate(score[::-1])  # the highest score from each place on, from the last place
    first = np.arange(n - least + 1)
    last = n - np.searchsorted(top, score[first])  # the last place that scores no less
    equal = np.concatenate([[0], np.cumsum(same)])
    gain = np.where(last - first >= least, equal[last] - equal[first], -1)
    k = int(gain.argmax())
    if gain[k] < 0:
        return None
    a, b = k, int(last[k])
    kept = np.flatnonzero(same[a:b])
    end = min(b, max(a + int(kept[-1]) + 1, a + int(kept[0]) + least))
    return min(a + int(kept[0]), end - least), end


def _hits(part: Part, h: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(text, item, diagonal, place in h, span)`` of the seeds that both have, some ``_HITS`` at a time."""
    for mask, bits, known, at in part.index:
        s = seeds(h, mask)
        near = np.flatnonzero(bits[s >> np.uint64(64 - _FILTER_BITS)])
        lo, hi = (np.searchsorted(known, s[near], side) for side in ("left", "right"))
        text = np.searchsorted(starts, near, "right") - 1
        real = (hi > lo) & (near + len(mask) <= starts[text + 1])
        near, lo, n, text = near[real], lo[real], (hi - lo)[real], text[real]
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + _HITS, "right")))
            m, done = n[i:j], ends[i:j] - n[i:j]
            place = at[np.repeat(lo[i:j] - done, m) + np.arange(done[0], done[0] + m.sum())]
            pos = np.repeat(near[i:j], m)
            yield np.repeat(text[i:j], m), np.searchsorted(part.start, place, "right") - 1, pos - place, pos, len(mask)
            i = j


def overlaps(part: Part, h: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, first word, words, equal words)`` of the best overlap of each text with each item.

    ``h`` holds the words of several texts one behind the other, ``starts`` where each begins, and the end.
    """
    reach = 2 * MIN_WORDS - 1  # words of the longest run that no part of stands for
    hits: set[tuple[int, int, int]] = set()
    for text, item, diagonal, pos, span in _hits(part, h, starts):
        i0, i1 = part.start[item], part.start[item + 1]
        a = np.maximum(np.maximum(starts[text], i0 + diagonal), pos + span - reach)
        n = np.minimum(np.minimum(starts[text + 1], i1 + diagonal), pos + reach) - a
        first = np.cumsum(n) - n
        k = np.repeat(a - first, n) + np.arange(n.sum())
        equal = np.add.reduceat(h[k] == part.words[k - np.repeat(diagonal, n)], first, dtype=np.int64)
        full = equal >= MIN_SHARE * np.minimum(MIN_WORDS, i1 - i0)
        hits.update(zip(text[full].tolist(), item[full].tolist(), diagonal[full].tolist()))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, item, diagonal in sorted(hits):
        i0, i1 = int(part.start[item]), int(part.start[item + 1])
        a0, a1 = max(int(starts[t]), i0 + diagonal), min(int(starts[t + 1]), i1 + diagonal)
        same = h[a0:a1] == part.words[a0 - diagonal:a1 - diagonal]
        if run := _best_run(same, min(MIN_WORDS, i1 - i0)):
            a, b = run
            best[t, item] = max(best.get((t, item), (0, 0, 0)), (int(same[a:b].sum()), b - a, a0 + a - int(starts[t])))
    return [(t, item, first, n, equal) for (t, item), (equal, n, first) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, start long, n_words long, n_equal long"
_GROUP_WORDS = 500_000


def _search(part: Part):
    def flush(ids, hs):
        starts = np.cumsum([0] + [len(h) for h in hs])
        rows = [(ids[t], int(part.item_ids[i]), a, n, e) for t, i, a, n, e in overlaps(part, np.concatenate(hs), starts)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                                          ["doc_id", "item_id", "start", "n_words", "n_equal"])

    def work(it):
        words = WordHashes()
        ids, hs, n = [], [], 0
        for b, texts in batches(it):
            for d, t in zip(b.column("doc_id").to_pylist(), texts):
                if d is None:
                    continue
                ids.append(d)
                hs.append(words(t.lower().split()))
                n += len(hs[-1])
                if n >= _GROUP_WORDS:
                    yield flush(ids, hs)
                    ids, hs, n = [], [], 0
        if ids:
            yield flush(ids, hs)
    return work


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per text and item that overlap: the best run's first word, its words and how many are equal."""
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (6 * PART_WORDS)))
    texts = id_text(docs, id_col, text_col)
    out = None
    for k in range(parts):
        # one part: at most about PART_WORDS words
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        part = index_items(sorted((r["item_id"], bytes(r["text"])) for r in rows if r["item_id"] is not None and r["text"]))
        found = texts.mapInArrow(_search(part), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_words", "start")).alias("b")) \
        .select("doc_id", "item_id", "b.start", "b.n_words", "b.n_equal")
