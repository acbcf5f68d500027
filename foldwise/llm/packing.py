"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut at fixed places: whole windows first, then what is left in pieces of at most ``piece`` ids.
Pieces are dealt to shards of bounded size by hash. In a shard, whole-window pieces stand alone; the others are
spread over ``ceil(sum / window)`` windows by differencing: partial partitions start with one piece each, and the two
with the largest imbalance are merged again and again, the fullest slot of one with the emptiest of the other, which
leaves near-equal windows. While the fullest one exceeds the capacity, the window count rises.

Defined cases: a null text is empty and packs as its end id alone; repeated rows are packed like any others; a null
id is a value like any other; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tok
from .common import batches, id_text

WINDOW = 2048
PIECE = 512
SHARD_PIECES = 512  # mean pieces of a shard, which bounds a task's group at every input size

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """A window in ``0..k-1`` for each length, by multiway differencing."""
    n = len(lengths)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    heap, merged = [], {}
    for i, x in enumerate(lengths.tolist()):
        heap.append((-x, i, None))
    heapq.heapify(heap)

    def sums(node, x):  # slots by falling sum, less the smallest
        if x is None:
            x = np.zeros(k, np.int64)
            x[0] = lengths[node]
        return x

    nxt = n
    while len(heap) > 1:
        _, a, xa = heapq.heappop(heap)
        _, b, xb = heapq.heappop(heap)
        both = sums(a, xa) + sums(b, xb)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merged[nxt] = (a, b, order)
        heapq.heappush(heap, (-int(both[0] - both[-1]), nxt, both - both[-1]))
        nxt += 1
    out = np.empty(n, np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, label = todo.pop()
        if node < n:
            out[node] = label[0]
            continue
        a, b, order = merged.pop(node)
        by_slot = np.empty(k, np.int64)
        by_slot[order] = label
        todo += [(a, by_slot), (b, by_slot[::-1])]
    return out


def assign(lengths: np.ndarray, window: int) -> np.ndarray:
    """Windows for pieces of at most ``window`` ids; none holds more than ``window``."""
    out = np.empty(len(lengths), np.int64)
    whole = lengths >= window
    out[whole] = np.arange(int(whole.sum()))
    rest = np.flatnonzero(~whole)
    if len(rest):
        k = -(-int(lengths[rest].sum()) // window)
        while True:
            to = difference(lengths[rest], k)
            if np.bincount(to, lengths[rest], k).max() <= window:
                break
            k += max(1, k // 64)
        out[rest] = np.unique(to, return_inverse=True)[1].ravel() + int(whole.sum())
    return out


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document of ``n`` ids."""
    out = [(s, window) for s in range(0, n - window + 1, window)]
    done = len(out) * window
    return out + [(s, min(piece, n - s)) for s in range(done, n, piece)]


def cut_documents(df: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, piece: int = PIECE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens)``."""
    end = np.array([end_id], "<u4").tobytes()

    def work(it):
        p = tok.pieces(path)
        for b, texts in batches(it):
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), p.ids_of(list(map(tok.text_of, texts)))):
                ids += end
                n = len(ids) // 4
                rows += [(d, s, m, zlib.crc32(ids[4 * s:4 * (s + m)]), n) for s, m in cuts(n, window, piece)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(df, id_col, text_col).mapInArrow(work, SCHEMA)


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``cut_documents``; sequence ids are unique, not dense."""
    pieces = materialize(pieces)
    shards = max(1, -(-pieces.count() // shard_pieces))
    # the place in the written table is part of the hash, so rows that repeat are dealt to different shards
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(shards)))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        to = assign(lengths, window)
        order = np.argsort(to, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(to[order], to[order])
        offset = np.empty(len(to), np.int64)
        offset[order] = before - before[first]
        shard = table.column("shard").to_numpy()
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(shard * (1 << 24) + to)) \
            .append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(work, SCHEMA + ", sequence_id long, offset long")
