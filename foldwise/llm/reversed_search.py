"""Ranked lexical search, reversed: the items are indexed and the documents are streamed through that index.

1. The distinct terms of each item are posted under the term. Postings are dealt to blocks of items whose size is counted
   before they are read to the driver and broadcast, so the index in memory is bounded at any number of items.
2. For each block one pass counts in how many documents its terms stand (and once the documents and terms of all), and one
   pass sends each document's term counts through the postings: a task adds up the scores of a batch of documents for all
   items and keeps a bounded heap per item, into which only rows above the heap's least enter.
3. The heaps are merged in two steps, first within groups of tasks, then by item.

All arithmetic is on 64-bit integers except the logarithm of a weight. Scores are whole: a document is dropped only when
``k`` better ones are known for the item.

Defined cases: a null or empty text has no terms and is not counted as a document; rows of one item id are one item with the
terms of all; repeated documents are ranked each; null document ids come last among equals, a null item id is an item like
any other; no item or no document gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import batches, id_text

BLOCK_POSTINGS = 1_000_000  # postings of a broadcast index
CELLS = 500_000  # scores (documents x items) a task holds at a time
MERGE_GROUPS = 64

# separators are blanks, letters A-Z are folded; all other bytes (digits, a-z, UTF-8 sequences) belong to terms
_FOLD = bytes(32 if (b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80) else b + 32 if 0x41 <= b <= 0x5A else b
              for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, with repeats."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(item_id, term)``."""
    def work(it):
        for b, texts in batches(it):
            rows = [(i, t) for i, x in zip(b.column("doc_id").to_pylist(), texts) for t in set(terms(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["item_id", "term"])

    return id_text(items, id_col, text_col).mapInArrow(work, "item_id long, term binary").distinct()


def _blocks(postings: DataFrame, most: int) -> list[DataFrame]:
    """The postings by blocks of items, each of at most ``most`` postings unless a single item has more."""
    total = postings.count()
    n = max(1, -(-total // most))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        largest = postings.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.countDistinct("item_id").alias("i")) \
            .where(f"c > {most} and i > 1").limit(1).count()
        if not largest:
            return [postings.where(block == b) for b in range(n)] if total else []
        n = n * 2 + 1


def _frequencies(docs: DataFrame, vocabulary) -> tuple[dict[bytes, int], int, int]:
    """``(documents by term, N, L)`` for a broadcast vocabulary."""
    def work(it):
        own, df, n, length = vocabulary.value, Counter(), 0, 0
        for _, texts in batches(it):
            for x in texts:
                all_ = terms(x)
                if all_:
                    n += 1
                    length += len(all_)
                    df.update(own.intersection(all_))
        yield pa.RecordBatch.from_arrays([pa.array([None, None, *df], pa.binary()), pa.array([0, 1, *[2] * len(df)], pa.int32()),
                                          pa.array([n, length, *df.values()], pa.int64())], ["term", "kind", "n"])

    rows = docs.mapInArrow(work, "term binary, kind int, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()
    by_kind = {r["kind"]: r["n"] for r in rows if r["kind"] < 2}
    return {bytes(r["term"]): r["n"] for r in rows if r["kind"] == 2}, by_kind.get(0, 0), by_kind.get(1, 0)


class Index:
    """Postings of a block of items: for each term its weight and its items, as arrays."""

    def __init__(self, postings: list[tuple[int | None, bytes]], df: dict[bytes, int], n: int, length: int) -> None:
        self.items = sorted({i for i, _ in postings}, key=lambda i: (i is None, i))
        place = {i: p for p, i in enumerate(self.items)}
        by_term: dict[bytes, list[int]] = {}
        for i, t in postings:
            if t in df:  # no document holds the others
                by_term.setdefault(t, []).append(place[i])
        self.term = {t: p for p, t in enumerate(by_term)}
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in by_term], np.int64)
        self.count = np.array([len(p) for p in by_term.values()], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.posting = np.array([p for ps in by_term.values() for p in ps], np.int64)
        self.n, self.length = n, length

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """``documents x items``; the terms of one text are held at a time."""
        get, size = self.term.get, len(self.items)
        at, found, m = [], [], np.empty(len(texts), np.int64)
        for d, x in enumerate(texts):
            all_ = terms(x)
            own = [p for p in map(get, all_) if p is not None]
            found += own
            at += [d] * len(own)
            m[d] = 10 + 90 * len(all_) * self.n // self.length
        out = np.zeros(len(texts) * size, np.int64)
        if found:
            key, tf = np.unique(np.array(at, np.int64) * len(self.term) + np.array(found, np.int64), return_counts=True)
            doc, term = np.divmod(key, len(self.term))
            part = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            n = self.count[term]
            ends = np.cumsum(n)
            items = self.posting[np.arange(ends[-1]) + np.repeat(self.first[term] - (ends - n), n)]
            np.add.at(out, np.repeat(doc * size, n) + items, np.repeat(part, n))
        return out.reshape(len(texts), size)


class Heaps:
    """The best ``k`` documents of each item so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.heaps, self.least = k, [[] for _ in range(n)], np.ones(n, np.int64)

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        least = self.least
        if len(ids) > self.k:  # what k others of the batch beat cannot stay
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        for d, i in zip(*[x.tolist() for x in np.nonzero(scores >= least)]):
            heap, doc = self.heaps[i], ids[d]
            row = (int(scores[d, i]), -doc if doc is not None else -(1 << 64))  # the worst of equals has the largest id
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _heaps(docs: DataFrame, shared, k: int) -> DataFrame:
    """``(item_id, doc_id, score)``: the heaps of every task."""
    def work(it):
        index = shared.value
        heaps = Heaps(len(index.items), k)
        step = max(1, CELLS // max(1, len(index.items)))
        for b, texts in batches(it):
            ids = b.column("doc_id").to_pylist()
            for lo in range(0, len(texts), step):
                heaps.add(index.scores(texts[lo:lo + step]), ids[lo:lo + step])
        rows = [(index.items[i], None if d == -(1 << 64) else -d, s) for i, h in enumerate(heaps.heaps) for s, d in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(work, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_postings: int = BLOCK_POSTINGS, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    postings = materialize(item_terms(items, item_col, item_text))
    parts = []
    for block in _blocks(postings, block_postings):
        own = [(r["item_id"], bytes(r["term"])) for r in block.collect()]  # at most `block_postings`
        vocabulary = spark.sparkContext.broadcast(frozenset(t for _, t in own))
        df, n, length = _frequencies(texts, vocabulary)
        vocabulary.destroy()
        if not df:
            continue
        shared = spark.sparkContext.broadcast(Index(own, df, n, length))
        # written, so that neither the heaps nor the block's index are needed again
        parts.append(materialize(_best(_heaps(texts, shared, k).withColumn("part", F.spark_partition_id() % MERGE_GROUPS), k, "part")))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _best(out, k).select("item_id", "rank", "doc_id", "score")


def _best(rows: DataFrame, k: int, *within: str) -> DataFrame:
    w = Window.partitionBy("item_id", *within).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
