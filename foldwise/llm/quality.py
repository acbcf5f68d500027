"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is its words, folded to lower case, each cut into letter/digit runs and punctuation runs, with a marker before
a word in capitals; features are the hashed 1- and 2-grams of that sequence (a gram that repeats one piece is the
same feature whichever piece it is), valued by their share of all grams. A score is a sparse dot product.

The model is fitted on a bounded sample of labelled rows (``Params.sample_rows``); every row is scored, whole.

Defined cases: a null or empty text scores by the bias alone; without any labelled rows every score is 0.5; a null id
is scored like any other; repeated rows give a row each; repeated labels of an id count once (the largest); only the
id, text and label columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, batches, hash_fraction, id_text, mix
from .ftrl import Ftrl, sigmoid

_PIECES = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+")
_SAME = np.uint64(0x5DEECE66D)


@dataclass(frozen=True)
class Params:
    bits: int = 18
    scale: float = 20.0
    sample_rows: int = 8000   # bound on the labelled rows that the model is fitted on
    passes: int = 4
    alpha: float = 0.3
    l1: float = 0.05
    l2: float = 0.01


class WordGrams:
    """Text bytes -> hashed gram indices (with repeats), with a bounded cache of words."""

    def __init__(self, bits: int, cache_words: int = 400_000) -> None:
        self.shift = np.uint64(64 - bits)
        self.cache: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def _pieces(self, word: bytes) -> bytes:
        out = []
        low = word.lower()
        if len(word) > 1 and word.isupper():
            out.append(b"\x00up")
        out += _PIECES.findall(low)
        return b"".join(xxhash.xxh3_64_intdigest(p).to_bytes(8, "little") for p in out)

    def __call__(self, text: bytes) -> np.ndarray:
        words, c = text.split(), self.cache
        try:
            raw = b"".join(map(c.__getitem__, words))
        except KeyError:
            if len(c) > self.cache_words:
                c.clear()
            for w in words:
                if w not in c:
                    c[w] = self._pieces(w)
            raw = b"".join(map(c.__getitem__, words))
        h = np.frombuffer(raw, np.uint64)
        if len(h) < 2:
            return (h * _GOLD) >> self.shift
        two = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1] * _GOLD + h[1:]))
        return np.concatenate([h * _GOLD, two * _GOLD]) >> self.shift


def _row(idx: np.ndarray, scale: float):
    if len(idx) == 0:
        return np.empty(0, np.int64), np.empty(0)
    at, n = np.unique(idx, return_counts=True)
    return at.astype(np.int64), n * (scale / len(idx))


def sample(docs: DataFrame, labels: DataFrame, params: Params, id_col: str, text_col: str, label_col: str):
    """The bounded sample as sparse rows and labels, in order of id: a repeatable draw of labelled ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    # the draw keeps about 9 in 10 of the bound, the limit makes the bound hold whatever the draw
    drawn = known.where(hash_fraction(F.col("doc_id"), 11) < F.lit(0.9 * params.sample_rows / max(n, 1))).limit(params.sample_rows)

    def grams(it):
        g = WordGrams(params.bits)
        for b, texts in batches(it):
            rows = [_row(g(t), params.scale) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["doc_id", "label", "at", "val"])

    # broadcast: at most `sample_rows` rows of two numbers
    got = id_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label") \
        .mapInArrow(grams, "doc_id long, label int, at array<long>, val array<double>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    at, val, lab = (got.column(c).combine_chunks() if got.num_rows else [] for c in ("at", "val", "label"))
    rows = [(np.asarray(at[int(i)].values), np.asarray(val[int(i)].values)) for i in order]
    return rows, [int(lab[int(i)].as_py()) for i in order]


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The weights (the last one is the bias). ``labels`` holds only rows that may be learned from."""
    rows, y = sample(docs, labels, params, id_col, text_col, label_col)
    model = Ftrl(1 << params.bits, alpha=params.alpha, l1=params.l1, l2=params.l2)
    return model.fit(rows, y, params.passes).weights()[0]


def score(docs: DataFrame, weights: np.ndarray, params: Params = Params(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    w = np.asarray(weights, np.float32)

    def work(it):
        g = WordGrams(params.bits)
        for b, texts in batches(it):
            raw = []
            for t in texts:
                idx = g(t)
                raw.append(float(w[-1]) + (params.scale * float(w[idx].mean(dtype=np.float64)) if len(idx) else 0.0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(np.array(raw)))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double")
