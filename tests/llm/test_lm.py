"""Interpolated language model: counts and base scores against plain counting, weights against EM by hand."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import lm, packed
from foldwise.llm import queries as Q


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows):
    """rows: (doc_id, text, held) -> {doc_id: (n_tokens, n_known, N, base)} and the counts."""
    uni, bi = Counter(), Counter()
    for _, text, held in rows:
        if not held:
            t = tokens(text)
            uni.update(t)
            bi.update(zip([None] + t[:-1], t))
    n, v = sum(uni.values()), len(uni)
    out = {}
    for d, text, _ in rows:
        t = tokens(text)
        out[d] = (len(t), sum(uni[x] > 0 for x in t), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t))
    return out, uni, bi


def brute_scores(rows, uni, bi, w):
    n, v = sum(uni.values()), len(uni)
    out = {}
    for d, text, _ in rows:
        t, total = tokens(text), 0.0
        for u, x in zip([None] + t[:-1], t):
            c = uni[u]
            l2, l1, l0 = w[min(int(math.log2(max(c, 1))), lm.BUCKETS - 1)]
            p = l1 * uni[x] / n + l0 / (v + 1) + (l2 * bi[u, x] / c if c else 0.0)
            total += math.log10(p if c else p / (1 - l2))
        out[d] = total
    return out


def test_query_counts(spark, sf_small, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_WORDS", 5000)  # several ranges
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs]
    want, uni, bi = brute(rows)
    got = {r["doc_id"]: r for r in Q.op3_lm_score(spark, sf_small).collect()}
    assert set(got) == set(want)
    for d, (k, known, n, base) in want.items():
        g = got[d]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (k, known, n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert g["score"] < 0


def test_scores_equal_formula(spark):
    rows = [(1, "a b a b c", False), (2, "a b d", False), (3, "b a x a b", True), (4, None, False), (5, "", True)]
    df = spark.createDataFrame([(d, t, h, 1) for d, t, h in rows], "doc_id long, text string, held boolean, uni int")
    counted, n, v = lm.count(df, F.col("held"))
    stats = lm.held_out_statistics(counted, n).collect()
    w = lm.mixture(np.array([r["cell"] for r in stats]), np.array([r["n"] for r in stats], float), v)
    assert np.allclose(w.sum(axis=1), 1)
    _, uni, bi = brute(rows)
    want = brute_scores(rows, uni, bi, w)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("held")).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one():
    w = lm.mixture(np.array([(1 << 40) | (3 << 20) | 5]), np.array([10.0]), 4)
    assert np.allclose(w.sum(axis=1), 1) and (w > 0).all()


def test_edges(spark):
    df = spark.createDataFrame([(None, "a", False), (1, "a a", False), (1, "a a", False), (2, "z " * 20000, True)],
                               "doc_id long, text string, held boolean")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(df, F.col("held")).collect())
    assert got == [(2, 2, 8), (3, 3, 8), (3, 3, 8), (20001, 1, 8)]
    assert lm.score(df.limit(0), F.col("held")).count() == 0
    held = lm.score(df.where("held"), F.col("held")).first()
    assert held["train_tokens"] == 0 and held["score"] == 0.0


def test_packed_arrays_round_trip():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (packed.unpack_sorted(packed.pack_sorted(x)) == x).all()
    assert len(packed.unpack(packed.pack(x[:0]), np.uint64)) == 0
