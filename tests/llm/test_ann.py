"""Permutation index: exact scores, order and ties; recall against brute force."""

import math

import numpy as np

from foldwise.llm import ann
from foldwise.llm import queries as Q
from pyspark.sql import functions as F


def brute(rows, k=20, every=20):
    rows = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = (x * rows[i]).sum(axis=1)
        keep = ids != i
        o = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(i)] = list(zip(ids[keep][o].tolist(), s[keep][o].tolist()))
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r["query_id"], [])
        got.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got)
    return out


def recall(got, want):
    hit = sum(sum(s >= w[-1][1] - 1e-12 for _, s in got[q]) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), found(Q.op4_permutation_index(spark, sf))
    vec = {i: np.array(v, float) for i, v in rows}
    assert set(got) == set(want)
    for q, g in got.items():
        assert len(g) == 20 and q not in [i for i, _ in g]
        assert all(abs(s - float(vec[q] @ vec[i])) < 1e-12 for i, s in g)
        assert g == sorted(g, key=lambda x: (-x[1], x[0]))
    assert recall(got, want) >= 0.9


def test_copies_norms_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(i, (base if i % 3 == 0 else rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(300, None), (320, [0.0] * 8), (340, [1.0, None] + [0.0] * 6), (360, [float("nan")] + [1.0] * 7),
             (380, [float("inf")] + [1.0] * 7), (400, [1.0, 2.0]), (None, [1.0] * 8), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got, want = found(ann.search(df, F.col("vec_id") % 20 == 0)), brute([r for r in rows[:300]])
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q in (0, 60):  # copies of the query come first, ties by id
        assert [i for i, _ in got[q]][:5] == [i for i, _ in want[q]][:5]
    few = found(ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0))
    assert sorted(i for i, _ in few[0]) == [1, 2, 3, 4]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
