"""SV-1: every document leaves, in both spaces at full size, with the projection that a dense SVD gives."""

import numpy as np

from pyspark.sql import functions as F

from foldwise.operators import models as MO
from foldwise.plans import model_queries as MQ


def test_every_document_has_a_row(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = MQ.svd_tfidf(spark, sf_small).toPandas()
    assert sorted(out["id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert list(out.columns) == ["id", *[f"wsvd_{i}" for i in range(384)], *[f"csvd_{i}" for i in range(192)]]
    assert not out.isna().any().any()
    x = out.filter(like="wsvd_").to_numpy()
    assert (np.abs(x).sum(axis=1) > 0).mean() > 0.9 and (np.linalg.norm(x, axis=1) <= 1 + 1e-4).all()


def test_against_a_dense_svd(spark):
    rng = np.random.default_rng(6)
    a = rng.random((60, 12)) * (rng.random((60, 12)) < 0.4)
    a[7] = 0
    rows = [(i, np.flatnonzero(r).tolist() or None, r[r > 0].tolist() or None) for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "id long, i array<int>, v array<double>")
    V = MO.svd_fit(df.where("id < 40"), "i", "v", 12, 5)
    want = np.linalg.svd(a[:40], full_matrices=False)[2][:5].T
    want *= np.sign(want[np.abs(want).argmax(axis=0), range(5)])
    assert np.allclose(V, want, atol=1e-9)
    got = MO.svd_project(df, [("s", "i", "v", V)]).orderBy("id").toPandas()
    assert np.allclose(got[[f"s_{j}" for j in range(5)]].to_numpy(), a @ want, atol=1e-9)
    low = MO.svd_fit(df.where("id < 3"), "i", "v", 12, 5)
    assert (low[:, 3:] == 0).all() and (np.abs(low[:, :3]).sum(axis=0) > 0).all()


def test_blocks_give_the_dense_svd_of_every_row(spark):
    import random

    from foldwise.operators import lowrank as LR
    from foldwise.operators import termrows as TR

    rng = random.Random(3)
    words = [f"w{i}x" for i in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for k in range(300)] + [(None, "w1x w2x"), (7, "w3x"), (900, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    text = F.coalesce(F.col("t"), F.lit(""))
    fit = F.col("id") % 3 != 0
    vocabs = [TR.fit(df.where(fit), text, a, min_df=2, max_features=m) for a, m in
              ((TR.Analyzer("words", 1, 2), 60), (TR.Analyzer("chars", 2, 3), 50))]
    blocks = TR.hit_blocks(df, text, vocabs, "id", fit)
    vectors = LR.svd_fit(blocks, vocabs, [6, 70])
    got = LR.svd_project(blocks, vocabs, vectors, ["a", "b"]).collect()
    assert len(got) == len(rows)
    for v, V, name in zip(vocabs, vectors, "ab"):
        weights = TR.weigh(df, text, v, ["id", "t"]).collect()
        place = {t: i for i, t in enumerate(v.terms)}
        x = np.zeros((len(weights), len(place)))
        for i, r in enumerate(weights):
            for t, w in zip(r["terms"], r["tfidf"]):
                x[i, place[t]] = w
        train = np.array([r["id"] is not None and r["id"] % 3 != 0 for r in weights])
        _, sv, vt = np.linalg.svd(x[train], full_matrices=False)
        k = V.shape[1]
        assert np.allclose((x @ V)[train].T @ (x @ V)[train], np.diag(np.pad(sv ** 2, (0, 99))[:k]), atol=1e-4)
        if k <= len(sv):
            assert np.allclose(np.abs(V.T), np.abs(vt[:k]), atol=1e-3)
        want = sorted((-1 if r["id"] is None else r["id"], tuple(np.round(y, 6))) for r, y in zip(weights, x @ V))
        have = sorted((-1 if r["id"] is None else r["id"], tuple(np.round([r[f"{name}_{j}"] for j in range(k)], 6))) for r in got)
        assert np.allclose([w[1] for w in want], [h[1] for h in have], atol=1e-5)
