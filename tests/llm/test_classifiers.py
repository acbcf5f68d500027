"""Quality classifier and language identification: held-out accuracy, and the learner against plain gradients."""

import zlib

import numpy as np

from foldwise.llm import ftrl, langid, quality
from foldwise.llm import queries as Q

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(label[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    y, s, p = map(np.array, zip(*held))
    assert auc(y, s) > 0.95 and (p[y == 1] == 1).mean() > 0.97


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op6_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held])
    assert right > 0.96
    # calibrated: the mean probability is near the share that is right
    assert abs(np.mean([r["score"] for r in held]) - right) < 0.05


def test_scores_ignore_label_language_source_and_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    w = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    a = quality.score(docs, w).collect()
    changed = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'zz' as lang", "'s' as source")
    assert [r["score"] for r in a] == [r["score"] for r in quality.score(changed, w).collect()]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "...!", None), (None, "hello there", "en"), (4, "hallo welt", "de"),
                                  (4, "hallo welt", "de"), (5, "x" * 200_000, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    empty = labels.limit(0)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, empty)).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0

    pred = langid.predict(docs, langid.fit(docs)).collect()
    by = [(r["doc_id"], r["lang_pred"]) for r in pred]
    assert (1, "und") in by and (2, "und") in by and (3, "und") in by and len(by) == 7
    assert all(p in ("en", "de") for d, p in by if d in (4, 5))
    none = langid.predict(docs, langid.fit(docs.where("lang is null"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_ftrl_is_proximal_descent():
    """Without penalties the weights equal per-coordinate adaptive gradient descent; with l1 small weights are zero."""
    rng = np.random.default_rng(0)
    rows = [(np.arange(5), rng.normal(size=5)) for _ in range(200)]
    labels = [int(r[1][0] + 0.1 * rng.normal() > 0) for r in rows]
    m = ftrl.Ftrl(5, alpha=0.5, beta=1.0)
    w, n = np.zeros(6), np.zeros(6)
    for (idx, val), y in zip(rows, labels):
        m.update((idx, val), y)
        x = np.append(val, 1.0)
        g = (ftrl.sigmoid(w @ x) - y) * x
        # FTRL-proximal without penalties is w -= g * eta_t with its own step sizes
        new = n + g * g
        z_step = g - (np.sqrt(new) - np.sqrt(n)) / 0.5 * w
        w = (w * (1.0 + np.sqrt(n)) / 0.5 - z_step) / ((1.0 + np.sqrt(new)) / 0.5)
        n = new
    assert np.allclose(m.weights()[0], w)
    sparse = ftrl.Ftrl(5, alpha=0.5, l1=8.0).fit(rows, labels, 1).weights()[0]
    assert (sparse[1:5] == 0).sum() >= 2 and sparse[0] != 0


def test_temperature_restores_calibration():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(3, 4000))
    p = ftrl.softmax(logits)
    labels = np.array([rng.choice(3, p=p[:, i]) for i in range(4000)])
    assert abs(ftrl.temperature(logits * 4, labels) - 4) < 0.5
