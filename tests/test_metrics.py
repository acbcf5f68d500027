"""AUC goldens, properties, and brute-force comparison; plan check for single-partition exchanges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics as ME


def brute_auc(ps, ys):
    pos = [p for p, y in zip(ps, ys) if y == 1]
    neg = [p for p, y in zip(ps, ys) if y == 0]
    if not pos or not neg:
        return 0.5
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def _auc(spark, ps, ys, n_buckets=None):
    df = spark.createDataFrame(list(zip(ps, ys)), "p double, y int")
    return ME.auc(df, n_buckets=n_buckets).first()["auc"]


def test_edges(spark):
    assert _auc(spark, [0.1, 0.2, 0.3], [1, 1, 1]) == 0.5  # one class only
    assert _auc(spark, [0.5] * 4, [0, 1, 0, 1]) == 0.5  # all tied
    assert _auc(spark, [0.1, 0.9], [0, 1]) == 1.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force_with_ties(spark, seed):
    rnd = random.Random(seed)
    ps = [round(rnd.random(), 1) for _ in range(300)]  # many ties
    ys = [int(rnd.random() < 0.3 + 0.4 * p) for p in ps]
    assert _auc(spark, ps, ys, n_buckets=7) == pytest.approx(brute_auc(ps, ys), abs=1e-12)


def test_complement_property(spark):
    rnd = random.Random(7)
    ps = [rnd.random() for _ in range(200)]
    ys = [int(rnd.random() < p) for p in ps]
    a = _auc(spark, ps, ys)
    b = _auc(spark, [1 - p for p in ps], ys)
    assert a == pytest.approx(1 - b, abs=1e-12)


def test_grouped_auc_no_single_partition(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 5).alias("g"),
                                  F.rand(3).alias("p"), (F.rand(4) > 0.5).cast("int").alias("y"))
    out = ME.auc(df, by=["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # only the bounded per-bucket table may be windowed per group; rows never meet in one task
    assert out.count() == 5
    assert "SinglePartition" not in plan


def test_roc_and_thresholds(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    roc = {r["threshold"]: (r["tpr"], r["fpr"]) for r in ME.roc_curve(df).collect()}
    assert roc[0.8] == (0.5, 0.0) and roc[0.35] == (1.0, 0.5) and roc[0.1] == (1.0, 1.0)
    you = ME.youden_threshold(ME.roc_curve(df)).first()
    assert you["youden_threshold"] == 0.8  # ties: the highest threshold
    prev = ME.prevalence_threshold(df).first()["prevalence_threshold"]
    assert prev == pytest.approx(0.375)  # numpy.quantile([.1,.35,.4,.8], 0.5)


def test_exact_quantiles(spark):
    import numpy as np

    vals = [float(v) for v in np.random.default_rng(0).integers(0, 50, 501)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    row = ME.exact_quantiles(df, "v", qs).first()
    for i, q in enumerate(qs):
        assert row[f"q{i}"] == pytest.approx(float(np.quantile(vals, q)))


def test_exact_quantiles_hot_value_and_groups(spark):
    import numpy as np

    vals = [0.0] * 400 + [float(v) for v in range(1, 101)]  # one value holds most rows
    rows = [("a", v) for v in vals] + [("b", float(v)) for v in range(7)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.5, 0.8, 0.95, 1.0]
    got = {r["g"]: r for r in ME.exact_quantiles(df, "v", qs, by=["g"]).collect()}
    for g, xs in (("a", vals), ("b", [float(v) for v in range(7)])):
        for i, q in enumerate(qs):
            assert got[g][f"q{i}"] == pytest.approx(float(np.quantile(xs, q)))
