"""ML-3 / ML-4: boosted trees have the reference's rounds and stop as the reference does."""

from pyspark.sql import functions as F

from foldwise.operators import models as MO
from foldwise.plans import model_queries as MQ


def test_boosting_has_all_rounds(spark, sf_small, monkeypatch):
    made = []

    def cv_oof(tr, te, cols, label, fold, make, early_stopping, **_):
        made.append((make(tr).getMaxIter(), early_stopping))
        return tr.select("id")

    monkeypatch.setattr(MQ.MO, "cv_oof", cv_oof)
    MQ.cv_gbt_tabular(spark, sf_small)
    assert made == [(3000, 200)]


def test_best_round_waits_for_a_later_one():
    assert MO.best_round([5, 4, 6, 6, 3, 7, 7, 7], 3) == (5, True)
    assert MO.best_round([5, 4, 6, 6, 6, 3], 3) == (2, True)  # the rounds after it are not reached
    assert MO.best_round([5, 4, 6, 6, 3, 7, 7], 3) == (5, False)
    assert MO.best_round([5.0], 3) == (1, False)
    assert MO.best_round([5, 4, 4, 4], 2) == (2, True)  # an equal loss is no gain


def test_boosting_goes_on_over_worse_rounds(spark):
    rows = spark.range(300).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")) \
        .withColumn("label", F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) < F.col("x"), 1.0).otherwise(0.0))
    rows = MO.assemble(rows, ["x"]).cache()
    fit, valid = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    estimator = MO.gbt(7, max_iter=15, step=0.5)
    losses = estimator.fit(fit).evaluateEachIteration(valid)
    best = losses.index(min(losses)) + 1
    model = MO.fit_stopped(estimator, fit, valid, 15)  # never stops: the least of all
    assert model.getNumTrees == best
    least = MO.fit_stopped(estimator, fit, valid, 3)
    assert least.getNumTrees == MO.best_round(losses, 3)[0]
    assert abs(least.evaluateEachIteration(valid)[-1] - losses[least.getNumTrees - 1]) < 1e-9


def test_folds_side_by_side_score_as_one_by_one(spark):
    rows = spark.range(120).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)).cast("double")) \
        .withColumn("y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) < F.col("x")).cast("int")).withColumn("fold", (F.col("id") % 3).cast("int"))
    run = lambda parallel: {(r["id"], r["fold"], r["role"]): r["p"] for r in MO.cv_oof(
        rows, rows.where("id < 9"), ["x"], "y", "fold", lambda d: MO.gbt(3, max_iter=4, weight_col="w"), early_stopping=1, balance_col="w",
        parallel=parallel).collect()}
    one, three = run(1), run(3)
    assert len(one) == 120 + 3 * 9 and one.keys() == three.keys()
    assert max(abs(one[k] - three[k]) for k in one) < 1e-9
