"""Fold properties and leave-fold-out encoding properties."""

import pytest
from pyspark.sql import functions as F

from foldwise.operators import encode as E
from foldwise.operators import folds as FO


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 1003).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"),
                                       (F.col("id") % 13).cast("string").alias("g"))


def test_kfold_each_row_once_and_balanced(rows):
    f = FO.kfold(rows, 5, seed=1)
    assert f.count() == 1003 and f.select("id").distinct().count() == 1003
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stratified_balance_per_class(rows):
    f = FO.stratified_kfold(rows, 5, "y", seed=1)
    per = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in per if r["y"] == y]
        assert max(c) - min(c) <= 1
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_folds_are_deterministic(rows):
    a = {r["id"]: r["fold"] for r in FO.stratified_kfold(rows, 5, "y", seed=3).collect()}
    b = {r["id"]: r["fold"] for r in FO.stratified_kfold(rows.repartition(7), 5, "y", seed=3).collect()}
    assert a == b


def test_group_folds_never_split_a_group(rows):
    f = FO.group_kfold(rows, 5, "g", "y", seed=1)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_repeated_folds(rows):
    f = FO.repeated_stratified_kfold(rows, 5, "y", [1, 2, 3])
    assert f.count() == 3 * 1003
    assert f.groupBy("seed", "id").count().where("count > 1").count() == 0


def test_te_own_fold_labels_do_not_leak(spark, rows):
    f = FO.kfold(rows, 5, seed=1).withColumn("g2", (F.col("id") % 3).cast("string"))
    a = {r["id"]: r["TE_g2_mean"] for r in E.target_encode_oof(f, ["g2"], "y", "fold").collect()}
    flipped = f.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    b = {r["id"]: r["TE_g2_mean"] for r in E.target_encode_oof(flipped, ["g2"], "y", "fold").collect()}
    fold0 = {r["id"] for r in f.where("fold = 0").collect()}
    assert all(a[i] == pytest.approx(b[i]) for i in fold0)


def test_te_unseen_key_gets_fold_mean(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (2, 0, 0, "a"), (3, 1, 1, "a"), (4, 1, 0, "b")],
                               "id long, fold int, y int, k string")
    out = {r["id"]: r["TE_k_mean"] for r in E.target_encode_oof(df, ["k"], "y", "fold").collect()}
    # id 4: key 'b' never appears outside fold 1 -> fold 1's train-part mean (ids 1, 2) = 0.5
    assert out[4] == pytest.approx(0.5)


def test_te_fit_transform_default(spark):
    tr = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1)], "id long, k string, y int")
    te = spark.createDataFrame([(9, "a"), (10, "zz")], "id long, k string")
    m, g = E.te_fit(tr, ["k"], "y")
    out = {r["id"]: r["TE_k_mean"] for r in E.te_transform(te, m, g, ["k"]).collect()}
    assert out[9] == 0.5 and out[10] == pytest.approx(2 / 3)


def test_factorize_first_appearance(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, "z"), (4, None)], "id long, c string")
    out = {r["id"]: r["c_code"] for r in E.factorize(df, ["c"], ["id"], suffix="_code").collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: -1}


def test_factorize_takes_large_and_text_ids(spark):
    df = spark.createDataFrame([(0, 2**44 + 5, "a"), (1, 1, "b"), (1, 2**60, "c")], "s int, id long, c string")
    got = {r["c"]: r["k"] for r in E.factorize(df.withColumn("k", F.col("c")), ["k"], ["s", "id"]).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    text = spark.createDataFrame([("z", "x"), ("b", "y"), ("c", None)], "id string, k string")
    assert {r["id"]: r["k"] for r in E.factorize(text, ["k"], ["id"]).collect()} == {"z": 1, "b": 0, "c": -1}


def test_group_folds_balance_the_label(spark):
    # 30 groups of one size, a third of them positive: every fold gets two positive and four negative groups
    df = spark.range(300).selectExpr("id", "id % 30 as g", "cast(id % 30 < 10 as int) as y")
    per = {r["fold"]: (r["n"], r["p"]) for r in FO.group_kfold(df, 5, "g", "y").groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    assert all(n == 60 and p == 20 for n, p in per.values()) and len(per) == 5


def test_rank_by_range_equals_sort(spark):
    from foldwise.operators.ranking import rank_by_range
    df = spark.range(500).selectExpr("id % 3 as g", "(id * 7919) % 503 as v", "cast(id as string) as t")
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"], r["v"], r["t"])):
        want[r["t"]] = sum(1 for x in want.values() if x[0] == r["g"])
        want[r["t"]] = (r["g"], want[r["t"]])
    got = {r["t"]: (r["g"], r["_rank"]) for r in rank_by_range(df, ["g"], ["v", "t"]).collect()}
    assert got == want


def test_encoding_is_the_same_whatever_is_broadcast(rows):
    f = FO.kfold(rows, 5, seed=1).withColumn("a", F.col("id") % 3).withColumn("b", F.col("id") % 400)
    take = lambda df: [x for r in df.select("id", "TE_a_mean", "TE_b_mean").orderBy("id").collect() for x in r]
    want = take(E.target_encode_oof(f, ["a", "b"], "y", "fold"))
    for bound in (0, 100):  # nothing broadcast; only the small column
        assert take(E.target_encode_oof(f, ["a", "b"], "y", "fold", max_broadcast_rows=bound)) == pytest.approx(want)
