"""Leave-fold-out lexicon, permutation importance, weighted AUC and by-fold screening on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import blend as BL
from foldwise.operators import lexicon as LX
from foldwise.operators import metrics as ME
from foldwise.operators import models as MO
from foldwise.operators import select as SE


def _docs():
    rng = random.Random(3)
    return [(k, " ".join(rng.choice(["Up", "down", "side", "left"]) for _ in range(rng.randrange(9))), None if k % 4 == 3 else k % 2,
             None if k % 4 == 3 else k % 3) for k in range(60)] + [(99, None, 1, 0)]


def _plain(rows, k_min):
    out = {}
    for i, t, _, f in rows:
        part = [r for r in rows if r[3] is not None and (f is None or r[3] != f)]
        pol = {}
        for w in {x for r in part for x in (r[1] or "").lower().split()}:
            ys = [r[2] for r in part if w in (r[1] or "").lower().split()]
            if len(ys) >= k_min:
                pol[w] = 2 * sum(ys) / len(ys) - 1
        own = [pol[w] for w in (t or "").lower().split() if w in pol]
        out[i] = (sum(own) / len(own), sum(map(abs, own)) / len(own)) if own else (0.0, 0.0)
    return out


def test_lexicon_is_learned_outside_the_fold(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "id long, t string, y int, fold int")
    got = {r["id"]: (r["sentiment_polarity"], r["sentiment_subjectivity"]) for r in LX.learned_scores(df, "t", "y", "fold", 3, 4).collect()}
    want = _plain(rows, 4)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_own_label_does_not_matter(spark):
    rows = _docs()
    flipped = [(i, t, 1 - y if i == 4 else y, f) for i, t, y, f in rows]
    a, b = (LX.learned_scores(spark.createDataFrame(x, "id long, t string, y int, fold int"), "t", "y", "fold", 3, 4).where("id = 4")
            .select("sentiment_polarity", "sentiment_subjectivity").collect() for x in (rows, flipped))
    assert a == b


def test_weight_search_on_cells_equals_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(6) / 6, rng.randrange(5) / 5) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    got = {round(r["w"], 6): r["auc"] for r in BL.weight_search(df, "a", "b", n=11).collect()}
    for w, value in got.items():
        s = [(w * a + (1 - w) * b, y) for y, a, b in rows]
        pos, neg = [x for x, y in s if y], [x for x, y in s if not y]
        plain = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert value == pytest.approx(plain, abs=1e-3)  # sums that are equal on paper may differ in the last bit
    plan = BL.weight_search(df, "a", "b", n=11)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan


def test_thresholds_by_group_equal_single_ones(spark):
    rng = random.Random(7)
    rows = [(g, int(rng.random() < 0.3 + 0.1 * g), round(rng.random(), 2)) for g in range(3) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    both = {r["g"]: r["prevalence_threshold"] for r in ME.prevalence_threshold(df, by=["g"]).collect()}
    for g in range(3):
        assert both[g] == pytest.approx(ME.prevalence_threshold(df.where(F.col("g") == g)).first()[0])


def test_permutation_importance_finds_the_column_that_matters(spark):
    rng = random.Random(2)
    rows = [(k, rng.random(), rng.random()) for k in range(600)]
    df = spark.createDataFrame([(i, a, b, float(a + 0.1 * rng.random() > 0.5)) for i, a, b in rows], "id long, a double, b double, label double")
    model = MO.logistic(1.0, 600).fit(MO.assemble(df, ["a", "b"]))
    got = {r["feature"]: r["auc_drop"] for r in MO.permutation_importance(model, df, ["a", "b"], "label").collect()}
    assert got["a"] > 0.3 and abs(got["b"]) < 0.02
    # the same by hand: each row takes the value of the row that follows it in the order of md5(seed|id)
    import hashlib
    local = sorted(df.collect(), key=lambda r: (hashlib.md5(f"0|{r['id']}".encode()).hexdigest(), r["id"]))
    other = [(r["id"], local[(i + 1) % len(local)]["a"], r["b"], r["label"]) for i, r in enumerate(local)]
    score = lambda d: ME.auc(model.transform(MO.assemble(d, ["a", "b"])).withColumn("p", MO.p1()), "p", "label").first()["auc"]
    drop = score(df) - score(spark.createDataFrame(other, "id long, a double, b double, label double"))
    assert got["a"] == pytest.approx(drop, abs=1e-9)


def test_screen_by_fold_against_plain_counts(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.randrange(3), round(rng.random(), 1), rng.choice([0.0, 1.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y long, fold int, a double, b double")
    got = {(r["k"], r["feature"]): r for r in SE.screen_by_fold(SE.dense_bins(df, ["a", "b"], "y", "fold", 3, bins=4), min_keep=1, ratio=0.5).collect()}
    for k in range(3):
        part = [r for r in rows if r[1] != k]
        mi = {}
        for j, c in ((2, "a"), (3, "b")):
            vals = sorted(r[j] for r in part)
            bins = [vals.index(r[j]) * 4 // len(part) for r in part]
            n, total = len(part), 0.0
            for b in set(bins):
                for y in (0, 1):
                    pj = sum(1 for x, r in zip(bins, part) if x == b and r[0] == y) / n
                    if pj:
                        total += pj * math.log(pj / ((bins.count(b) / n) * (sum(r[0] == y for r in part) / n)))
            mi[c] = total
            assert got[k, c]["mi"] == pytest.approx(total)
        best = max(mi, key=mi.get)
        assert got[k, best]["rank"] == 1 and got[k, best]["keep"]
        assert sum(got[k, c]["keep"] for c in "ab") == 1
