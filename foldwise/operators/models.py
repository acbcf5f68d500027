"""Learned models on MLlib (ML-1..ML-6, SC-1, P-9, BL-7, BL-9, PP-3, ME-9, HP-1, HP-2, SV-1).

Every fit is a distributed MLlib job; the only driver-side loop is over
folds / trials (k iterations), never over rows. Scores leave as a long
table ``(id, fold, role, p)`` so blends and metrics apply unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_key, unit_uniform
from ..session import materialize
from .metrics import auc
from .ranking import default_buckets, rank_by_hash

FEATURES = "features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    """P-9: feature blocks side by side as one vector (blocks are joined on id before, never by position)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def standardize_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SC-1 fit: one row of ``mean_<c>``, ``std_<c>`` (population std; a constant column divides by 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return train.agg(*aggs)


def standardize_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SC-1 transform: ``(x - mean) / std`` with the train statistics (one-row table)."""
    j = df.crossJoin(F.broadcast(stats))  # one row
    out = j.select(*[c for c in df.columns if c not in cols],
                   *[((F.col(c) - F.col(f"mean_{c}")) /
                      F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(F.lit(1.0))).alias(c) for c in cols])
    return out


def p1(prob_col: str = "probability") -> F.Column:
    """Probability of class 1 from MLlib's probability vector."""
    return vector_to_array(F.col(prob_col))[1]


def logistic(C: float, n_rows: int, weight_col: str | None = None, max_iter: int = 100, standardize: bool = False) -> LogisticRegression:
    """ML-1: L2 logistic regression; scikit-learn's C sums the loss, MLlib averages it: regParam = 1/(C n).

    ``standardize`` lets the learner scale features (sparse vectors stay sparse)."""
    lr = LogisticRegression(featuresCol=FEATURES, labelCol="label", regParam=1.0 / (C * max(n_rows, 1)),
                            elasticNetParam=0.0, standardization=standardize, maxIter=max_iter)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def random_forest(seed: int = 42, trees: int = 300, depth: int = 8) -> RandomForestClassifier:
    """ML-2: bootstrap forest, leaf >= 3, 0.6 of the features per split."""
    return RandomForestClassifier(featuresCol=FEATURES, labelCol="label", numTrees=trees, maxDepth=depth,
                                  minInstancesPerNode=3, featureSubsetStrategy="0.6", bootstrap=True, seed=seed)


ROUNDS, PATIENCE = 3000, 200  # the reference's boosting rounds at most, and those without a smaller loss before it stops


def gbt(seed: int = 42, max_iter: int = ROUNDS, depth: int = 4, step: float = 0.1, subsample: float = 0.8,
        col_frac: str = "0.7", weight_col: str | None = None) -> GBTClassifier:
    """ML-3 / ML-4: boosted trees with row / column subsampling; ``fit_stopped`` stops them early."""
    g = GBTClassifier(featuresCol=FEATURES, labelCol="label", maxIter=max_iter, maxDepth=depth, stepSize=step,
                      subsamplingRate=subsample, featureSubsetStrategy=col_frac, seed=seed)
    if weight_col:
        g.setWeightCol(weight_col)
    return g


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The rounds up to the least loss, and whether ``patience`` rounds after it brought none smaller; what follows those is not read."""
    best = 0
    for m, loss in enumerate(losses):
        if loss < losses[best]:
            best = m
        elif m - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_stopped(estimator: GBTClassifier, fit_df: DataFrame, valid: DataFrame, patience: int):
    """ML-4: boosted trees up to the round of least weighted loss on ``valid``, sought until ``patience`` rounds bring none smaller
    or the estimator's rounds are used up.

    MLlib's own early stopping ends at the first round without gain, and it cannot go on from a fitted model. So rounds are fitted in
    growing numbers; the same seed gives the same first trees, so the last fit is the model of the best round.
    """
    rounds = estimator.getMaxIter()
    n = min(rounds, patience + patience // 4 + 1)
    while True:
        model = estimator.copy({estimator.maxIter: n}).fit(fit_df)
        best, stopped = best_round(model.evaluateEachIteration(valid), patience)
        if stopped or n == rounds:
            return model if best == n else estimator.copy({estimator.maxIter: best}).fit(fit_df)
        n = min(rounds, 4 * n)


def cv_oof(train: DataFrame, test: DataFrame | None, feature_cols: Sequence[str], label: str, fold_col: str,
           make_estimator: Callable[[DataFrame], object], id_col: str = "id", standardize: bool = False,
           early_stopping: int = 0, balance_col: str | None = None, parallel: int = 1) -> DataFrame:
    """ML-5: per fold k fit on ``fold <> k``, score the validation rows (OOF) and the test rows.

    Returns ``(id, fold, role, p)`` with role 'oof' (one row per train id)
    or 'test' (one row per test id and fold; average with ``mean_blend``).
    ``make_estimator(fit_df)`` builds the estimator (it may read the fit
    size, e.g. for ``regParam``). With ``standardize`` the scaler is fitted
    on the fold's training part only, and ``balance_col`` (A-11) gets the
    class weights ``n / (classes * n_class)`` of that part. ``early_stopping``
    is the patience of ``fit_stopped`` on the validation rows (0: all rounds);
    ``parallel`` folds are fitted at a time.
    """
    train = materialize(train.withColumn("label", F.col(label).cast("double")))
    # folds x labels rows
    counts = [(r[fold_col], r["label"], r["n"]) for r in train.groupBy(fold_col, "label").agg(F.count(F.lit(1)).alias("n")).collect()]
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())  # k values

    def one(k) -> list[DataFrame]:
        tr = train.where(F.col(fold_col) != k)
        va = train.where(F.col(fold_col) == k)
        te = test
        if standardize:
            st = standardize_fit(tr, feature_cols)
            tr, va = standardize_apply(tr, st, feature_cols), standardize_apply(va, st, feature_cols)
            te = standardize_apply(test, st, feature_cols) if test is not None else None
        if balance_col:
            of = {y: sum(n for f, z, n in counts if f != k and z == y) for y in sorted({y for _, y, _ in counts})}
            w = F.lit(None).cast("double")
            for y, n in of.items():
                w = F.when(F.col("label") == y, F.lit(sum(of.values()) / (len(of) * max(n, 1)))).otherwise(w)
            tr, va = tr.withColumn(balance_col, w), va.withColumn(balance_col, w)
        estimator, fit_df, valid = make_estimator(tr), assemble(tr, feature_cols), assemble(va, feature_cols)
        model = fit_stopped(estimator, fit_df, valid, early_stopping) if early_stopping else estimator.fit(fit_df)
        parts = [model.transform(valid).select(id_col, F.lit(k).alias("fold"), F.lit("oof").alias("role"), p1().alias("p"))]
        if te is not None:
            parts.append(model.transform(assemble(te, feature_cols)).select(
                id_col, F.lit(k).alias("fold"), F.lit("test").alias("role"), p1().alias("p")))
        return parts

    done = run_trials(train.sparkSession, folds, one, parallel) if parallel > 1 else [one(k) for k in folds]
    parts = [p for of_fold in done for p in of_fold]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_oof_rows(fit_rows: Callable[[int], DataFrame], score_rows: Callable[[int], DataFrame], folds: Sequence[int],
                make_estimator: Callable[[int], object], id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """ML-5 over rows that differ by fold (features fitted on the fold's train part): ``(id, fold, role, p)`` as ``cv_oof``.

    ``fit_rows(k)`` has ``label`` and ``features``; ``score_rows(k)`` has the id, ``role`` ('oof' or 'test') and ``features``.
    """
    parts = [make_estimator(k).fit(fit_rows(k)).transform(score_rows(k)).select(
        id_col, F.lit(k).alias("fold"), "role", p1().alias("p"), *keep) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(oof: DataFrame, id_col: str = "id") -> DataFrame:
    """ML-5: by role and fold the scored rows, their distinct ids, and the scores that are probabilities."""
    return oof.groupBy("role", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_ids"),
                                           F.sum(F.col("p").between(0.0, 1.0).cast("long")).alias("n_scored"))


def stacker(oof_wide: DataFrame, cols: Sequence[str], label: str = "y", C: float = 1.0,
            apply_to: DataFrame | None = None) -> tuple[DataFrame, float]:
    """BL-7: logistic stacker on OOF score columns (fitted and scored on the same rows, as the
    reference does: optimistic). Returns (scored rows with ``p_stack``, in-sample AUC)."""
    d = assemble(oof_wide.withColumn("label", F.col(label).cast("double")), cols)
    n = d.count()
    m = logistic(C, n).fit(d)
    scored = m.transform(d).withColumn("p_stack", p1())
    a = auc(scored, "p_stack", label).first()["auc"]
    if apply_to is not None:
        scored = m.transform(assemble(apply_to, cols)).withColumn("p_stack", p1())
    return scored.drop(FEATURES, "rawPrediction", "probability", "prediction"), a


def calibrated_stacker(oof_wide: DataFrame, cols: Sequence[str], fold_col: str, label: str = "y",
                       apply_to: DataFrame | None = None) -> DataFrame:
    """BL-9: per fold a logistic stacker, then a one-variable logistic (Platt) on its logit fitted on the
    held-out fold; the calibrated score is the mean of the k calibrated models. Output ``(id, p_cal)`` for the rows of
    ``apply_to`` (default: the fitted ones)."""
    d = materialize(assemble(oof_wide.withColumn("label", F.col(label).cast("double")), cols))
    target = d if apply_to is None else materialize(assemble(apply_to, cols))
    folds = sorted(r[0] for r in d.select(fold_col).distinct().collect())
    outs = []
    for k in folds:
        tr, va = d.where(F.col(fold_col) != k), d.where(F.col(fold_col) == k)
        base = logistic(1.0, tr.count()).fit(tr)
        p = F.least(F.greatest(p1(), F.lit(1e-15)), F.lit(1.0 - 1e-15))
        logit_col = F.log(p / (F.lit(1.0) - p))
        va_s = base.transform(va).select("id", "label", logit_col.alias("z"))
        platt = LogisticRegression(featuresCol="zf", labelCol="label", regParam=0.0).fit(
            VectorAssembler(inputCols=["z"], outputCol="zf").transform(va_s))
        all_s = base.transform(target).select("id", logit_col.alias("z"))
        cal = platt.transform(VectorAssembler(inputCols=["z"], outputCol="zf").transform(all_s))
        outs.append(cal.select("id", p1().alias("p_cal")))
    u = outs[0]
    for o in outs[1:]:
        u = u.unionByName(o)
    return u.groupBy("id").agg(F.avg("p_cal").alias("p_cal"))


def run_trials(spark, trials: Sequence, evaluate: Callable, parallel: int) -> list:
    """HP-2: ``evaluate`` of every trial, in order, at most ``parallel`` at a time, each under a job group of its own."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    def one(job):
        k, trial = job
        spark.sparkContext.setJobGroup(f"trial-{k}", f"trial {k}", interruptOnCancel=True)
        return evaluate(trial)

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(one), enumerate(trials)))


def permutation_importance(model, df: DataFrame, cols: Sequence[str], label: str, id_col: str = "id",
                           seed: int = 0) -> DataFrame:
    """ME-9: AUC drop when one column is permuted (others fixed), all columns in one pass.

    Rows stand in a random order (``md5(seed|id)``); the row of rank i takes its permuted values from the row of rank i + 1
    (the last from the first), a permutation without fixed points. So one join by rank gives each row an array of the values
    that all its columns take, one at a time; the variants are scored where the row is, and only their scores are counted
    by feature.
    """
    t = materialize(rank_by_hash(df.withColumn("_h", md5_key(F.lit(seed), id_col)), [], "_h", id_col, out="_r").drop("_h"))
    n = t.count()
    given = t.select(((F.col("_r") + F.lit(max(n, 1) - 1)) % F.lit(max(n, 1))).alias("_r"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("_pv"))
    # variant 0 is the row itself, variant j has the other value of column j
    pairs = t.join(given, "_r").select(label, "_pv", *[F.col(c).cast("double").alias(c) for c in cols],
                                       F.explode(F.sequence(F.lit(0), F.lit(len(cols)))).alias("_j"))
    variants = pairs.select(label, "_j", *[F.when(F.col("_j") == j + 1, F.col("_pv")[j]).otherwise(F.col(c)).alias(c) for j, c in enumerate(cols)])
    scored = model.transform(assemble(variants, cols)).select(label, "_j", p1().alias("_p"))
    # the scores of the rows themselves cut the ranges of all variants
    n_buckets = default_buckets(t)
    bounds = model.transform(assemble(t, cols)).select(p1().alias("_p")).approxQuantile(
        "_p", [i / n_buckets for i in range(1, n_buckets)], 1.0 / (4 * n_buckets)) if n else []
    aucs = {r["_j"]: r["auc"] for r in auc(scored, "_p", label, by=["_j"], bounds=bounds).collect()}  # a row per column
    return df.sparkSession.createDataFrame([(c, float(aucs.get(0, 0.5) - aucs.get(j + 1, 0.5))) for j, c in enumerate(cols)],
                                           "feature string, auc_drop double")


def draw_trials(spark, n_trials: int, space: dict, seed: int = 0) -> DataFrame:
    """HP-1: seeded draws of a parameter space, one row per trial.

    ``space[name] = (kind, low, high[, q])`` with kind in uniform / loguniform /
    quniform; draws come from ``md5(seed|trial|name)``.
    """
    t = spark.range(n_trials).withColumnRenamed("id", "trial")
    cols = []
    for name, spec in space.items():
        kind, lo, hi = spec[0], spec[1], spec[2]
        u = unit_uniform(md5_key(F.lit(seed), F.col("trial"), F.lit(name)))
        if kind == "loguniform":
            v = F.exp(u * F.lit(math.log(hi) - math.log(lo)) + F.lit(math.log(lo)))
        else:
            v = u * F.lit(hi - lo) + F.lit(lo)
        if kind == "quniform":
            q = spec[3]
            v = F.bround(v / F.lit(q), 0) * F.lit(q)
        cols.append(v.alias(name))
    return t.select("trial", *cols)


_SVD_ROWS = 500  # rows that are dense at a time


def _dense(batch, idx_col: str, val_col: str, n: int):
    """The rows of an Arrow batch as a matrix; a null list is a row of zeros."""
    import numpy as np
    import pyarrow.compute as pc

    idx, val = batch.column(idx_col), batch.column(val_col)
    size = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, n))
    out[np.repeat(np.arange(batch.num_rows), size), idx.flatten().to_numpy(zero_copy_only=False)] = \
        val.flatten().to_numpy(zero_copy_only=False)
    return out


def svd_fit(rows: DataFrame, idx_col: str, val_col: str, n_features: int, k: int):
    """SV-1 fit: the top-k right singular vectors (no centring) of rows given as ``(indices, values)``, as a matrix of
    features x k; those beyond the rank are zero. Each task sums ``x'x`` of its rows (features x features, bounded by
    the vocabulary), Spark adds the sums by feature, and only their total comes to the driver."""
    import numpy as np
    import pyarrow as pa

    nf = int(n_features)
    names = ["feature", "part"]

    def gram(it):
        g = np.zeros((nf, nf))
        for b in it:
            for lo in range(0, b.num_rows, _SVD_ROWS):
                x = _dense(b.slice(lo, _SVD_ROWS), idx_col, val_col, nf)
                g += x.T @ x
        for lo in range(0, nf, 256):
            at = range(lo, min(lo + 256, nf))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([g[i, i:].tobytes() for i in at], pa.binary())], names)

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, float) for x in t.column("part").to_pylist()], axis=0)
        return pa.table([pa.array(t.column("feature").to_pylist()[:1], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    schema = "feature int, part binary"
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select(idx_col, val_col).coalesce(cores).mapInArrow(gram, schema)
    g = np.zeros((nf, nf))
    for r in parts.groupBy("feature").applyInArrow(add, schema).collect():  # features rows
        g[r["feature"], r["feature"]:] = np.frombuffer(bytes(r["part"]), float)
    return top_vectors(g, k)


def top_vectors(g, k: int):
    """The leading ``k`` eigenvectors of ``x'x`` given by its upper triangle, each with its largest entry positive; those
    beyond the rank are zero."""
    import numpy as np

    nf = len(g)
    V = np.zeros((nf, k))
    if nf:
        value, vec = np.linalg.eigh(g, UPLO="U")
        top = [i for i in range(nf - 1, max(nf - 1 - k, -1), -1) if value[i] > value[-1] * nf * 1e-15]
        V[:, :len(top)] = vec[:, top]
        V *= np.where(V[np.abs(V).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return V


def svd_project(rows: DataFrame, spaces: Sequence[tuple[str, str, str, object]], id_col: str = "id") -> DataFrame:
    """SV-1: every row on the vectors of each space ``(name, indices, values, V)`` (``x @ V``), as ``name_0``...; a row
    without indices is zero. V is broadcast (bounded by the vocabulary); the projection runs per Arrow batch."""
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast([tuple(x) for x in spaces])
    names = [id_col, *[n for n, *_ in spaces]]

    def proj(it):
        for b in it:
            for lo in range(0, b.num_rows, _SVD_ROWS):
                part = b.slice(lo, _SVD_ROWS)
                out = [pa.array(list(_dense(part, i, v, len(V)) @ V), pa.list_(pa.float64())) for _, i, v, V in held.value]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *out], names)

    cols = [c for _, i, v, _ in spaces for c in (i, v)]
    schema = ", ".join([f"{id_col} long", *[f"{n} array<double>" for n in names[1:]]])
    return rows.select(F.col(id_col).cast("long").alias(id_col), *cols).mapInArrow(proj, schema).select(
        id_col, *[F.col(n)[j].alias(f"{n}_{j}") for n, _, _, V in spaces for j in range(V.shape[1])])
