"""Metric, blend, post-processing and profile queries (ME-*, BL-*, PP-*, A-*, W-1, W-3, IO-5/6/11)
over the score views, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blend as BL
from ..operators import metrics as ME
from ..operators import post as PP
from ..operators import profile as PR
from ..operators.folds import kfold_sql, stratified_kfold
from ..session import materialize
from ..sources.tables import table
from ..sources.views import (ANSWERS_SQL, APPLICATIONS_SQL, NUMERIC, SCORES_SQL, answers, applications, scores,
                             seed_scores, seed_scores_sql, test_scores, test_scores_sql)
from .common import finish, r6

K = 5
SEED = 42

MODELS = (1, 2, 3)  # of the score views


def _fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    folds = stratified_kfold(lab, K, "y", seed=SEED).select("id", "fold")
    return scores(spark, sf_dir).join(folds, "id")


_FOLDS_SQL = kfold_sql("select doc_id id, quality y from labels", K, SEED, label="y")
FOLD_SCORES_SQL = f"select s.*, f.fold from ({SCORES_SQL}) s join ({_FOLDS_SQL}) f on f.id = s.id"


# ---------------------------------------------------------------- metrics

def auc_by_model(spark, sf_dir):
    """ME-1/ME-3/ME-10: AUC per model with its leaderboard rank."""
    r = ME.auc(scores(spark, sf_dir), by=["model"])
    return finish(r.withColumn("rank", F.rank().over(Window.orderBy(F.col("auc").desc()))))


AUC_BY_MODEL_SQL = f"""select *, rank() over (order by auc desc) rank from (
select model, n_pos, n_neg, {r6('auc')} auc from ({ME.auc_sql(SCORES_SQL, by=['model'])}) a) b"""


def auc_by_model_fold(spark, sf_dir):
    return finish(ME.auc(_fold_scores(spark, sf_dir), by=["model", "fold"]))


AUC_BY_MODEL_FOLD_SQL = f"select model, fold, n_pos, n_neg, {r6('auc')} auc from ({ME.auc_sql(FOLD_SCORES_SQL, by=['model', 'fold'])}) a"


def roc_curve(spark, sf_dir):
    """ME-4 on every model's OOF scores."""
    return finish(ME.roc_curve(scores(spark, sf_dir), by=["model"]))


_ROC_COUNTS = f"""d as (select model, p, sum(y) pos, count(*) - sum(y) neg from ({SCORES_SQL}) s group by model, p),
c as (select model, p, sum(pos) over (partition by model order by p desc rows between unbounded preceding and current row) tp,
             sum(neg) over (partition by model order by p desc rows between unbounded preceding and current row) fp,
             sum(pos) over (partition by model) tot_pos, sum(neg) over (partition by model) tot_neg from d)"""
ROC_CURVE_SQL = f"""with {_ROC_COUNTS}
select model, {r6('p')} threshold, cast(tp as bigint) tp, cast(fp as bigint) fp, {r6('tp / tot_pos')} tpr,
       {r6('fp / tot_neg')} fpr from c"""


def _thresholds(spark, sf_dir) -> DataFrame:
    s = scores(spark, sf_dir)
    you = ME.youden_threshold(ME.roc_curve(s, by=["model"]), ["model"])
    out = you.join(ME.prevalence_threshold(s, by=["model"]), "model")  # one row per model
    return out.select("model", "youden_threshold", "youden_j", "prevalence_threshold",
                      ME.final_threshold(F.col("youden_threshold"), F.col("prevalence_threshold")).alias("final_threshold"))


def thresholds(spark, sf_dir):
    """ME-5/ME-6/ME-7 on every model's OOF scores."""
    return finish(_thresholds(spark, sf_dir))


THRESHOLDS_SQL = f"""
with {_ROC_COUNTS},
you as (select model, arg_max(p, (tp / tot_pos - fp / tot_neg, p)) yt, max(tp / tot_pos - fp / tot_neg) yj from c group by model),
rk as (select model, p, row_number() over (partition by model order by p) - 1 r,
              (1 - avg(y) over (partition by model)) * (count(*) over (partition by model) - 1) x from ({SCORES_SQL}) s),
prev as (select model, min(p) + (max(p) - min(p)) * (any_value(x) - floor(any_value(x))) pt
         from rk where r = floor(x) or r = ceil(x) group by model)
select you.model, {r6('yt')} youden_threshold, {r6('yj')} youden_j, {r6('pt')} prevalence_threshold,
       {r6('least(greatest(0.75e0 * (0.45e0 * yt + 0.45e0 * pt + 0.05e0) + 0.125e0, 0.2e0), 0.8e0)')} final_threshold
from you join prev on prev.model = you.model"""


def accuracy_by_model(spark, sf_dir):
    return finish(ME.accuracy(scores(spark, sf_dir), by=["model"]))


ACCURACY_BY_MODEL_SQL = f"select model, {r6('avg(cast((p > 0.5) = (y = 1) as double))')} accuracy from ({SCORES_SQL}) s group by model"


def class_weights(spark, sf_dir):
    """A-11: per fold, weights from the training part (fold <> k): n / (2 n_c)."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    f = stratified_kfold(lab, K, "y", seed=SEED)
    per = f.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("c"))
    w = Window
    per = per.withColumn("c_tot", F.sum("c").over(w.partitionBy("y"))) \
        .withColumn("n_f", F.sum("c").over(w.partitionBy("fold"))) \
        .withColumn("n_tot", F.sum("c").over(w.partitionBy()))
    n_tr = F.col("n_tot") - F.col("n_f")
    c_tr = F.col("c_tot") - F.col("c")
    return finish(per.select("fold", "y", (n_tr / (F.lit(2) * c_tr)).alias("weight")))


CLASS_WEIGHTS_SQL = f"""with f as ({_FOLDS_SQL}), ks as (select distinct fold from f)
select ks.fold, cast(f.y as bigint) y, {r6('(select count(*) from f f2 where f2.fold <> ks.fold) / (2e0 * count(*))')} weight
from ks join f on f.fold <> ks.fold group by ks.fold, f.y"""


# ---------------------------------------------------------------- blends

def _wide(spark, sf_dir):
    return BL.wide_scores(scores(spark, sf_dir), [1, 2, 3])


_WIDE_SQL = f"""select id, any_value(y) y, max(case when model = 1 then p end) p_1, max(case when model = 2 then p end) p_2,
                max(case when model = 3 then p end) p_3 from ({SCORES_SQL}) s group by id"""


def blend_means(spark, sf_dir):
    s = scores(spark, sf_dir)
    return finish(BL.mean_blend(s).join(BL.logit_mean_blend(s), "id"))


_LOGIT = "ln((p + 1e-12) / (1 - p + 1e-12))"
BLEND_MEANS_SQL = f"select id, {r6('avg(p)')} p_mean, {r6(f'1 / (1 + exp(-avg({_LOGIT})))')} p_logit_mean from ({SCORES_SQL}) s group by id"


def _grid_sql(space: str) -> str:
    w = "case when i = 100 then 1e0 else cast(i as double) * 0.01e0 end"
    if space == "logit":
        la, lb = _LOGIT.replace("p", "p_3"), _LOGIT.replace("p", "p_2")
        s = f"1 / (1 + exp(-(w * {la} + (1 - w) * {lb})))"
    else:
        s = "w * p_3 + (1 - w) * p_2"
    src = f"select w, y, {s} s from (select *, {w} w from ({_WIDE_SQL}) x cross join (select range i from range(0, 101)) g) z"
    return ME.auc_sql(src, score="s", label="y", by=["w"])


def blend_linear_grid(spark, sf_dir):
    """BL-4: AUC of w * p_3 + (1 - w) * p_2 for the 101 grid weights."""
    return finish(BL.weight_search(_wide(spark, sf_dir), "p_3", "p_2", space="linear"))


def blend_linear_best(spark, sf_dir):
    return finish(BL.best_weight(BL.weight_search(_wide(spark, sf_dir), "p_3", "p_2", space="linear")))


def blend_logit_grid(spark, sf_dir):
    """BL-5: the same search in logit space."""
    return finish(BL.weight_search(_wide(spark, sf_dir), "p_3", "p_2", space="logit"))


def blend_logit_best(spark, sf_dir):
    return finish(BL.best_weight(BL.weight_search(_wide(spark, sf_dir), "p_3", "p_2", space="logit")))


BLEND_LINEAR_GRID_SQL = f"select {r6('w')} w, {r6('auc')} auc from ({_grid_sql('linear')}) a"
BLEND_LOGIT_GRID_SQL = f"select {r6('w')} w, {r6('auc')} auc from ({_grid_sql('logit')}) a"
BLEND_LINEAR_BEST_SQL = f"select {r6('arg_max(w, (auc, -w))')} best_w, {r6('max(auc)')} best_auc from ({_grid_sql('linear')}) a"
BLEND_LOGIT_BEST_SQL = f"select {r6('arg_max(w, (auc, -w))')} best_w, {r6('max(auc)')} best_auc from ({_grid_sql('logit')}) a"


def blend_simplex(spark, sf_dir):
    """BL-6: simplex grid (step 0.1) over the three models."""
    return finish(BL.simplex_search(_wide(spark, sf_dir), ["p_1", "p_2", "p_3"]))


def _simplex_sql() -> str:
    pts = BL.simplex_points(3, 0.1)
    vals = ", ".join(f"({i}, {a!r}e0, {b!r}e0, {c!r}e0)" for i, (a, b, c) in enumerate(pts))
    src = (f"select point, w_p_1, w_p_2, w_p_3, y, w_p_1 * p_1 + w_p_2 * p_2 + w_p_3 * p_3 s from ({_WIDE_SQL}) x "
           f"cross join (values {vals}) g(point, w_p_1, w_p_2, w_p_3)")
    return ME.auc_sql(src, score="s", label="y", by=["point", "w_p_1", "w_p_2", "w_p_3"])


BLEND_SIMPLEX_SQL = f"select cast(point as bigint) point, {r6('w_p_1')} w_p_1, {r6('w_p_2')} w_p_2, {r6('w_p_3')} w_p_3, {r6('auc')} auc from ({_simplex_sql()}) a"


def blend_simplex_test(spark, sf_dir):
    """BL-6 in full: the best simplex weights (equal ones if no AUC is defined) applied to the test scores, beside
    their plain mean."""
    cols = ["p_1", "p_2", "p_3"]
    best = BL.best_simplex(BL.simplex_search(_wide(spark, sf_dir), cols), cols)  # one row
    test = test_scores(spark, sf_dir).groupBy("id").pivot("model", [1, 2, 3]).agg(F.first("p"))
    test = test.select("id", *[F.col(f"`{m}`").alias(f"p_{m}") for m in (1, 2, 3)])
    w = [F.coalesce(F.col(f"w_{c}"), F.lit(1.0 / len(cols))) for c in cols]
    weighted = sum((a * F.col(c) for a, c in zip(w[1:], cols[1:])), w[0] * F.col(cols[0]))
    plain = (F.col("p_1") + F.col("p_2") + F.col("p_3")) / 3
    return finish(test.crossJoin(F.broadcast(best)).select("id", weighted.alias("p_weighted"), plain.alias("p_plain"), "best_auc"))


BLEND_SIMPLEX_TEST_SQL = f"""with a as ({_simplex_sql()}),
b as (select * from a order by auc desc, point limit 1),
t as (select id, max(p) filter (where model = 1) p_1, max(p) filter (where model = 2) p_2, max(p) filter (where model = 3) p_3
      from ({test_scores_sql()}) s group by id)
select id, {r6('w_p_1 * p_1 + w_p_2 * p_2 + w_p_3 * p_3')} p_weighted, {r6('(p_1 + p_2 + p_3) / 3')} p_plain, {r6('auc')} best_auc from t, b"""


def meta_blend(spark, sf_dir):
    """BL-10: ensemble A = logit mean of models 1 and 2, ensemble B = model 3; logit weight search A vs B."""
    s = scores(spark, sf_dir)
    a = BL.logit_mean_blend(s.where(F.col("model") <= 2)).withColumnRenamed("p_logit_mean", "p_a")
    b = s.where(F.col("model") == 3).select("id", "y", F.col("p").alias("p_b"))
    grid = BL.weight_search(b.join(a, "id"), "p_a", "p_b", space="logit")
    return finish(BL.best_weight(grid))


_A = f"select id, 1 / (1 + exp(-avg({_LOGIT}))) p_a from ({SCORES_SQL}) s where model <= 2 group by id"
_META_SRC = (f"select w, y, 1 / (1 + exp(-(w * {_LOGIT.replace('p', 'p_a')} + (1 - w) * {_LOGIT.replace('p', 'p_b')}))) s "
             f"from (select b.id, b.y, b.p p_b, a.p_a, case when i = 100 then 1e0 else cast(i as double) * 0.01e0 end w "
             f"from (select id, y, p from ({SCORES_SQL}) s where model = 3) b join ({_A}) a on a.id = b.id "
             f"cross join (select range i from range(0, 101)) g) z")
META_BLEND_SQL = f"select {r6('arg_max(w, (auc, -w))')} best_w, {r6('max(auc)')} best_auc from ({ME.auc_sql(_META_SRC, score='s', label='y', by=['w'])}) a"


def seed_trim(spark, sf_dir):
    """W-1 + ME-3: per (model, fold, seed) validation AUC, then drop the worst seed of each (model, fold)."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    folds = stratified_kfold(lab, K, "y", seed=SEED).select("id", "fold")
    diag = ME.auc(seed_scores(spark, sf_dir).join(folds, "id"), by=["model", "fold", "seed"], out="val_auc")
    return finish(BL.drop_worst_seed(diag.select("model", "fold", "seed", "val_auc")))


SEED_TRIM_SQL = f"""with diag as (select model, fold, seed, val_auc from ({ME.auc_sql(
    f"select s.*, f.fold from ({seed_scores_sql()}) s join ({_FOLDS_SQL}) f on f.id = s.id",
    by=['model', 'fold', 'seed'], out='val_auc')}) a),
r as (select *, row_number() over (partition by model, fold order by val_auc, seed desc) rk,
             count(*) over (partition by model, fold) n from diag)
select model, fold, seed, {r6('val_auc')} val_auc from r where rk > 1 or n = 1"""


def hp_objective(spark, sf_dir):
    """A-10 / HP-3 / W-4: fold AUCs per model as trials; mean - 0.5 * population std; best = min loss."""
    fa = ME.auc(_fold_scores(spark, sf_dir), by=["model", "fold"])
    obj = PR.penalised_objective(fa, trial="model", metric="auc")
    best = obj.agg(F.min_by("model", -F.col("score")).alias("best_model"))
    return finish(obj.crossJoin(best))  # one-row table


HP_OBJECTIVE_SQL = f"""with fa as ({ME.auc_sql(FOLD_SCORES_SQL, by=['model', 'fold'])}),
o as (select model, avg(auc) mean, stddev_pop(auc) std from fa group by model)
select model, {r6('mean')} mean, {r6('std')} std, {r6('mean - 0.5e0 * std')} score,
       (select arg_min(model, -(mean - 0.5e0 * std)) from o) best_model from o"""


# ---------------------------------------------------------------- post-processing

def _test_ensemble(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"))
    return BL.mean_blend(test_scores(spark, sf_dir)).withColumnRenamed("p_mean", "p").join(docs, "id")


_TEST_ENS_SQL = (f"select t.id, avg(t.p) p, any_value(d.source) topic from ({test_scores_sql()}) t "
                 f"join documents d on d.doc_id = t.id group by t.id")


STRETCHES = (0.0, 0.6, 1.8)  # of the test ensemble around .5: none, the relaxed and the strict pair of thresholds apply


def _stretched(t, stretch):
    p = F.lit(0.5) + (F.col("p") - 0.5) * (1 + stretch)
    return t.withColumn("p", F.least(F.greatest(F.round(p, 4), F.lit(0.0)), F.lit(1.0)))


def pseudo_labels(spark, sf_dir):
    """PP-1 / PP-2 / U-1, for three spreads of the test scores."""
    train = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    t = _test_ensemble(spark, sf_dir)
    out = None
    for s in STRETCHES:
        one = PP.pseudo_labels(train, _stretched(t, s)).withColumn("stretch", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return finish(out)


PSEUDO_LABELS_SQL = f"""with s as (select unnest([{', '.join(f'{x!r}e0' for x in STRETCHES)}]) stretch),
t as (select stretch, id, least(greatest(round(0.5e0 + (p - 0.5e0) * (1 + stretch), 4), 0e0), 1e0) p from ({_TEST_ENS_SQL}) e cross join s),
th as (select stretch, case when sum(case when p >= 0.98 or p <= 0.02 then 1 else 0 end) >= count(*) * 0.3
                   then 0.98 else 0.95 end hi,
              case when sum(case when p >= 0.98 or p <= 0.02 then 1 else 0 end) >= count(*) * 0.3
                   then 0.02 else 0.05 end lo from t group by stretch)
select doc_id id, cast(quality as bigint) y, 1e0 weight, 'train' source, stretch from labels cross join s
union all
select id, cast(p > 0.5 as bigint) y, {r6('0.5e0 * greatest(p, 1 - p)')} weight, 'pseudo' source, t.stretch
from t join th on th.stretch = t.stretch where p >= th.hi or p <= th.lo"""


def _calibrated(spark, sf_dir):
    """Topics of long names are labelled by ``toxic``, so that some have a mean below .3 and others one above .7."""
    train = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic")), "doc_id") \
        .select("topic", F.when(F.length("topic") > 4, F.col("toxic")).otherwise(F.col("quality")).alias("y"))
    return PP.topic_calibration(_test_ensemble(spark, sf_dir), train)


def topic_calibration(spark, sf_dir):
    """PP-4 / A-3 / J-6."""
    return finish(_calibrated(spark, sf_dir).select("id", "topic", "p", "p_topic"))


_CAL_SQL = f"""with t as ({_TEST_ENS_SQL}),
st as (select d.source topic, avg(case when length(d.source) > 4 then l.toxic else l.quality end) tm
       from labels l join documents d on d.doc_id = l.doc_id group by d.source having count(*) > 5)
select t.id, t.topic, t.p,
       case when st.tm > 0.7 then t.p * 0.9e0 + least(greatest(t.p + 0.1e0, 0e0), 1e0) * 0.1e0
            when st.tm < 0.3 then t.p * 0.9e0 + least(greatest(t.p - 0.1e0, 0e0), 1e0) * 0.1e0
            else t.p end p_topic
from t left join st on st.topic = t.topic"""
TOPIC_CALIBRATION_SQL = f"select id, topic, {r6('p')} p, {r6('p_topic')} p_topic from ({_CAL_SQL}) c"


def post_variants(spark, sf_dir):
    """PP-6 / PP-7 / IO-6 / IO-5: main, conservative, aggressive and the fixed-precision text."""
    c = _calibrated(spark, sf_dir)
    v = PP.variants(c, "id", "p_topic", "p")
    return finish(v.withColumn("main_text", PP.fixed_precision(F.col("main"))))


POST_VARIANTS_SQL = f"""with c as ({_CAL_SQL}),
v as (select id, 0.97e0 * least(greatest(p_topic, 0.001e0), 0.999e0) + 0.03e0 * p main,
             least(greatest(p_topic, 0.001e0), 0.999e0) conservative from c)
select id, {r6('main')} main, {r6('conservative')} conservative, {r6('pow(main, 0.9e0)')} aggressive,
       printf('%.10f', least(greatest(main, 1e-6), 1 - 1e-6)) main_text from v"""


def output_validation(spark, sf_dir):
    """IO-11 + P-12: binary labels from each model's final threshold applied to the test ensemble."""
    t = _thresholds(spark, sf_dir).select("model", F.col("final_threshold").alias("t"))
    labelled = materialize(_test_ensemble(spark, sf_dir).crossJoin(F.broadcast(t)).select(  # one row per model
        "id", "model", PP.binarise(F.col("p"), F.col("t")).alias("label")))
    expected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    out = None
    for m in MODELS:
        own = labelled.where(F.col("model") == m)
        one = PP.validate_output(own, expected).crossJoin(own.agg(F.sum("label").alias("n_positive"))).withColumn("model", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return finish(out)


OUTPUT_VALIDATION_SQL = f"""with th as ({THRESHOLDS_SQL.replace(chr(10), ' ')}),
t as ({_TEST_ENS_SQL}),
lab as (select th.model, t.id, cast(t.p >= th.final_threshold as bigint) label from t, th),
e as (select doc_id id from documents where doc_id not in (select doc_id from labels))
select model, count(*) as rows, cast(sum(case when label not in (0, 1) or label is null then 1 else 0 end) as bigint) bad_labels,
       (select count(*) from e) expected_rows,
       (select count(*) from e where id not in (select id from lab l where l.model = lab.model)) missing_ids,
       cast(sum(label) as bigint) n_positive
from lab group by model"""


# ---------------------------------------------------------------- profiles

def profile_lengths(spark, sf_dir):
    """A-5."""
    return finish(PR.length_profile(answers(spark, sf_dir), "answer", "is_cheating", "topic"))


PROFILE_LENGTHS_SQL = f"""with a as ({ANSWERS_SQL})
select {', '.join(f"{r6(f'quantile_cont(length(coalesce(answer, {chr(39)}{chr(39)})), {q})')} {n}" for q, n in zip(PR.QUANTILES, ['q00', 'q01', 'q05', 'q25', 'q50', 'q75', 'q95', 'q99', 'q100']))},
       count(*) n_rows, {r6('avg(is_cheating)')} pos_rate, count(distinct topic) n_topics from a"""


def class_distribution(spark, sf_dir):
    """A-1."""
    return finish(PR.class_distribution(answers(spark, sf_dir).where(F.col("split") == "train"), "is_cheating"))


CLASS_DISTRIBUTION_SQL = f"""select cast(is_cheating as bigint) is_cheating, count(*) n, {r6('count(*) / sum(count(*)) over ()')} share
from ({ANSWERS_SQL}) a where split = 'train' group by is_cheating"""


def topic_frequency(spark, sf_dir):
    """A-2 / A-3: topics by frequency with their positive rate."""
    a = answers(spark, sf_dir).where(F.col("split") == "train")
    out = a.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_cheating").cast("double")).alias("mean"))
    return finish(out.orderBy(F.col("n").desc(), "topic"))


TOPIC_FREQUENCY_SQL = f"select topic, count(*) n, {r6('avg(is_cheating)')} mean from ({ANSWERS_SQL}) a where split = 'train' group by topic"


def describe_applications(spark, sf_dir):
    """A-6 over the numeric loan columns."""
    return finish(PR.describe(applications(spark, sf_dir), NUMERIC))


DESCRIBE_APPLICATIONS_SQL = f"""with a as ({APPLICATIONS_SQL}),
l as (unpivot (select {', '.join(f'cast({c} as double) {c}' for c in NUMERIC)} from a) on {', '.join(NUMERIC)} into name col value v)
select col "column", count(v) count, {r6('avg(v)')} mean, {r6('stddev_samp(v)')} std, {r6('min(v)')} min,
       {r6('max(v)')} max, {r6('quantile_cont(v, 0.25)')} p25, {r6('quantile_cont(v, 0.5)')} p50,
       {r6('quantile_cont(v, 0.75)')} p75 from l group by col"""


def score_summary(spark, sf_dir):
    """A-7 / A-8: test-ensemble scores above .5 and the train target mean."""
    t = PR.positives_above(_test_ensemble(spark, sf_dir), "p", 0.5)
    m = table(spark, sf_dir, "labels").agg(F.avg(F.col("quality").cast("double")).alias("target_mean"))
    return finish(t.crossJoin(m))  # one-row tables


SCORE_SUMMARY_SQL = f"""select (select count(*) from ({_TEST_ENS_SQL}) t where p > 0.5) n_above,
       (select {r6('avg(cast(p > 0.5 as double))')} from ({_TEST_ENS_SQL}) t) share_above,
       (select {r6('avg(quality)')} from labels) target_mean"""


def isotonic_calibration(spark, sf_dir):
    """PP-5: isotonic fit on the OOF ensemble (labelled rows), applied to the test ensemble."""
    p = F.round("p", 6).alias("p")  # a mean of doubles depends on their order
    oof = BL.mean_blend(scores(spark, sf_dir), by=["id", "y"]).withColumnRenamed("p_mean", "p").select("y", p)
    return finish(PP.isotonic_fit_transform(oof, _test_ensemble(spark, sf_dir).select("id", p)).select("id", "p", "p_iso"))


# the value at a score is the largest, over all starts up to it, of the least mean from there to any end from it on
ISOTONIC_CALIBRATION_SQL = f"""with o as (select round(avg(p), 6) p, any_value(y) y from ({SCORES_SQL}) s group by id),
d as (select p, sum(y) s, count(*) n from o group by p),
c as (select p, row_number() over (order by p) i, sum(s) over (order by p) s, sum(n) over (order by p) n from d),
e as (select a.i a, b.i b, (b.s - coalesce(z.s, 0)) / (b.n - coalesce(z.n, 0)) m
      from c a join c b on b.i >= a.i left join c z on z.i = a.i - 1),
least_ as (select a, b, min(m) over (partition by a order by b desc) m from e),
k as (select c.p, max(m) v from least_ join c on c.i = b group by c.p),
t as (select id, round(p, 6) p from ({_TEST_ENS_SQL}) x)
select t.id, t.p, round(case when k0.p is null then k1.v when k1.p is null or k1.p = k0.p then k0.v
                             else k0.v + (k1.v - k0.v) * (t.p - k0.p) / (k1.p - k0.p) end, 6) p_iso
from t asof left join k k0 on t.p >= k0.p asof left join k k1 on t.p <= k1.p"""
