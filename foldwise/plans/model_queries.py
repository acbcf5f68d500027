"""Queries for folds, vectors, selection, lexicon, inputs (SQL-checked) and learned models (rows-only)."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import unit_uniform_sql
from ..functions.text import WS_BODY
from ..operators import blend as BL
from ..operators import lexicon as LX
from ..operators import lowrank as LR
from ..operators import models as MO
from ..operators import post as PP
from ..operators import profile as PR
from ..operators import select as SE
from ..operators import termrows as TR
from ..operators import textstyle as TS
from ..operators import tfidf as TF
from ..operators.encode import factorize
from ..operators.joins import lookup_join
from ..operators.folds import group_kfold, kfold, kfold_sql, repeated_stratified_kfold, stratified_kfold
from ..operators.metrics import auc, auc_sql
from ..session import materialize
from ..sources.tables import strict_lookup, table
from ..sources.views import ANSWERS_SQL, APPLICATIONS_SQL, CATS, NUMERIC, TARGET, answers, applications, scores, test_scores
from .common import finish, pvar, r6
from .text_queries import TOK

K = 5
SEED = 42


def _labelled(spark, sf_dir):
    return answers(spark, sf_dir).where(F.col("split") == "train")


# ---------------------------------------------------------------- folds (SQL)

def folds_group(spark, sf_dir):
    """FO-3: topics never span folds (snake deal by majority label and size)."""
    f = group_kfold(_labelled(spark, sf_dir).select("id", "topic", "is_cheating"), K, "topic", "is_cheating", seed=SEED)
    return finish(f.select("id", "topic", "fold"))


FOLDS_GROUP_SQL = f"""with a as (select * from ({ANSWERS_SQL}) x where split = 'train'),
g as (select topic, count(*) n, sum(is_cheating) pos, md5(concat('{SEED}', '|', topic)) h from a group by topic),
r as (select topic, row_number() over (order by pos * 2 >= n desc, n desc, h, topic) - 1 i from g)
select a.id, a.topic, cast(case when (i // {K}) % 2 = 0 then i % {K} else {K} - 1 - i % {K} end as bigint) fold
from a join r on r.topic = a.topic"""


def folds_repeated(spark, sf_dir):
    """FO-4: stratified folds under three fixed seeds, long form."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return finish(repeated_stratified_kfold(lab, K, "y", [1, 2, 3]).select("id", "seed", "fold"))


FOLDS_REPEATED_SQL = " union all ".join(
    f"select id, cast({s} as bigint) seed, cast(fold as bigint) fold from ({kfold_sql('select doc_id id, quality y from labels', K, s, label='y')}) f{s}"
    for s in (1, 2, 3))


def folds_tuning_final(spark, sf_dir):
    """FO-5 / FO-1: cheap 3-fold column for tuning and a 5-fold column for the final fit."""
    app = applications(spark, sf_dir).where(F.col("split") == "train").select("id", TARGET)
    f = stratified_kfold(app, 3, TARGET, seed=SEED, out="fold_tune")
    f = stratified_kfold(f, 5, TARGET, seed=SEED, out="fold_final")
    f = kfold(f, 5, seed=SEED, out="fold_plain")
    return finish(f.select("id", "fold_tune", "fold_final", "fold_plain"))


_APP_TR = f"select id, {TARGET} from ({APPLICATIONS_SQL}) a where split = 'train'"
FOLDS_TUNING_FINAL_SQL = f"""select t.id, cast(t.fold as bigint) fold_tune, cast(f.fold as bigint) fold_final,
       cast(p.fold as bigint) fold_plain
from ({kfold_sql(_APP_TR, 3, SEED, label=TARGET)}) t
join ({kfold_sql(_APP_TR, 5, SEED, label=TARGET)}) f on f.id = t.id
join ({kfold_sql(_APP_TR, 5, SEED)}) p on p.id = t.id"""


# ---------------------------------------------------------------- meta features, scaling (SQL)

META = ["len", "wc", "lex_div", "char_entropy", "sent_var", "conn_density"]


def meta_features(df: DataFrame) -> DataFrame:
    """The reference's six per-document meta features (text -> numbers)."""
    # the characters are counted in batches, as arrays: sorting them in the row takes as long as all else
    rows = df.select("id", "answer", T.char_entropy(T.text_or_empty("answer")).alias("char_entropy"))
    f = TS.style_features(rows, "answer", ["id", "char_entropy"], ["lengths", "vocabulary", "sentences", "phrases"])
    return f.select("id", F.col("text_length").cast("double").alias("len"), F.col("word_count").cast("double").alias("wc"),
                    "lex_div", "char_entropy", F.col("sentence_length_variance").alias("sent_var"),
                    F.col("connector_density").alias("conn_density"))


def standardize_meta(spark, sf_dir):
    """SC-1: meta features standardised with train-only statistics (population std), applied to all docs."""
    docs = answers(spark, sf_dir)
    m = meta_features(docs).join(docs.select("id", "split"), "id")
    st = MO.standardize_fit(m.where(F.col("split") == "train"), META)
    return finish(MO.standardize_apply(m, st, META).select("id", *META))


def _meta_sql() -> str:
    return TOK + f""",
v as (select id, count(distinct w2) uniq from (select id, unnest(l) w2 from k) u group by id),
e as (select id, -sum(c / tot * log2(c / tot + 1e-12)) ent
      from (select id, ch, count(*) c, sum(count(*)) over (partition by id) tot
            from (select id, unnest(string_split(t, '')) ch from k) u where ch <> '' group by id, ch) z group by id),
m as (select k.id, cast(ln as double) len, cast(wc as double) wc,
             case when wc > 0 then coalesce(v.uniq, 0) / wc else 0e0 end lex_div, coalesce(e.ent, 0e0) char_entropy,
             case when ns > 1 then {pvar('sl')} else 0e0 end sent_var,
             ({' + '.join(f"cast(contains(lower(t), '{p}') as integer)" for p in TS.CONNECTORS)}) / greatest(wc, 1) conn_density
      from k left join v on v.id = k.id left join e on e.id = k.id)"""


STANDARDIZE_META_SQL = f"""{_meta_sql()},
tr as (select m.* from m join labels l on l.doc_id = m.id)
select m.id, {', '.join(r6(f'(m.{c} - (select avg({c}) from tr)) / coalesce(nullif((select stddev_pop({c}) from tr), 0), 1)') + f' {c}' for c in META)}
from m"""


# ---------------------------------------------------------------- vectors (SQL)

def embedding_means(spark, sf_dir):
    """VE-1: element-wise mean of the embedding vectors per label (long form label, pos, mean)."""
    e = table(spark, sf_dir, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    return finish(long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean")))


EMBEDDING_MEANS_SQL = f"""select cast(label as bigint) label, pos, {r6('avg(cast(x as double))')} mean from (
  select label, unnest(range(len(embedding))) pos, unnest(embedding) x from embeddings) u group by label, pos"""


def embedding_lookup(spark, sf_dir):
    """VE-2 / IO-8 / J-4: vectors attached to all documents by id; ``has_vector`` is the completeness check that the
    strict form (``strict_lookup``, which raises) makes of it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("ext_emb"))
    out = docs.join(vec, "id", "left")
    return finish(out.select("id", "n_chars", F.col("ext_emb").isNotNull().alias("has_vector"),
                             F.when(F.col("ext_emb").isNotNull(), F.size("ext_emb")).alias("dims"),
                             F.aggregate("ext_emb", F.lit(0.0), lambda a, x: a + x).alias("emb_sum")))


EMBEDDING_LOOKUP_SQL = f"""select d.doc_id id, d.n_chars, e.vec_id is not null has_vector, cast(len(e.embedding) as bigint) dims,
       {r6('list_sum(list_transform(e.embedding, lambda x: cast(x as double)))')} emb_sum
from documents d left join embeddings e on e.vec_id = d.doc_id"""


EMB_DIMS = 64  # of the table's vectors


def embedding_features(spark, sf_dir):
    """VE-2 / IO-8 / J-4: length features of the documents that have a vector, and the vector's components beside them, by the
    strict lookup (it raises if one of these ids has none)."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    feats = TS.style_features(docs.join(vec.select("id"), "id", "left_semi"), "answer", ["id"], ["lengths"]).select("id", "text_length", "word_count")
    out = strict_lookup(feats, vec)
    return finish(out.select("id", "text_length", "word_count", *[F.col("ext_emb")[k].cast("double").alias(f"ext_{k}") for k in range(EMB_DIMS)]))


EMBEDDING_FEATURES_SQL = f"""{TOK}
select k.id, k.ln text_length, k.wc word_count, {', '.join(f'round(cast(e.embedding[{j + 1}] as double), 6) ext_{j}' for j in range(EMB_DIMS))}
from k join embeddings e on e.vec_id = k.id"""


# ---------------------------------------------------------------- selection (SQL)

def mi_screen(spark, sf_dir):
    """FS-1 / T-3: mutual information (32 quantile bins) of each meta feature with the label; keep the top k."""
    lab = _labelled(spark, sf_dir)
    m = meta_features(lab).join(lab.select("id", F.col("is_cheating").alias("y")), "id")
    return finish(SE.mi_screen(m, META, "y", bins=32, ratio=0.7, min_keep=4))


def _mi_sql() -> str:
    unp = f"unpivot (select id, y, {', '.join(META)} from mm) on {', '.join(META)} into name feature value v"
    return f"""{_meta_sql()},
mm as (select m.*, l.quality y from m join labels l on l.doc_id = m.id),
u as ({unp}),
b as (select feature, y, cast(floor((rank() over (partition by feature order by v) - 1) * 32 / count(*) over (partition by feature)) as bigint) bin
      from u),
j as (select feature, bin, y, count(*) c from b group by all),
tot as (select feature, sum(c) n from j group by feature),
pb as (select feature, bin, sum(c) c from j group by all),
py as (select feature, y, sum(c) c from j group by all),
mi as (select j.feature, sum(j.c / tot.n * ln((j.c / tot.n) / ((pb.c / tot.n) * (py.c / tot.n)))) mi
       from j join tot on tot.feature = j.feature join pb on pb.feature = j.feature and pb.bin = j.bin
       join py on py.feature = j.feature and py.y = j.y group by j.feature)"""


MI_SCREEN_SQL = f"""{_mi_sql()}
select feature, {r6('mi')} mi, rank, rank <= {max(4, int(0.7 * len(META)))} keep from (
  select feature, mi, row_number() over (order by mi desc, feature) rank from mi) r"""


# ---------------------------------------------------------------- lexicon and inputs (SQL)

LEXICON_MIN_DOCS = 5
# Words and polarities that a caller might hand over.
CALLER_LEXICON = [(w, math.sin(k + 1)) for k, w in enumerate(["with", "this", "the", "for", "und", "les", "que", "de"])]


def text_lexicon(spark, sf_dir):
    """TX-17 re-aimed: polarity of a word = 2 * mean label of the labelled documents holding it - 1, learned from the other
    folds for a labelled document and from all for the others (words in >= 5 such documents)."""
    docs = TF.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer")))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    folds = materialize(stratified_kfold(lab, K, "y", seed=SEED).select("id", "y", "fold"))
    out = LX.learned_scores(docs.join(folds, "id", "left"), "answer", "y", "fold", K, LEXICON_MIN_DOCS)
    return finish(out.select("id", "sentiment_polarity", "sentiment_subjectivity"))


TEXT_LEXICON_SQL = f"""with {TOK.strip()[5:]},
f as ({kfold_sql('select doc_id id, quality y from labels', K, SEED, label='y')}),
dt as (select u.id, w2 term, count(*) tf, any_value(f.fold) fold, any_value(f.y) y
       from (select id, unnest(l) w2 from k) u left join f on f.id = u.id group by u.id, w2),
parts as (select distinct fold part from f union all select null),
lex as (select parts.part, dt.term, 2 * avg(dt.y) - 1 polarity from parts join dt on dt.y is not null and dt.fold is distinct from parts.part
        group by parts.part, dt.term having count(*) >= {LEXICON_MIN_DOCS}),
s as (select id, sum(tf * polarity) / sum(tf) pol, sum(tf * abs(polarity)) / sum(tf) subj
      from dt join lex on lex.term = dt.term and lex.part is not distinct from dt.fold group by id)
select k.id, {r6('coalesce(pol, 0e0)')} sentiment_polarity, {r6('coalesce(subj, 0e0)')} sentiment_subjectivity
from k left join s on s.id = k.id"""


def text_lexicon_table(spark, sf_dir):
    """TX-17 with a caller's lexicon."""
    docs = TF.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer")))
    out = LX.scores(docs, "answer", spark.createDataFrame(CALLER_LEXICON, "term string, polarity double"))
    return finish(out.select("id", "sentiment_polarity", "sentiment_subjectivity"))


TEXT_LEXICON_TABLE_SQL = f"""with {TOK.strip()[5:]},
lex(term, polarity) as (values {', '.join(f"('{w}', {x!r}e0)" for w, x in CALLER_LEXICON)}),
s as (select id, avg(polarity) pol, avg(abs(polarity)) subj from (select id, unnest(l) term from k) u join lex using (term) group by id)
select k.id, {r6('coalesce(pol, 0e0)')} sentiment_polarity, {r6('coalesce(subj, 0e0)')} sentiment_subjectivity
from k left join s on s.id = k.id"""


# The prompt's words.
PROMPT = ("Predict if AI generated text was used:\nTopic:", "\nAnswer:")


def strip(c):
    """Without white space at either end."""
    return F.regexp_replace(c, f"^[{WS_BODY}]+|[{WS_BODY}]+$", "")


def joined_text(df, topic="topic", answer="answer"):
    """P-1: topic and answer, null as empty, joined by a space; all white space at the edges removed."""
    return strip(F.concat_ws(" ", strip(F.coalesce(topic, F.lit(""))), strip(F.coalesce(answer, F.lit("")))))


def text_inputs(spark, sf_dir):
    """P-1 / P-2: joined text and the three-line prompt; null is empty text in both."""
    a = answers(spark, sf_dir)
    prompt = F.concat(F.lit(PROMPT[0]), F.coalesce("topic", F.lit("")), F.lit(PROMPT[1]), F.coalesce("answer", F.lit("")))
    return finish(a.select("id", joined_text(a).alias("text"), prompt.alias("prompt")))


def _strip_sql(x):
    return f"regexp_replace({x}, '^[{WS_BODY}]+|[{WS_BODY}]+$', '', 'g')"


TEXT_INPUTS_SQL = f"""select id,
       {_strip_sql("concat_ws(' ', " + _strip_sql("coalesce(topic, '')") + ", " + _strip_sql("coalesce(answer, '')") + ")")} "text",
       'Predict if AI generated text was used:' || chr(10) || 'Topic:' || coalesce(topic, '') || chr(10) || 'Answer:' || coalesce(answer, '') prompt
from ({ANSWERS_SQL}) a"""


# ---------------------------------------------------------------- importance roll-up (SQL)

def importance_rollup(spark, sf_dir):
    """ME-8 / A-4 / T-2: univariate importance of each numeric loan column per (seed, fold) as
    |AUC - 0.5| on the fold's rows, rolled up over seeds and folds; top 25 ranked; flag the
    interest-related group."""
    app = applications(spark, sf_dir).where(F.col("split") == "train").select("id", TARGET, *NUMERIC)
    f = repeated_stratified_kfold(app, K, TARGET, [1, 2])
    long = f.select("seed", "fold", TARGET, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in NUMERIC])).alias("_e")) \
        .select("seed", "fold", TARGET, "_e.*")
    a = auc(long, "v", TARGET, by=["feature", "seed", "fold"])
    imp = a.select("feature", "seed", "fold", F.abs(F.col("auc") - F.lit(0.5)).alias("gain"))
    return finish(PR.importance_rollup(imp, top=25, group=["interest_rate", "debt_to_income_ratio"]))


_RF = " union all ".join(
    f"select id, {TARGET}, {', '.join(NUMERIC)}, cast({s} as integer) seed, fold from ({kfold_sql(f'select id, {TARGET}, ' + ', '.join(NUMERIC) + f' from ({APPLICATIONS_SQL}) a where split = ' + chr(39) + 'train' + chr(39), K, s, label=TARGET)}) r{s}"
    for s in (1, 2))
_IMP_SRC = f"unpivot (select seed, fold, {TARGET}, {', '.join(f'cast({c} as double) {c}' for c in NUMERIC)} from ({_RF}) z) on {', '.join(NUMERIC)} into name feature value v"
IMPORTANCE_ROLLUP_SQL = f"""with imp as (select feature, seed, fold, abs(auc - 0.5e0) gain from ({auc_sql(_IMP_SRC, 'v', TARGET, ['feature', 'seed', 'fold'])}) a),
agg as (select feature, avg(gain) mean_gain, median(gain) median_gain, sum(gain) sum_gain, count(*) n from imp group by feature)
select feature, {r6('mean_gain')} mean_gain, {r6('median_gain')} median_gain, {r6('sum_gain')} sum_gain, n,
       row_number() over (order by mean_gain desc, feature) rank,
       feature in ('interest_rate', 'debt_to_income_ratio') in_group
from agg order by mean_gain desc, feature limit 25"""


# ---------------------------------------------------------------- learned models (rows-only)

def _text_model_frame(spark, sf_dir):
    a = answers(spark, sf_dir)
    # written: a filter on the split would not reach the texts, and each part would make the features of all documents
    m = materialize(meta_features(a).join(a.select("id", "split", F.col("is_cheating").alias("y")), "id"))
    # features feed k fits (and trials): computed once, lineage cut
    return materialize(stratified_kfold(m.where(F.col("split") == "train"), K, "y", seed=SEED)), m.where(F.col("split") == "test")


def cv_logistic_meta(spark, sf_dir):
    """ML-1 / ML-5 / SC-1: 5-fold OOF logistic regression (C = 0.5) on standardised meta features."""
    tr, te = _text_model_frame(spark, sf_dir)
    out = MO.cv_oof(tr, te, META, "y", "fold", lambda d: MO.logistic(0.5, d.count()), standardize=True)
    return finish(out)


def cv_forest_meta(spark, sf_dir):
    """ML-2: random forest of the reference's 300 trees, OOF + test."""
    tr, te = _text_model_frame(spark, sf_dir)
    return finish(MO.cv_oof(tr, te, META, "y", "fold", lambda d: MO.random_forest(SEED)))


def _tab_frame(spark, sf_dir):
    app = applications(spark, sf_dir).where(F.col("split") != "orig")
    # written: read by the codes and by both parts, each of which would join the tables and fold the lines again
    app = materialize(app.withColumn("_split_rank", F.when(F.col("split") == "train", 0).otherwise(1)))
    app = factorize(app, CATS, ["_split_rank", "id"])
    tr = stratified_kfold(app.where(F.col("split") == "train"), K, TARGET, seed=SEED)
    te = app.where(F.col("split") == "test")
    return materialize(tr), materialize(te)


def cv_gbt_tabular(spark, sf_dir):
    """ML-3 / ML-4: boosted trees, the reference's rounds with early stopping on the validation fold, balanced class weights."""
    tr, te = _tab_frame(spark, sf_dir)
    out = MO.cv_oof(tr, te, NUMERIC + CATS, TARGET, "fold",
                    lambda d: MO.gbt(SEED, weight_col="w"), early_stopping=MO.PATIENCE, balance_col="w", parallel=K)
    return finish(out)


STACKED = ["p_1", "p_2", "p_3"]


def stack_scores(spark, sf_dir):
    """BL-7 / BL-8 / BL-9 for labelled and test documents: the logistic stacker, the best linear blend, the one of them that is
    used (the stacker if its AUC beats the blend's), and the calibrated per-fold stacker. ``auc_cross`` is the stacker's AUC when
    each fold is scored by the others."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    folds = stratified_kfold(lab, K, "y", seed=SEED).select("id", "fold")
    wide = materialize(BL.wide_scores(scores(spark, sf_dir), [1, 2, 3]).join(folds, "id"))
    test = materialize(BL.wide_scores(test_scores(spark, sf_dir), [1, 2, 3], keep=()))
    every = wide.select("id", F.lit("oof").alias("role"), *STACKED).unionByName(test.select("id", F.lit("test").alias("role"), *STACKED))
    scored, auc_stack = MO.stacker(wide, STACKED, apply_to=every)
    crossed = MO.cv_oof(wide, None, STACKED, "y", "fold", lambda d: MO.logistic(1.0, d.count()))
    auc_cross = auc(crossed.join(wide.select("id", "y"), "id"), "p", "y").first()["auc"]
    best = BL.best_weight(BL.weight_search(wide, "p_3", "p_2")).first()
    blend = F.lit(best["best_w"]) * F.col("p_3") + F.lit(1.0 - best["best_w"]) * F.col("p_2")
    use = bool(auc_stack > best["best_auc"])
    cal = MO.calibrated_stacker(wide, STACKED, "fold", apply_to=every)
    out = scored.select("id", "role", "p_stack", blend.alias("p_blend")).join(cal, "id")
    return finish(out.select("id", "role", "p_stack", "p_blend", F.col("p_stack" if use else "p_blend").alias("p_final"), "p_cal",
                             F.lit(use).alias("use_stacker"), F.lit(float(auc_stack)).alias("auc_stack"),
                             F.lit(float(best["best_auc"])).alias("auc_blend"), F.lit(float(auc_cross)).alias("auc_cross")))


def permutation_importance_gbt(spark, sf_dir):
    """ME-9: AUC drop per permuted column for a boosted-tree model fitted on the train split."""
    tr, _ = _tab_frame(spark, sf_dir)
    d = tr.withColumn("label", F.col(TARGET).cast("double"))
    model = MO.gbt(SEED, max_iter=10).fit(MO.assemble(d, NUMERIC + CATS))
    return finish(MO.permutation_importance(model, d, NUMERIC + CATS, TARGET))


def pseudo_refit(spark, sf_dir):
    """PP-3: refit the meta-feature logistic model with pseudo-labelled test rows (weighted), blend the
    new test scores with ratio min(.3, n_pseudo / n_test)."""
    tr, te = _text_model_frame(spark, sf_dir)
    base = MO.cv_oof(tr, te, META, "y", "fold", lambda d: MO.logistic(0.5, d.count()), standardize=True)
    test_p = base.where(F.col("role") == "test").groupBy("id").agg(F.avg("p").alias("p"))
    pl = PP.pseudo_labels(tr.select("id", "y"), test_p)
    feats = tr.select("id", *META).unionByName(te.select("id", *META))
    fit = pl.join(feats, "id").withColumn("label", F.col("y").cast("double"))
    st = MO.standardize_fit(tr, META)
    fit = MO.standardize_apply(fit, st, META)
    model = MO.logistic(0.5, fit.count(), weight_col="weight").fit(MO.assemble(fit, META))
    te_s = model.transform(MO.assemble(MO.standardize_apply(te, st, META), META)).select("id", MO.p1().alias("p_pseudo"))
    n_pseudo = pl.where(F.col("source") == "pseudo").count()
    ratio = min(0.3, n_pseudo / max(te.count(), 1))
    out = test_p.join(te_s, "id").withColumn(
        "p_final", F.col("p") * F.lit(1 - ratio) + F.col("p_pseudo") * F.lit(ratio))
    return finish(out)


SPACE = {"reg": ("loguniform", 1e-4, 1.0), "enet": ("uniform", 0.0, 1.0), "iters": ("quniform", 20, 100, 10)}
TRIALS = 40  # the reference's number
PARALLEL_TRIALS = 8


def hp_search(spark, sf_dir):
    """HP-1 / HP-2 / A-10: seeded random trials of a logistic model on meta features, scored by the penalised objective
    by fold AUCs (mean - 0.5 * std); returns every trial and flags the best. A few trials run at a time on one written frame."""
    tr, _ = _text_model_frame(spark, sf_dir)
    tr = materialize(MO.assemble(MO.standardize_apply(tr, MO.standardize_fit(tr, META), META), META).select("id", "y", "fold", MO.FEATURES))
    trials = MO.draw_trials(spark, TRIALS, SPACE, seed=SEED).collect()  # n_trials rows

    def evaluate(t):
        def make(_):
            return LogisticRegression(featuresCol=MO.FEATURES, labelCol="label", regParam=float(t["reg"]),
                                      elasticNetParam=float(t["enet"]), maxIter=int(t["iters"]))
        oof = MO.cv_oof_rows(lambda k: tr.where(F.col("fold") != k).withColumn("label", F.col("y").cast("double")),
                             lambda k: tr.where(F.col("fold") == k).withColumn("role", F.lit("oof")), range(K), make, keep=["y"])
        return [(t["trial"], r["fold"], float(r["auc"])) for r in auc(oof, "p", "y", by=["fold"]).collect()]  # folds rows

    rows = [r for one in MO.run_trials(spark, trials, evaluate, PARALLEL_TRIALS) for r in one]
    obj = PR.penalised_objective(spark.createDataFrame(rows, "trial long, fold int, auc double"))
    best = obj.agg(F.max_by("trial", "score").alias("best_trial"))
    return finish(obj.crossJoin(best))  # one row


def _draw_sql(name: str, spec: tuple) -> str:
    u = unit_uniform_sql(f"md5(concat('{SEED}', '|', trial, '|', '{name}'))")
    kind, lo, hi = spec[:3]
    if kind == "loguniform":
        return r6(f"exp({u} * {math.log(hi) - math.log(lo)!r}e0 + {math.log(lo)!r}e0)") + f" {name}"
    v = f"({u} * {float(hi - lo)!r}e0 + {float(lo)!r}e0)"
    return r6(f"round_even({v} / {float(spec[3])!r}e0, 0) * {float(spec[3])!r}e0" if kind == "quniform" else v) + f" {name}"


# The reference's search space and number of trials.
BOOSTER_SPACE = {
    "n_estimators": ("quniform", 500, 1600, 50), "learning_rate": ("loguniform", 0.015, 0.08), "max_depth": ("quniform", 3, 6, 1),
    "num_leaves": ("quniform", 15, 63, 2), "min_child_samples": ("quniform", 20, 90, 5), "min_gain_to_split": ("loguniform", 1e-4, 5e-2),
    "subsample": ("uniform", 0.6, 0.95), "colsample_bytree": ("uniform", 0.5, 0.9), "reg_alpha": ("uniform", 0.0, 1.0),
    "reg_lambda": ("uniform", 0.0, 1.0)}
BOOSTER_TRIALS = 40


def hp_draws(spark, sf_dir):
    """HP-1: the trials of the booster space, one row each, with the classes of the table they are to be judged on."""
    n = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quality").alias("n_positive"))
    return finish(MO.draw_trials(spark, BOOSTER_TRIALS, BOOSTER_SPACE, seed=SEED).crossJoin(n))  # one row


HP_DRAWS_SQL = f"""select trial, {', '.join(_draw_sql(k, v) for k, v in BOOSTER_SPACE.items())},
       (select count(*) from labels) n_rows, (select cast(sum(quality) as bigint) from labels) n_positive
from (select range trial from range({BOOSTER_TRIALS})) t"""


SVD_WORD = dict(components=384, n=(1, 3), max_features=3000, min_df=2, max_df=0.95)
SVD_CHAR = dict(components=192, n=(3, 5), max_features=2000, min_df=2, max_df=1.0)


def svd_tfidf(spark, sf_dir):
    """SV-1: truncated SVD of the word and the character TF-IDF, both fitted on the labelled documents; one row per
    document, zero in a space where it has no vocabulary term."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("_fit", F.lit(True))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    docs = lookup_join(docs, labels, "id", "left")  # the texts stay where they are while the labels fit the bound
    text = F.coalesce(F.col("answer"), F.lit(""))
    spaces = (("wsvd", SVD_WORD, TR.Analyzer("words", *SVD_WORD["n"], TF.english_stop_words())),
              ("csvd", SVD_CHAR, TR.Analyzer("chars", *SVD_CHAR["n"])))
    vocabs = [TR.fit(docs.where("_fit"), text, a, min_df=p["min_df"], max_df=p["max_df"], max_features=p["max_features"]) for _, p, a in spaces]
    blocks = materialize(TR.hit_blocks(docs, text, vocabs, "id", F.col("_fit")))
    vectors = LR.svd_fit(blocks, vocabs, [p["components"] for _, p, _ in spaces])
    return finish(LR.svd_project(blocks, vocabs, vectors, [n for n, _, _ in spaces]))
