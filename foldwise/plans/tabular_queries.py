"""Tabular queries over the ``applications`` view (TB-*, TE-*, W-2, J-*) with DuckDB oracles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import tabular as TB
from ..operators.fold_aggs import AGGS, target_encode_aggs
from ..operators.folds import kfold, kfold_sql, stratified_kfold
from ..operators.nested_encode import target_encode_roles
from ..session import materialize
from ..sources.views import APPLICATIONS_SQL, BASE, CATS, TARGET, applications
from .common import finish, r6

K_INNER = 5
K_OUTER = 5
SEED = 42
INTER = TB.interaction_columns(BASE)
ROUND = TB.round_columns()
DIGIT = TB.digit_columns()
BASE_TE_COL = ["debt_to_income_ratio", "credit_score"] + ROUND + DIGIT


def _app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications(spark, sf_dir)


def tab_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(TB.digits(_app(spark, sf_dir)).select("id", *DIGIT))


def tab_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(TB.rounding(_app(spark, sf_dir)).select("id", *ROUND))


def tab_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(TB.interactions(_app(spark, sf_dir), BASE).select("id", *INTER))


def tab_orig_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = _app(spark, sf_dir)
    rows = app.where(F.col("split") != "orig")
    orig = app.where(F.col("split") == "orig")
    out = TB.external_encodings(rows, orig, BASE, TARGET)
    cols = [f"orig_{s}_{c}" for c in BASE for s in ("mean", "count")]
    return finish(out.select("id", *cols))


def tab_ratio_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TB.credit_band(TB.ratio_features(_app(spark, sf_dir)))
    return finish(out.select("id", "loan_to_income", "log_annual_income", "log_loan_amount", "dti_x_interest",
                             "credit_score_band"))


ENCODED = INTER + BASE_TE_COL  # stage 1: the interactions, whose originals go; stage 2: the others, kept


def _features(rows: DataFrame) -> DataFrame:
    return TB.interactions(TB.rounding(TB.digits(rows)), BASE)


def _with_folds(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows with their folds, test rows with null folds: one written table of the base columns."""
    return materialize(train.unionByName(test, allowMissingColumns=True))


def te_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TE-5: both stages share one inner fold column, so their 75 columns are one aggregate; train and test rows."""
    app = _app(spark, sf_dir)
    rows = _with_folds(kfold(app.where(F.col("split") == "train"), K_INNER, SEED), app.where(F.col("split") == "test"))
    return finish(target_encode_roles(_features(rows), ENCODED, TARGET, "fold"))


def te_oof_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TE-3 with the other aggregates, of the credit score by the categorical columns."""
    app = _app(spark, sf_dir)
    rows = materialize(kfold(app.where(F.col("split") == "train"), K_INNER, SEED).select("id", "credit_score", *CATS, "fold"))
    out = target_encode_aggs(rows, CATS, "credit_score", "fold", K_INNER)
    return finish(out.select("id", *[f"TE_{c}_{a}" for c in CATS for a in AGGS]))


def te_fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TE-1/TE-2: fit on the train split (mean and count), look up for the test split."""
    app = _app(spark, sf_dir)
    train, test = app.where(F.col("split") == "train"), app.where(F.col("split") == "test")
    mapping, globals_ = E.te_fit(train, CATS, TARGET, ["mean", "count"])
    out = E.te_transform(test, mapping, globals_, CATS, ["mean", "count"])
    return finish(out.select("id", *[f"TE_{c}_{a}" for c in CATS for a in ("mean", "count")]))


def te_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TE-6: both stages inside each outer stratified fold, one global inner fold column; train, validation and test rows."""
    app = _app(spark, sf_dir)
    train = stratified_kfold(app.where(F.col("split") == "train"), K_OUTER, TARGET, seed=SEED, out="outer")
    rows = _with_folds(kfold(train, K_INNER, seed=SEED + 1, out="inner"), app.where(F.col("split") == "test"))
    return finish(target_encode_roles(_features(rows), ENCODED, TARGET, "inner", "outer"))


def factorize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-2: first-appearance codes over train then test (by id)."""
    app = _app(spark, sf_dir).where(F.col("split") != "orig")
    app = app.withColumn("_split_rank", F.when(F.col("split") == "train", 0).otherwise(1))
    out = E.factorize(app, CATS, ["_split_rank", "id"], suffix="_code")
    return finish(out.select("id", *[f"{c}_code" for c in CATS]))


# ------------------------------------------------------------------ oracle SQL

APP = f"app as ({APPLICATIONS_SQL})"


def _digit_sql() -> str:
    out = []
    for c, (mult, width) in TB.DIGIT_SPEC.items():
        v = c if mult is None else f"round_even({c} * {mult}, 0)"
        s = f"lpad(cast(cast({v} as bigint) as varchar), {width}, '0')"
        out += [f"cast(substr({s}, {i + 1}, 1) as bigint) {c}_DIGIT_{i + 1}" for i in range(width)]
    return ", ".join(out)


def _round_sql() -> str:
    return ", ".join(f"cast(round_even({c}, {lvl}) as bigint) {c}_ROUND_{s}"
                     for c in TB.ROUND_COLS for s, lvl in TB.ROUND_LEVELS.items())


def _inter_sql() -> str:
    return ", ".join(f"coalesce(cast({a} as varchar), 'nan') || '_' || coalesce(cast({b} as varchar), 'nan') {a}_{b}"
                     for a, b in combinations(BASE, 2))


TAB_DIGITS_SQL = f"with {APP} select id, {_digit_sql()} from app"
TAB_ROUNDING_SQL = f"with {APP} select id, {_round_sql()} from app"
TAB_INTERACTIONS_SQL = f"with {APP} select id, {_inter_sql()} from app"

_ORIG_COLS = []
for _c in BASE:
    _ORIG_COLS.append(f"{r6(f'coalesce((select avg({TARGET}) from o where o.{_c} = r.{_c}), (select avg({TARGET}) from o))')} orig_mean_{_c}")
    _ORIG_COLS.append(f"{r6(f'coalesce((select nullif(count(*), 0) from o where o.{_c} = r.{_c}), (select avg({TARGET}) from o))')} orig_count_{_c}")
TAB_ORIG_ENCODINGS_SQL = (f"with {APP}, o as (select * from app where split = 'orig'), r as (select * from app where split <> 'orig') "
                          f"select id, {', '.join(_ORIG_COLS)} from r")

TAB_RATIO_BAND_SQL = f"""with {APP}
select id, {r6('loan_amount / (annual_income + 1e0)')} loan_to_income, {r6('ln(1 + annual_income)')} log_annual_income,
       {r6('ln(1 + loan_amount)')} log_loan_amount, {r6('debt_to_income_ratio * interest_rate')} dti_x_interest,
       case when credit_score >= 0 and credit_score <= 580 then 'very_low'
            when credit_score > 580 and credit_score <= 640 then 'low'
            when credit_score > 640 and credit_score <= 700 then 'fair'
            when credit_score > 700 and credit_score <= 760 then 'good'
            when credit_score > 760 and credit_score <= 900 then 'excellent' end credit_score_band
from app"""

_FEATURES = f"select *, {_digit_sql()}, {_round_sql()}, {_inter_sql()}"
FEATS = f"""{APP},
feats as ({_FEATURES} from app where split = 'train'),
tests as ({_FEATURES} from app where split = 'test')"""


def _wide(cols: list[str], value: str = "te") -> str:
    """One output column per encoded column (a pivot over the data could not be a view)."""
    return ", ".join(f"max(round({value}, 6)) filter (where col = '{c}') TE_{c}_mean" for c in cols)


def te_oof_long_sql(src: str, cols: list[str], y: str, fold: str) -> str:
    """Independent DuckDB TE-3/TE-4 for many columns: unpivot, re-aggregate the other folds per excluded fold."""
    casts = ", ".join(f"cast({c} as varchar) {c}" for c in cols)
    return f"""x as (select id, {fold} fold, {y} y, {casts} from {src}),
u as (from x unpivot include nulls (key for col in ({', '.join(cols)}))),
ks as (select distinct fold from x),
tp as (select ks.fold kf, u.col, u.key, count(*) n, avg(u.y) mu, var_samp(u.y) v
       from ks join u on u.fold <> ks.fold where u.key is not null group by all),
g as (select ks.fold kf, avg(x.y) g from ks join x on x.fold <> ks.fold group by ks.fold),
m as (select kf, col, case when var_samp(mu) > 0 then avg(v) / greatest(var_samp(mu), 1e-9) else 0e0 end m
      from tp group by kf, col),
enc as (select u.id, u.col, coalesce((tp.n * tp.mu + m.m * g.g) / (tp.n + m.m), g.g) te
        from u join g on g.kf = u.fold left join m on m.kf = u.fold and m.col = u.col
        left join tp on tp.kf = u.fold and tp.col = u.col and tp.key = u.key)"""


_CASTS = ", ".join(f"cast({c} as varchar) {c}" for c in ENCODED)
TE_TWO_STAGE_SQL = f"""with {FEATS},
f as ({kfold_sql('select * from feats', K_INNER, SEED)}),
{te_oof_long_sql('f', ENCODED, TARGET, 'fold')},
mp as (select col, key, avg(y) mu from u group by all),
xt as (select id, {_CASTS} from tests),
ut as (from xt unpivot include nulls (key for col in ({', '.join(ENCODED)}))),
enc_test as (select ut.id, ut.col, coalesce(mp.mu, (select avg(y) from x)) te
             from ut left join mp on mp.col = ut.col and mp.key = ut.key),
every as (select id, 'train' role, col, te from enc union all select id, 'test' role, col, te from enc_test)
select id, role, {_wide(ENCODED)} from every group by id, role"""

_AGG_SQL = {"count": "count(y)::double", "sum": "sum(y)::double", "mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)::double",
            "max": "max(y)::double", "median": "median(y)"}
_AGG_LIST = ", ".join(f"{e} {a}" for a, e in _AGG_SQL.items())
TE_OOF_AGGS_SQL = f"""with {APP},
f as ({kfold_sql("select id, credit_score, " + ", ".join(CATS) + " from app where split = 'train'", K_INNER, SEED)}),
x as (select id, fold, credit_score y, {', '.join(f'cast({c} as varchar) {c}' for c in CATS)} from f),
u as (from x unpivot include nulls (key for col in ({', '.join(CATS)}))),
ks as (select distinct fold k from x),
tp as (select ks.k, col, key, {_AGG_LIST} from ks join u on u.fold <> ks.k where key is not null group by ks.k, col, key),
g as (select ks.k, {_AGG_LIST} from ks join x on x.fold <> ks.k group by ks.k),
e as (select u.id, u.col, {', '.join(f'coalesce(tp.{a}, g.{a}) v_{a}' for a in _AGG_SQL)}
      from u join g on g.k = u.fold left join tp on tp.k = u.fold and tp.col = u.col and tp.key = u.key)
select id, {', '.join(f"max(round(v_{a}, 6)) filter (where col = '{c}') TE_{c}_{a}" for c in CATS for a in _AGG_SQL)} from e group by id"""

_FT = []
for _c in CATS:
    _FT.append(f"{r6(f'coalesce((select avg({TARGET}) from tr where tr.{_c} = te.{_c}), (select avg({TARGET}) from tr))')} TE_{_c}_mean")
    _FT.append(f"{r6(f'coalesce((select nullif(count(*), 0) from tr where tr.{_c} = te.{_c}), (select count(*) from tr))')} TE_{_c}_count")
TE_FIT_TRANSFORM_SQL = (f"with {APP}, tr as (select * from app where split = 'train'), te as (select * from app where split = 'test') "
                        f"select id, {', '.join(_FT)} from te")

_NEST_TRAIN = kfold_sql(kfold_sql('select * from feats', K_OUTER, SEED, label=TARGET, out="ofold"),
                        K_INNER, SEED + 1, out="ifold")
TE_NESTED_SQL = f"""with {FEATS},
nt as (select * from ({_NEST_TRAIN}) z),
os as (select distinct ofold o from nt),
xc as (select id, ofold, ifold, {TARGET} y, {_CASTS} from nt),
u as (from xc unpivot include nulls (key for col in ({', '.join(ENCODED)}))),
-- train role: rows with ofold <> o, leave-ifold-fold-out over the ofold train part
ut as (select os.o, u.* from os join u on u.ofold <> os.o),
ks as (select distinct o, ifold k from ut),
tp as (select ks.o, ks.k, ut.col, ut.key, count(*) n, avg(ut.y) mu, var_samp(ut.y) v
       from ks join ut on ut.o = ks.o and ut.ifold <> ks.k where ut.key is not null group by all),
g as (select ks.o, ks.k, avg(nt.{TARGET}) g from ks join nt on nt.ofold <> ks.o and nt.ifold <> ks.k group by ks.o, ks.k),
m as (select o, k, col, case when var_samp(mu) > 0 then avg(v) / greatest(var_samp(mu), 1e-9) else 0e0 end m
      from tp group by o, k, col),
enc_t as (select ut.o, ut.id, 'train' role, ut.col, coalesce((tp.n * tp.mu + m.m * g.g) / (tp.n + m.m), g.g) te
          from ut join g on g.o = ut.o and g.k = ut.ifold left join m on m.o = ut.o and m.k = ut.ifold and m.col = ut.col
          left join tp on tp.o = ut.o and tp.k = ut.ifold and tp.col = ut.col and tp.key = ut.key),
-- validation and test roles: plain mean over the whole ofold train part
mp as (select o, col, key, avg(y) mu from ut group by all),
gv as (select os.o, avg(nt.{TARGET}) g from os join nt on nt.ofold <> os.o group by os.o),
xt as (select id, {_CASTS} from tests),
utest as (from xt unpivot include nulls (key for col in ({', '.join(ENCODED)}))),
others as (select ofold o, id, 'valid' role, col, key from u union all select os.o, id, 'test' role, col, key from os join utest on true),
enc_v as (select x.o, x.id, x.role, x.col, coalesce(mp.mu, gv.g) te
          from others x join gv on gv.o = x.o left join mp on mp.o = x.o and mp.col = x.col and mp.key = x.key),
enc as (select * from enc_t union all select * from enc_v)
select id, o outer_fold, role, {_wide(ENCODED)} from enc group by id, o, role"""

FACTORIZE_CODES_SQL = f"""with {APP},
r as (select *, row_number() over (order by case when split = 'train' then 0 else 1 end, id) pos
      from app where split <> 'orig')
select id, {', '.join(f"(select c from (select {c} v, dense_rank() over (order by min(pos)) - 1 c from r group by {c}) q where q.v = r.{c}) {c}_code" for c in CATS)}
from r"""
