"""Adapters from the test tables to the reference's input schemas.

``answers``       text train/test table  (id, topic, answer, lang, is_cheating, split)
``applications``  loans table            (id, 11 base columns, loan_paid_back, split)
``scores``        long model-score table (id, model, y, p)

Each view has a DataFrame builder and the equivalent DuckDB SQL text used by
the oracle (``*_SQL``), so every derived query can be checked end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

TARGET = "loan_paid_back"
NUMERIC = ["annual_income", "debt_to_income_ratio", "credit_score", "loan_amount", "interest_rate"]
CATS = ["gender", "marital_status", "education_level", "employment_status", "loan_purpose", "grade_subgrade"]
# BASE = every column but id and target, in table order (P-5)
BASE = NUMERIC + CATS


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("topic"),
            F.col("text").alias("answer"),
            "lang",
            F.col("quality").alias("is_cheating"),
            F.when(F.col("quality").isNull(), F.lit("test")).otherwise(F.lit("train")).alias("split"),
        )
    )


ANSWERS_SQL = """
select d.doc_id id, d.source topic, d.text answer, d.lang, l.quality is_cheating,
       case when l.doc_id is null then 'test' else 'train' end split
from documents d left join labels l on d.doc_id = l.doc_id
"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; lineitem is folded with order-free min/max only."""
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.max("l_extendedprice").alias("inc"),
            F.max("l_discount").alias("dti"),
            F.max("l_tax").alias("tax"),
            F.max("l_quantity").alias("q"),
            # min of a string is a sort-based aggregate; the min of the (tiny) set of distinct
            # values per order is the same value and stays hash-based with partial aggregation
            F.array_min(F.collect_set("l_linestatus")).alias("ls"),
            F.array_min(F.collect_set("l_returnflag")).alias("rf"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast is bounded.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    j = (
        orders.join(li, li.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("inc").alias("annual_income"),
        F.col("dti").alias("debt_to_income_ratio"),
        (F.lit(300) + F.lit(10) * F.col("q")).cast("int").alias("credit_score"),
        F.col("o_totalprice").alias("loan_amount"),
        F.round(F.col("tax") * 100, 2).alias("interest_rate"),
        F.col("ls").alias("gender"),
        F.col("rf").alias("marital_status"),
        F.col("r_name").alias("education_level"),
        F.col("n_name").alias("employment_status"),
        F.col("c_mktsegment").alias("loan_purpose"),
        F.col("o_orderpriority").alias("grade_subgrade"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias(TARGET),
        F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), "orig")
        .when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp"), "train")
        .otherwise("test")
        .alias("split"),
    )


APPLICATIONS_SQL = """
select o_orderkey id, inc annual_income, dti debt_to_income_ratio, cast(300 + 10*q as int) credit_score,
       o_totalprice loan_amount, round(tax*100, 2) interest_rate,
       ls gender, rf marital_status, r_name education_level, n_name employment_status,
       c_mktsegment loan_purpose, o_orderpriority grade_subgrade,
       case when o_orderstatus = 'F' then 1 else 0 end loan_paid_back,
       case when o_orderdate < timestamp '1997-01-01' then 'orig'
            when o_orderdate < timestamp '2000-01-01' then 'train' else 'test' end split
from orders
join (select l_orderkey, max(l_extendedprice) inc, max(l_discount) dti, max(l_tax) tax, max(l_quantity) q,
             min(l_linestatus) ls, min(l_returnflag) rf
      from lineitem group by l_orderkey) li on l_orderkey = o_orderkey
join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey
join region on r_regionkey = n_regionkey
"""


def scores(spark: SparkSession, sf_dir: str, n_models: int = 3, stretch: float = 0.0) -> DataFrame:
    """Deterministic stand-in for model output: model ``m`` carries more signal as ``m`` grows.

    ``stretch`` > 0 pushes ``p`` towards 0/1 (pseudo-label work): p' = clip(0.5 + (p - 0.5) * (1 + stretch)).
    """
    labels = table(spark, sf_dir, "labels")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("model").cast("string"), F.col("doc_id").cast("string"))), 1, 8), 16, 10)
    p = F.round(
        F.lit(0.5) * h.cast("double") / F.lit(4294967296.0)
        + F.lit(0.25)
        + F.lit(0.1) * F.col("model") * (F.col("quality") - F.lit(0.5)),
        4,
    )
    out = labels.select(
        "doc_id", "quality", F.explode(F.sequence(F.lit(1), F.lit(n_models))).alias("model")
    ).select(F.col("doc_id").alias("id"), "model", F.col("quality").alias("y"), p.alias("p"))
    if stretch:
        out = out.withColumn(
            "p",
            F.round(F.least(F.greatest(F.lit(0.5) + (F.col("p") - 0.5) * (1 + stretch), F.lit(0.0)), F.lit(1.0)), 4),
        )
    return out


def scores_sql(n_models: int = 3, stretch: float = 0.0) -> str:
    p = ("round(0.5e0 * cast(('0x'||substr(md5(concat(m,'|',doc_id)),1,8))::BIGINT as double) / 4294967296e0"
         " + 0.25e0 + 0.1e0*m*(quality-0.5e0), 4)")
    if stretch:
        p = f"round(least(greatest(0.5e0 + ({p} - 0.5e0) * {1 + stretch!r}e0, 0e0), 1e0), 4)"
    return (f"select l.doc_id id, m model, quality y, {p} p "
            f"from labels l cross join (select range m from range(1, {n_models + 1})) x")


SCORES_SQL = scores_sql()


def test_scores(spark: SparkSession, sf_dir: str, n_models: int = 3) -> DataFrame:
    """Scores for the unlabelled (test) documents: ``(id, model, p)``, p uniform from md5 (4 decimals)."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    t = docs.join(labels, "doc_id", "left_anti")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("model").cast("string"), F.lit("test"),
                                             F.col("doc_id").cast("string"))), 1, 8), 16, 10)
    return t.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(n_models))).alias("model")).select(
        F.col("doc_id").alias("id"), "model", F.round(h.cast("double") / F.lit(4294967296.0), 4).alias("p"))


def test_scores_sql(n_models: int = 3) -> str:
    return ("select d.doc_id id, m model, round(cast(('0x'||substr(md5(concat(m, '|test|', d.doc_id)),1,8))::BIGINT as double)"
            " / 4294967296e0, 4) p from documents d cross join (select range m from range(1, "
            f"{n_models + 1})) x where d.doc_id not in (select doc_id from labels)")


def seed_scores(spark: SparkSession, sf_dir: str, n_models: int = 3, n_seeds: int = 3) -> DataFrame:
    """Like ``scores`` with a seed dimension: the seed enters the hashed string."""
    labels = table(spark, sf_dir, "labels")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("model").cast("string"), F.col("seed").cast("string"),
                                             F.col("doc_id").cast("string"))), 1, 8), 16, 10)
    p = F.round(F.lit(0.5) * h.cast("double") / F.lit(4294967296.0) + F.lit(0.25)
                + F.lit(0.1) * F.col("model") * (F.col("quality") - F.lit(0.5)), 4)
    t = labels.select("doc_id", "quality", F.explode(F.sequence(F.lit(1), F.lit(n_models))).alias("model"))
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_seeds))).alias("seed"))
    return t.select(F.col("doc_id").alias("id"), "model", "seed", F.col("quality").alias("y"), p.alias("p"))


def seed_scores_sql(n_models: int = 3, n_seeds: int = 3) -> str:
    return ("select l.doc_id id, m model, s seed, quality y, round(0.5e0 * cast(('0x'||substr(md5(concat(m,'|',s,'|',l.doc_id)),1,8))::BIGINT"
            " as double) / 4294967296e0 + 0.25e0 + 0.1e0*m*(quality-0.5e0), 4) p "
            f"from labels l cross join (select range m from range(1, {n_models + 1})) x "
            f"cross join (select range s from range(1, {n_seeds + 1})) z")
