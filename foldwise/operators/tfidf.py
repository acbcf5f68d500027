"""TF-IDF as long tables (TF-1..TF-5, SM-1, T-4).

Queries over whole texts count and weigh terms inside the row (``termrows``) and explode only the weights of the vocabulary's
terms. Callers ``spread`` documents by id first, so all cores work whatever the input's file layout. The vocabulary is the top
``max_features`` terms by corpus count after the document-frequency limits, taken with a per-task top-k before the merge.

Weights follow the usual smooth-idf definition:
``tf' = 1 + ln(tf)`` when sublinear (``1`` when binary),
``idf = ln((1 + n) / (1 + df)) + 1``, then L2 normalisation per document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..session import DEFAULT_BROADCAST_ROWS, materialize

TOKEN = r"[\p{L}\p{N}_]{2,}"


def english_stop_words() -> tuple[str, ...]:
    """Spark ML's English stop list, kept as a constant so engine and oracle share it without a JVM or jar."""
    return ENGLISH_STOP_WORDS


# ---------------------------------------------------------------- analyzers

def word_tokens(t: Column, stop_words: Sequence[str] | None = None) -> Column:
    toks = F.regexp_extract_all(F.lower(t), F.lit(f"({TOKEN})"), 1)
    if stop_words:
        stops = list(stop_words)
        toks = F.filter(toks, lambda w: ~w.isin(*stops))
    return toks


# ---------------------------------------------------------------- long tables

def spread(docs: DataFrame, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Documents dealt by id (default: ``spark.sql.shuffle.partitions``); later steps per document stay in place."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return docs.repartition(n, id_col)


def doc_terms(df: DataFrame, id_col: str, terms: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, keep..., term, tf)`` with counts computed inside each row, then exploded."""
    t = df.select(id_col, *keep, terms.alias("_terms"))
    t = T.with_value_counts(t, "_terms", "_v")
    e = F.explode(F.arrays_zip(F.col("_v_terms").alias("term"), F.col("_v_tf").alias("tf")))
    return t.select(id_col, *keep, e.alias("_e")).select(id_col, *keep, "_e.term", "_e.tf")


def top_terms(st: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` terms with the largest corpus count (ties by term), per ``by`` group.

    ``orderBy().limit(n)`` keeps a top-n per task and merges at most
    ``n * tasks`` rows; a ``row_number`` window would sort every candidate
    term of a group in one task once ``n`` exceeds Spark's window group-limit
    threshold (1000). Groups (folds) are few: one limited query each.
    """
    order = [F.col("ctf").desc(), F.col("term")]
    if not by:
        return st.orderBy(*order).limit(n)
    keys = [tuple(r) for r in st.select(*by).distinct().collect()]  # k groups
    parts = []
    for key in keys:
        cond = None
        for c, v in zip(by, key):
            e = F.col(c) == F.lit(v)
            cond = e if cond is None else cond & e
        parts.append(st.where(cond).orderBy(*order).limit(n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _small(vocab: DataFrame) -> DataFrame:
    """A written vocabulary, broadcast only up to the bound of rows."""
    vocab = materialize(vocab)
    return F.broadcast(vocab) if vocab.count() <= DEFAULT_BROADCAST_ROWS else vocab


def tfidf_transform(dt: DataFrame, vocab: DataFrame, id_col: str = "id", sublinear: bool = False,
                    binary: bool = False, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``(id, by..., keep..., term, tfidf)`` L2-normalised per document over vocabulary terms."""
    by = list(by)
    x = dt.join(_small(vocab.select(*by, "term", "idf")), [*by, "term"])
    tf = F.lit(1.0) if binary else (F.lit(1.0) + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double"))
    x = x.withColumn("_w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return x.select(id_col, *by, *keep, "term", F.when(norm > 0, F.col("_w") / norm).otherwise(F.lit(0.0)).alias("tfidf"))


def tfidf_fit_transform(fit_docs: DataFrame, all_docs: DataFrame, text: Column, analyzer, id_col: str = "id",
                        min_df: int = 1, max_df: float = 1.0, max_features: int = 3000, sublinear: bool = False) -> DataFrame:
    """Fit vocabulary and idf on ``fit_docs``; weight ``all_docs`` (TF-1/TF-2/TF-3 with folds=None). ``analyzer``: a
    ``termrows.Analyzer``."""
    from . import termrows as TR

    vocab = TR.fit(fit_docs, text, analyzer, min_df=min_df, max_df=max_df, max_features=max_features)
    return TR.weigh_terms(all_docs, text, vocab, id_col, sublinear=sublinear)


def fixed_vocabulary_tfidf(fit_docs: DataFrame, all_docs: DataFrame, text_col: str, vocabulary: Sequence[str],
                           id_col: str = "id", binary: bool = True) -> DataFrame:
    """TF-3: fixed vocabulary, binary tf, idf from ``fit_docs`` (terms absent there get df 0)."""
    terms = F.filter(word_tokens(F.col(text_col)), lambda w: w.isin(*vocabulary))
    dt_fit = doc_terms(fit_docs, id_col, terms)
    n = fit_docs.count()
    spark = fit_docs.sparkSession
    vocab_df = spark.createDataFrame([(v,) for v in vocabulary], "term string")
    dfs = dt_fit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocab = vocab_df.join(dfs, "term", "left").na.fill(0, ["df"]).withColumn(
        "idf", F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    return tfidf_transform(doc_terms(all_docs, id_col, terms), vocab, id_col, binary=binary)


def cosine_topic_answer(docs: DataFrame, id_col: str, topic_col: str, answer_col: str, analyzer,
                        max_features: int = 2000) -> DataFrame:
    """SM-1: cosine similarity of topic and answer in a TF-IDF space fitted on answers + topics.

    ``analyzer``: a ``termrows.Analyzer``. Topics are weighted once per distinct topic (their document counts enter the corpus
    statistics), and only the answer's terms that its topic has meet them. 0 when either text is blank.
    """
    from . import termrows as TR

    text = F.coalesce(F.col("_x"), F.lit(""))
    ans = docs.select(F.col(id_col).alias("_id"), F.col(topic_col).alias("_topic"), F.col(answer_col).alias("_x"))
    topics = materialize(docs.groupBy(F.col(topic_col).alias("_topic")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_x", F.col("_topic")))
    top = TR.doc_terms(topics, text, analyzer, ["_n"])
    # the corpus is every answer and every topic row (2n documents), as in the reference
    n = (topics.agg(F.sum("_n")).first()[0] or 0) * 2
    st = TR.term_counts(ans, text, analyzer).unionByName(
        top.select("term", F.col("_n").alias("df"), (F.col("tf") * F.col("_n")).alias("ctf"))) \
        .groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    chosen = sorted(map(tuple, top_terms(st, max_features).select("term", idf).collect()))  # max_features rows
    vocab = TR.Vocabulary(analyzer, [t for t, _ in chosen], np.array([[x] for _, x in chosen]).reshape(-1, 1))
    va = TR.weigh_terms(ans, text, vocab, "_id", ["_topic"], sublinear=False).withColumnRenamed("tfidf", "_a")
    vt = TR.weigh_terms(topics, text, vocab, "_topic", sublinear=False).withColumnRenamed("tfidf", "_b")
    sim = va.join(_small(vt), ["_topic", "term"]).groupBy("_id").agg(F.sum(F.col("_a") * F.col("_b")).alias("_c"))
    blank = ~T.text_or_empty(topic_col).rlike(T.NON_WS) | ~T.text_or_empty(answer_col).rlike(T.NON_WS)
    out = docs.select(F.col(id_col), blank.alias("_blank")).join(sim.withColumnRenamed("_id", id_col), id_col, "left")
    return out.select(id_col, F.when(F.col("_blank"), F.lit(0.0)).otherwise(F.coalesce(F.col("_c"), F.lit(0.0)))
                      .alias("topic_coherence"))
