"""TX-17: documents scored by a lexicon of word polarities, a caller's or one learned from labels outside the document's fold.

A document's polarity is the mean over its lexicon words with repeats, its subjectivity the mean of their absolute values; both
are 0 without any. Words are the lower-cased runs between white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import lookup_join
from .tfidf import doc_terms


def _scored(docs: DataFrame, hits: DataFrame, polarity: Column, id_col: str) -> DataFrame:
    """``docs`` with both scores; ``hits`` has the id, ``tf`` and a row per lexicon word of a document."""
    s = hits.select(id_col, "tf", polarity.alias("_x")).where(F.col("_x").isNotNull()).groupBy(id_col).agg(
        (F.sum(F.col("tf") * F.col("_x")) / F.sum("tf")).alias("_pol"), (F.sum(F.col("tf") * F.abs("_x")) / F.sum("tf")).alias("_subj"))
    zero = F.lit(0.0)
    return docs.join(s, id_col, "left").select(*docs.columns, F.coalesce("_pol", zero).alias("sentiment_polarity"),
                                               F.coalesce("_subj", zero).alias("sentiment_subjectivity"))


def scores(docs: DataFrame, text_col: str, lexicon: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores by a table ``(term, polarity)``, broadcast only up to the bound of rows. Ids are unique."""
    terms = doc_terms(docs.select(id_col, text_col), id_col, T.lower_words(T.text_or_empty(text_col)))
    return _scored(docs, lookup_join(terms, lexicon.select("term", "polarity"), "term", "inner"), F.col("polarity"), id_col)


def learned(terms: DataFrame, label: str, fold: str, n_folds: int, min_docs: int) -> DataFrame:
    """``(term, polarity array)`` of ``(term, label, fold)`` rows, one per document and term: element ``k`` is learned without fold
    ``k``, the last from all; null below ``min_docs`` documents. Polarity is twice the mean label less one."""
    own = [F.struct(F.sum(F.when(F.col(fold) == k, F.lit(1)).otherwise(0)).alias("n"),
                    F.sum(F.when(F.col(fold) == k, F.col(label)).otherwise(0)).cast("double").alias("s")) for k in range(n_folds)]
    t = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("double").alias("s"), F.array(*own).alias("own")) \
        .where(F.col("n") >= min_docs)  # a part never has more

    def polarity(n: Column, s: Column) -> Column:
        return F.when(n >= min_docs, F.lit(2.0) * s / n - F.lit(1.0))

    parts = [polarity(F.col("n") - F.col("own")[k]["n"], F.col("s") - F.col("own")[k]["s"]) for k in range(n_folds)]
    return t.select("term", F.array(*parts, polarity(F.col("n"), F.col("s"))).alias("polarity"))


def learned_scores(docs: DataFrame, text_col: str, label: str, fold: str, n_folds: int, min_docs: int = 5, id_col: str = "id") -> DataFrame:
    """Scores of every document by the lexicon learned from the labelled documents outside its fold; documents without a fold
    (and a label) by the lexicon of all. A document's own label never enters its score. Ids are unique."""
    terms = doc_terms(docs.select(id_col, text_col, label, fold), id_col, T.lower_words(T.text_or_empty(text_col)), keep=[label, fold])
    lex = learned(terms.where(F.col(fold).isNotNull()), label, fold, n_folds, min_docs)
    part = F.element_at("polarity", F.coalesce(F.col(fold), F.lit(n_folds)).cast("int") + 1)
    return _scored(docs, lookup_join(terms, lex, "term", "inner"), part, id_col)
