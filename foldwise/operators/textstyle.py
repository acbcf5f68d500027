"""Per-document style features (TX-1..TX-33).

``tokenize`` adds the token arrays once (W, L, S and the sentence word
counts) in projections before the families; every family reads those columns in the next
projection, so a split is never repeated per feature. All expressions are
built in (whole-stage codegen or JVM lambda evaluation); none is a Python
UDF, and no family shuffles the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .joins import checked_broadcast
from .ranking import rank_by_range

# Phrase and word lists of the reference, in its order.
AI_CONNECTORS = [
    "in conclusion", "in summary", "furthermore", "moreover",
    "additionally", "however", "therefore", "thus", "consequently",
    "as a result", "on the other hand", "for instance", "for example",
    "it is important to note", "it is worth noting", "that being said",
    "in other words", "specifically", "namely",
]
CONNECTORS = [
    "in conclusion", "in summary", "furthermore", "moreover", "additionally", "however",
    "therefore", "thus", "consequently", "as a result", "on the other hand",
    "for instance", "for example", "it is important to note", "it is worth noting", "that being said",
]
FORMAL_WORDS = ["utilize", "facilitate", "implement", "methodology", "paradigm",
                "leverage", "robust", "optimal", "enhance", "demonstrate"]
PASSIVE_INDICATORS = ["is made", "was made", "is given", "was given", "is shown",
                      "was shown", "is considered", "was considered", "by the"]
SUBORDINATORS = ["that", "which", "who", "when", "where", "while", "although", "because", "if"]
PUNCT_DIVERSITY_CLASS = r"""[.,;:!?"'()\[\]{}-]"""
PUNCT_COUNTS = [
    ("comma_count", ","), ("semicolon_count", ";"), ("colon_count", ":"), ("exclamation_count", "!"),
    ("question_count", r"\?"), ("period_count", r"\."), ("quote_count", '"'), ("apostrophe_count", "'"),
    ("dash_count", "-"), ("ellipsis_count", r"\.\.\."), ("parentheses_count", r"[()]"),
]
TITLE_WORD = r"^[^\p{L}]*(\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$"


def tokenize(df: DataFrame, text_col: str = "answer", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Add ``_t`` (text, null -> ''), ``_w`` (W), ``_l`` (L), ``_s`` (S, whitespace-normalised) and ``_sl``
    (words per sentence). Whitespace is mapped to plain spaces once per document. What several features read is a column of a
    projection of its own, as a branch of a condition computes its expressions again: ``_low`` (lower-cased text), ``_wl`` (lengths
    of the words), and the variances ``_wv`` and ``_sv`` of ``_wl`` and ``_sl``."""
    t = T.text_or_empty(text_col)
    base = df.select(*keep, t.alias("_t"))
    base = base.select(*keep, "_t", T.normalize_ws(F.col("_t")).alias("_tn"))
    base = base.select(*keep, "_t", F.lower(F.col("_t")).alias("_low"), T.words_normalized(F.col("_tn")).alias("_w"),
                       T.words_normalized(F.lower(F.col("_tn"))).alias("_l"),
                       T.sentences_normalized(F.col("_tn")).alias("_s"))
    base = base.select("*", T.sentence_word_counts(F.col("_s")).alias("_sl"), T.lengths(F.col("_w")).alias("_wl"))
    for c, out in (("_sl", "_sv"), ("_wl", "_wv")):
        base = T.with_pop_var(base, c, out)
    return base


def _wc() -> Column:
    return F.size("_w")


def _len() -> Column:
    return F.length("_t")


def _wlen() -> Column:
    return F.col("_wl")


def _contains_any(phrases: Sequence[str]) -> Column:
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains("_low", F.lit(p)).cast("int")
    return total


def lengths_family() -> list[Column]:
    """TX-1..TX-5, TX-24, TX-28."""
    wc, ln = _wc(), _len()
    sc = T.count_matches(F.col("_t"), T.SENT_SPLIT)
    wl = _wlen()

    def band(lo: int, hi: int | None) -> Column:
        return F.size(F.filter(wl, lambda x: (x >= lo) & (x <= hi) if hi is not None else x >= lo))

    paras = F.size(F.filter(F.split(F.col("_t"), "\n\n"), lambda p: p.rlike(T.NON_WS)))
    very_short, short, medium = band(0, 2), band(3, 4), band(5, 7)
    long_, very_long = band(8, 10), band(11, None)
    return [
        ln.alias("text_length"),
        ln.alias("char_count"),
        wc.alias("word_count"),
        (ln / (wc + 1)).alias("avg_word_length"),
        sc.alias("sentence_count"),
        (wc / (sc + 1)).alias("avg_sentence_length"),
        very_short.alias("very_short_words"),
        short.alias("short_words"),
        medium.alias("medium_words"),
        long_.alias("long_words"),
        very_long.alias("very_long_words"),
        (short / (wc + 1)).alias("short_word_ratio"),
        ((long_ + very_long) / (wc + 1)).alias("long_word_ratio"),
        paras.alias("paragraph_count"),
        (wc / (paras + 1)).alias("avg_paragraph_length"),
    ]


def sentences_family() -> list[Column]:
    """TX-6, TX-7, TX-15, TX-30, TX-31."""
    sl, ns, wc = F.col("_sl"), F.size("_s"), _wc()
    var = F.when(ns > 1, F.col("_sv")).otherwise(F.lit(0.0))
    sc = T.count_matches(F.col("_t"), T.SENT_SPLIT)
    avg_sent = wc / (sc + 1)
    starts = F.size(F.array_distinct(F.transform(F.col("_s"), lambda s: F.lower(T.first_token_normalized(s)))))
    return [
        var.alias("sentence_length_variance"),
        F.array_max(F.concat(sl, F.array(F.lit(0)))).alias("max_sentence_length"),
        F.array_min(F.concat(sl, F.array(F.lit(999)))).alias("min_sentence_length"),
        (starts / (ns + 1)).alias("repetitive_starts"),
        F.when(wc > 1, F.lit(1.0) / (F.sqrt(F.col("_wv")) + F.lit(0.1))).otherwise(F.lit(0.0)).alias(
            "word_length_uniformity"),
        F.when(ns > 1, F.lit(1.0) / (F.sqrt(F.col("_sv")) + F.lit(0.1))).otherwise(F.lit(0.0)).alias(
            "sentence_length_uniformity"),
        (var / (avg_sent + 1)).alias("burstiness"),
    ]


def punctuation_family() -> list[Column]:
    """TX-8..TX-10."""
    t = F.col("_t")
    cols = [T.count_matches(t, p).alias(name) for name, p in PUNCT_COUNTS]
    six = ["comma_count", "semicolon_count", "colon_count", "exclamation_count", "question_count", "period_count"]
    total = sum((T.count_matches(t, p) for name, p in PUNCT_COUNTS if name in six), F.lit(0))
    cols += [
        total.alias("total_punctuation"),
        (total / (_len() + 1)).alias("punctuation_ratio"),
        F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(f"({PUNCT_DIVERSITY_CLASS})"), 1))).alias(
            "punctuation_diversity"),
    ]
    return cols


def phrases_family() -> list[Column]:
    """TX-11..TX-14, TX-16."""
    wc = _wc()
    subord = T.count_matches(F.col("_t"), f"(?<!{T.WORD_CHAR})(?:{'|'.join(SUBORDINATORS)})(?!{T.WORD_CHAR})")  # as whole words
    return [
        (_contains_any(AI_CONNECTORS) / (wc + 1)).alias("ai_connector_density"),
        (_contains_any(CONNECTORS) / F.greatest(wc, F.lit(1))).alias("connector_density"),
        (_contains_any(FORMAL_WORDS) / (wc + 1)).alias("formal_word_ratio"),
        (_contains_any(PASSIVE_INDICATORS) / (wc + 1)).alias("passive_voice_ratio"),
        (subord / (wc + 1)).alias("subordinate_ratio"),
    ]


def vocabulary_family() -> list[Column]:
    """TX-20..TX-23 from in-row value counts of the lower-cased words."""
    wc = _wc()
    tf = F.col("_l_tf")
    uniq = F.size(tf)
    sq = F.aggregate(tf, F.lit(0).cast("long"), lambda a, x: a + x * x)
    hapax = F.size(F.filter(tf, lambda x: x == 1))
    dis = F.size(F.filter(tf, lambda x: x == 2))
    return [
        uniq.alias("unique_words"),
        (uniq / (wc + 1)).alias("ttr"),
        (uniq / (wc + 1)).alias("unique_word_ratio"),
        F.when(wc > 0, uniq / wc).otherwise(F.lit(0.0)).alias("lex_div"),
        F.when(wc > 0, F.lit(10000.0) * (sq - wc) / (wc * wc)).otherwise(F.lit(0.0)).alias("yules_k"),
        hapax.alias("hapax_legomena"),
        dis.alias("dis_legomena"),
        (hapax / (wc + 1)).alias("hapax_ratio"),
        F.when(wc > 0, (hapax + dis) / wc).otherwise(F.lit(0.0)).alias("hapax_dis_ratio"),
        F.size(F.filter(tf, lambda x: x > 1)).alias("repeated_words"),
        F.coalesce(F.array_max(tf), F.lit(0)).alias("max_word_repetition"),
    ]


def case_family() -> list[Column]:
    """TX-25..TX-27."""
    t, wc, ln = F.col("_t"), _wc(), _len()
    caps = T.count_matches(t, r"\p{Lu}")
    all_caps = F.size(F.filter(F.col("_w"), lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}") & (F.length(w) > 1)))
    title = F.size(F.filter(F.col("_w"), lambda w: w.rlike(TITLE_WORD)))
    digits = T.count_matches(t, r"\p{Nd}")
    return [
        caps.alias("capital_letters"),
        (caps / (ln + 1)).alias("capital_ratio"),
        all_caps.alias("all_caps_words"),
        title.alias("title_case_words"),
        (title / (wc + 1)).alias("title_case_ratio"),
        digits.alias("digit_count"),
        (digits / (ln + 1)).alias("digit_ratio"),
        T.count_matches(t, f"[^\\p{{L}}\\p{{N}}{T.WS_BODY}]").alias("special_char_count"),
    ]


def readability_family() -> list[Column]:
    """TX-18, TX-19, TX-29."""
    wc, ns = _wc(), F.size("_s")
    syl = T.count_matches(F.col("_low"), "[aeiouy]+")
    flesch = F.when((ns > 0) & (wc > 0),
                    F.lit(206.835) - F.lit(1.015) * (wc / ns) - F.lit(84.6) * (syl / wc)).otherwise(F.lit(0.0))
    wl = _wlen()
    n1 = F.greatest(wc - 1, F.lit(0))
    lw = F.col("_l")
    dup = F.size(F.filter(F.zip_with(F.slice(lw, 1, n1), F.slice(lw, 2, n1), lambda a, b: a == b), lambda x: x))
    dup = F.when(wc > 1, dup).otherwise(F.lit(0))
    return [
        flesch.alias("flesch_reading_ease"),
        F.array_max(F.concat(wl, F.array(F.lit(0)))).alias("max_word_length"),
        F.array_min(F.concat(wl, F.array(F.lit(999)))).alias("min_word_length"),
        F.when(wc > 1, F.sqrt(F.col("_wv"))).otherwise(F.lit(0.0)).alias("word_length_std"),
        dup.alias("consecutive_duplicates"),
    ]


def entropy_family() -> list[Column]:
    """TX-32: Shannon entropy (base 2) of the characters, 0 when empty."""
    tf = F.col("_c_tf")
    n = F.size(F.col("_c"))
    # n enters the lambda as an array element, never as an outer expression
    p = F.zip_with(tf, F.array_repeat(n, F.size(tf)), lambda c, m: c / m)
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x + F.lit(1e-12)))
    return [F.when(n > 0, h).otherwise(F.lit(0.0)).alias("char_entropy")]


FAMILIES = {
    "lengths": lengths_family,
    "sentences": sentences_family,
    "punctuation": punctuation_family,
    "phrases": phrases_family,
    "vocabulary": vocabulary_family,
    "case": case_family,
    "readability": readability_family,
    "entropy": entropy_family,
}


def style_features(df: DataFrame, text_col: str = "answer", keep: Sequence[str] = ("id",),
                   families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """All requested families in one pass: ``keep`` columns + one column per feature."""
    tok = tokenize(df, text_col, keep)
    if "vocabulary" in families:
        tok = T.with_value_counts(tok, "_l", "_l")
    if "entropy" in families:
        tok = tok.withColumn("_c", F.filter(F.split(F.col("_t"), ""), lambda c: c != ""))
        tok = T.with_value_counts(tok, "_c", "_c")
    cols: list[Column] = []
    for f in families:
        cols += FAMILIES[f]()
    return tok.select(*keep, *cols)


def topic_onehot(df: DataFrame, topic_col: str, vocabulary: Sequence[str], prefix: str = "topic_") -> DataFrame:
    """TX-33 / P-8: one 0/1 column per topic of the (train) vocabulary; unseen topics give all zeros.

    The vocabulary is a small collected list (one name per topic); rows need
    no shuffle, each indicator is a comparison.
    """
    return df.select("*", *[(F.col(topic_col) == F.lit(v)).cast("int").alias(f"{prefix}{v}") for v in vocabulary])


def topic_table(df: DataFrame, topic_col: str) -> DataFrame:
    """``(topic, slot, n_slots)``: the vocabulary of any size, in byte order of the topics."""
    distinct = df.select(F.col(topic_col).alias("topic")).where(F.col("topic").isNotNull()).distinct()
    ranked = materialize(rank_by_range(distinct, [], ["topic"], out="slot"))
    return ranked.withColumn("n_slots", F.lit(ranked.count()).cast("long"))


def topic_slots(df: DataFrame, topic_col: str, topics: DataFrame) -> DataFrame:
    """TX-33 / P-8, sparse: adds ``slot`` (null for a topic outside the vocabulary), ``x`` (whether a slot is set) and
    ``n_slots``. The table of topics is broadcast only up to the bound of rows."""
    sized, _ = checked_broadcast(topics.select(F.col("topic").alias("_topic"), "slot"))
    n = topics.agg(F.coalesce(F.max("n_slots"), F.lit(0))).first()[0]
    return df.join(sized, F.col(topic_col) == F.col("_topic"), "left").drop("_topic").select(
        "*", F.col("slot").isNotNull().cast("long").alias("x"), F.lit(n).cast("long").alias("n_slots"))


def topic_vocabulary(df: DataFrame, topic_col: str) -> list[str]:
    """Distinct topics (sorted), the column names of the wide form; ``topic_slots`` needs no such list."""
    return sorted(r[0] for r in df.select(topic_col).where(F.col(topic_col).isNotNull()).distinct().collect())
