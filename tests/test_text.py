"""Hand-worked goldens for the text families (edge strings) and plan checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import text as T
from foldwise.operators import textstyle as TS
from foldwise.operators.digitlaw import benford_features
from foldwise.plans.model_queries import meta_features

EDGES = [(1, ""), (2, "..."), (3, "one"), (4, "One. Two two!"), (5, "a  b"), (6, None)]


@pytest.fixture(scope="module")
def feats(spark):
    df = spark.createDataFrame(EDGES, "id long, answer string")
    rows = TS.style_features(df, "answer", ["id"]).collect()
    return {r["id"]: r.asDict() for r in rows}


def test_lengths(feats):
    assert feats[4]["word_count"] == 3 and feats[4]["text_length"] == 13
    assert feats[4]["sentence_count"] == 2
    assert feats[5]["word_count"] == 2  # two spaces are one separator
    assert feats[1]["word_count"] == 0 and feats[6]["word_count"] == 0  # null text is ''


def test_sentences(feats):
    # 'One. Two two!' -> sentences [1, 2] words: population variance 0.25
    assert feats[4]["sentence_length_variance"] == pytest.approx(0.25)
    assert feats[4]["max_sentence_length"] == 2 and feats[4]["min_sentence_length"] == 1
    assert feats[2]["max_sentence_length"] == 0 and feats[2]["min_sentence_length"] == 999
    assert feats[2]["sentence_length_variance"] == 0.0  # delimiter-only text


def test_vocabulary(feats):
    # lower words: one., two, two!  -> all distinct
    assert feats[4]["unique_words"] == 3 and feats[4]["hapax_legomena"] == 3
    assert feats[4]["yules_k"] == pytest.approx(0.0)
    assert feats[3]["lex_div"] == 1.0 and feats[1]["lex_div"] == 0.0


def test_readability_and_case(feats):
    assert feats[4]["consecutive_duplicates"] == 0
    assert feats[4]["capital_letters"] == 2 and feats[4]["title_case_words"] == 2
    assert feats[3]["max_word_length"] == 3 and feats[1]["min_word_length"] == 999


def test_consecutive_duplicates(spark):
    df = spark.createDataFrame([(1, "the The cat cat dog cat.")], "id long, answer string")
    r = TS.style_features(df, "answer", ["id"], ["readability"]).first()
    assert r["consecutive_duplicates"] == 2


def test_entropy(feats):
    assert feats[1]["char_entropy"] == 0.0
    assert feats[3]["char_entropy"] == pytest.approx(1.5849625, rel=1e-6)  # 'one': 3 equal symbols


def test_benford_empty_and_values(spark):
    df = spark.createDataFrame([(1, ""), (2, "aaaa bbbbbb cc")], "id long, answer string")
    rows = {r["id"]: r for r in benford_features(df).collect()}
    assert rows[1]["benford_chi_word"] == 0.0
    assert rows[2]["benford_chi_word"] == rows[2]["benford_chi_char"]  # identical sequences


def test_no_python_udf_in_text_plan(spark):
    df = spark.createDataFrame(EDGES, "id long, answer string")
    plan = TS.style_features(df, "answer", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_topic_onehot_unseen_topic(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id long, topic string")
    out = TS.topic_onehot(df, "topic", ["a", "b"]).orderBy("id").collect()
    assert [(r["topic_a"], r["topic_b"]) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_benford_punct_positions_match_brute_force(spark):
    import math as m
    from foldwise.operators import digitlaw as D

    text = ("a.b,c;" * 40) + "x" * 2000 + "!?" * 7
    pos = [i for i, c in enumerate(text) if c in ".,;:!?" and i > 0]
    counts = [sum(1 for p in pos if int(str(p)[0]) == d) for d in range(1, 10)]
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(D.punct_digit_counts(F.col("t")))]).first()
    assert [got[f"c{i}"] for i in range(9)] == counts
    old = D.MAX_MAGNITUDE
    try:
        D.MAX_MAGNITUDE = 1  # force the tail pass for positions >= 100
        got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(D.punct_digit_counts(F.col("t")))]).first()
        assert [got[f"c{i}"] for i in range(9)] == counts
    finally:
        D.MAX_MAGNITUDE = old


def test_joined_text_strips_all_white_space(spark):
    from foldwise.plans.model_queries import joined_text
    rows = [("\t t \n", " a "), (None, "\r\n x"), ("q", None), (None, None), ("a", "b\nc")]
    df = spark.createDataFrame(rows, "topic string, answer string")
    assert [r[0] for r in df.select(joined_text(df)).collect()] == ["t a", "x", "q", "", "a b\nc"]


def test_phrase_and_paragraph_goldens(spark):
    from foldwise.operators import textstyle as TS
    text = f"{TS.AI_CONNECTORS[0]} we saw it.\n\nSecond paragraph, {TS.FORMAL_WORDS[0]} and {TS.PASSIVE_INDICATORS[0]} done.\n\n \n\nThird."
    df = spark.createDataFrame([(1, text), (2, "plain words")], "id long, answer string")
    a, b = TS.style_features(df, "answer", ["id"], ["phrases", "lengths"]).orderBy("id").collect()
    for c in ("ai_connector_density", "formal_word_ratio", "passive_voice_ratio"):
        assert a[c] > 0 and b[c] == 0, c
    assert (a["paragraph_count"], b["paragraph_count"]) == (3, 1)


def test_char_entropy_of_odd_texts_without_sorted_characters(spark, monkeypatch):
    from collections import Counter

    texts = ["", None, "a", "ab" * (T.SLICE_CHARS * 3 // 4), "abab", "\U0001f600é\U0001f600 \x00", "zz" * 40, "ÄäßΩ字字"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, answer string").coalesce(1)
    in_row = {r["id"]: r["char_entropy"] for r in TS.style_features(df, families=["entropy"]).collect()}
    out = meta_features(df).select("id", "char_entropy")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "ArrowEvalPython" in plan

    def plain(t):
        c = Counter(t or "")
        return -sum(k / len(t) * math.log2(k / len(t) + 1e-12) for k in c.values())

    got = {r["id"]: r["char_entropy"] for r in out.collect()}
    assert got == pytest.approx({i: plain(t) for i, t in enumerate(texts)}, abs=1e-9)
    assert got == pytest.approx(in_row, abs=1e-9)
    wide = "".join(chr(0x4E00 + i) for i in range(500))
    monkeypatch.setattr(T, "TABLE_CELLS", 10)
    assert list(T._entropies(wide + "aab", np.array([500, 3]))) == pytest.approx([plain(wide), plain("aab")], abs=1e-9)


def test_screening_makes_the_features_once(spark):
    from foldwise.operators.select import mi_screen

    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i % 2, float(i), float(i % 3)) for i in range(60)], "y int, a double, b double")
    out = {r["feature"]: r for r in mi_screen(rows.mapInArrow(count, rows.schema), ["a", "b"], "y", bins=4, min_keep=1).collect()}
    assert seen.value == 60
    assert set(out) == {"a", "b"} and out["b"]["mi"] == pytest.approx(0.0, abs=1e-6)


def test_model_frame_makes_the_features_once(spark, sf_small, monkeypatch):
    from foldwise.plans import model_queries as MQ

    seen, plain = spark.sparkContext.accumulator(0), MQ.meta_features

    def counted(df):
        def count(it):
            for b in it:
                seen.add(b.num_rows)
                yield b
        f = plain(df)
        return f.mapInArrow(count, f.schema)

    monkeypatch.setattr(MQ, "meta_features", counted)
    tr, te = MQ._text_model_frame(spark, sf_small)
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert tr.count() + te.count() == n and seen.value == n
