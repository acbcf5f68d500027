"""In-row TF-IDF and sparse wide vectors against plain Python on small texts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwise.operators import termrows as TR

def text():
    return F.coalesce(F.col("t"), F.lit(""))

SCHEMA = "id long, t string, fold int, d1 double, d2 int, slot long"


def _rows(n=60):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "éa", "zeta", "the", "日本", "a1"]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), None if k % 5 == 4 else k % 3,
            rng.choice([0.0, 1.5, None]), rng.choice([0, 7]), rng.choice([None, 0, 1])) for k in range(n)]
    return out + [(100, None, 0, None, None, None), (101, "", None, 1.0, 1, 1), (102, "alpha " * 30_000, 1, float("nan"), 2, 0),
                  (7, "beta alpha", 2, 1.0, 1, 1)]


def _grams(kind, text):
    import re
    text = (text or "").lower()
    if kind == "words":
        tok = re.findall(r"\w{2,}", text)
        return [" ".join(tok[i:i + n]) for n in (1, 2) for i in range(len(tok) - n + 1)]
    return [p[i:i + n] for w in text.split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(len(p) - n + 1)]


def _plain(rows, kind, k, min_df, max_df, max_features):
    part = [r for r in rows if r[2] is not None and r[2] != k]
    bags = [Counter(_grams(kind, r[1])) for r in part]
    df, ctf = Counter(t for b in bags for t in b), Counter()
    for b in bags:
        ctf.update(b)
    ok = [t for t in df if min_df <= df[t] <= max_df * len(part)]
    vocab = sorted(ok, key=lambda t: (-ctf[t], t))[:max_features]
    idf = {t: math.log((1 + len(part)) / (1 + df[t])) + 1 for t in vocab}

    def weights(text):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(_grams(kind, text)).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}
    return sorted(vocab), weights


ANALYZERS = {"words": TR.Analyzer("words", 1, 2), "chars": TR.Analyzer("chars", 2, 4)}


@pytest.mark.parametrize("kind", ["words", "chars"])
@pytest.mark.parametrize("slice_bytes", [200, 1 << 20])
def test_every_fold_against_plain_python(monkeypatch, spark, kind, slice_bytes):
    monkeypatch.setattr(TR, "SLICE_BYTES", slice_bytes)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    v = TR.fit(df.where("fold is not null"), text(), ANALYZERS[kind], 3, "fold", 2, 0.8, 25)
    got = TR.weigh(df.withColumnRenamed("fold", "own"), text(), v, ["id", "own"], range(3)).collect()
    assert len(got) == 3 * len(rows)
    have = sorted((r["id"], r["fold"], tuple(sorted((t, round(x, 9)) for t, x in zip(r["terms"], r["tfidf"])))) for r in got)
    want = []
    for k in range(3):
        vocab, weights = _plain(rows, kind, k, 2, 0.8, 25)
        assert vocab == [t for t, x in zip(v.terms, v.idf[:, k]) if x == x]
        want += [(r[0], k, tuple(sorted((t, round(x, 9)) for t, x in weights(r[1]).items()))) for r in rows]
    assert have == sorted(want)


def test_one_vocabulary_without_folds(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    v = TR.fit(df, text(), ANALYZERS["words"], min_df=1, max_features=10)
    _, weights = _plain([(*r[:2], 0, *r[3:]) for r in rows], "words", -1, 1, 1.0, 10)
    for r in TR.weigh(df, text(), v, ["id"]).where("id <> 7").collect():
        t = next(x[1] for x in rows if x[0] == r["id"])
        assert dict(zip(r["terms"], r["tfidf"])) == pytest.approx(weights(t))


def test_wide_vector_has_every_block_at_its_place(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    vs = [TR.fit(df.where("fold is not null"), text(), a, 3, "fold", 2, 0.9, 20) for a in ANALYZERS.values()]
    k = 1
    plain = [_plain(rows, kind, k, 2, 0.9, 20) for kind in ANALYZERS]
    starts = TR.offsets(vs, 2, 2, k)
    assert starts == [4, 4 + len(plain[0][0]), 4 + len(plain[0][0]) + len(plain[1][0])]
    got = TR.sparse_features(df, text(), vs, ["d1", "d2"], "slot", 2, ["id", "t"], k).collect()
    assert len(got) == len(rows)
    for r, (i, t, _, d1, d2, slot) in zip(sorted(got, key=lambda r: (r["id"], str(r["t"]))), sorted(rows, key=lambda r: (r[0], str(r[1])))):
        want = {}
        if d1 and d1 == d1:
            want[0] = d1
        if d2:
            want[1] = float(d2)
        if slot is not None:
            want[2 + slot] = 1.0
        for (vocab, weights), start in zip(plain, starts):
            want |= {start + vocab.index(x): w for x, w in weights(t).items()}
        v = r["features"]
        assert v.size == starts[-1] and list(v.indices) == sorted(want)
        assert dict(zip(v.indices.tolist(), v.values.tolist())) == pytest.approx(want)


def test_empty_tables_and_no_term(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    v = TR.fit(df.where("id = 100"), text(), ANALYZERS["chars"], min_df=1)
    assert v.terms == [] and [r["terms"] for r in TR.weigh(df.where("id < 3"), text(), v, ["id"]).collect()] == [[]] * 3
    full = TR.fit(df, text(), ANALYZERS["chars"])
    assert TR.weigh(df.limit(0), text(), full, ["id"]).count() == 0
    assert TR.sparse_features(df.limit(0), text(), [full], ["d1"], None, 0, ["id"]).count() == 0


def test_many_characters_in_a_slice(spark):
    """An alphabet whose codes pass 63 bits: slices are halved until they fit."""
    rows = [(k, "".join(chr(0x4E00 + (k * 700 + j) % 20_000) for j in range(700)), 0, 0.0, 0, 0) for k in range(24)]
    rows.append((99, "".join(chr(0x4E00 + j) for j in range(8000)), 0, 0.0, 0, 0))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    a = TR.Analyzer("chars", 3, 5)
    v = TR.fit(df, text(), a, min_df=1, max_features=50)
    count = Counter(g for r in rows for p in [f" {r[1]} "] for n in (3, 4, 5) for g in (p[i:i + n] for i in range(len(p) - n + 1)))
    assert v.terms == sorted(sorted(count, key=lambda t: (-count[t], t))[:50])


def test_top_by_group(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([1, 2, 3, 50]), f"t{i}") for g in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, c long, term string")
    got = sorted(map(tuple, TR.top_by_group(df, "g", "c", "term", 120).collect()))
    want = sorted(x for g in range(3) for x in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:120])
    assert got == want


def test_wide_rows_of_all_folds_come_from_one_pass_over_the_texts(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    vs = [TR.fit(df.where("fold is not null"), text(), a, 3, "fold", 1, 1.0, 40) for a in ANALYZERS.values()]
    blocks = TR.count_blocks(df, text(), vs, ["d1", "d2"], "slot", ["id", "t", "fold"])
    for k in range(3):
        every = {(r["id"], r["t"]): r["features"] for r in TR.sparse_features(df, text(), vs, ["d1", "d2"], "slot", 2, ["id", "t"], k).collect()}
        for owns in ([j for j in range(3) if j != k], [k, None]):
            got = TR.block_features(blocks, vs, 2, 2, ["id", "t"], k, ("fold", owns)).collect()
            want = [r for r in _rows() if r[2] in owns]
            assert sorted((r["id"], r["t"] or "") for r in got) == sorted((r[0], r[1] or "") for r in want)
            assert all(r["features"] == every[(r["id"], r["t"])] for r in got)


def test_cross_validated_wide_scores_do_not_cut_texts_again(spark, sf_small, monkeypatch):
    from foldwise.operators import models as MO
    from foldwise.plans import wide_queries as W
    plans = []

    def plan_only(fit_rows, score_rows, folds, make_estimator):
        plans.extend(f(k)._jdf.queryExecution().optimizedPlan().toString() for k in folds for f in (fit_rows, score_rows))
        return spark.range(1)

    monkeypatch.setattr(MO, "cv_oof_rows", plan_only)
    W._scores(spark, sf_small)
    assert len(plans) == 10 and not any("answer" in p or "_terms" in p for p in plans)


@pytest.mark.parametrize("kind", ["words", "chars"])
@pytest.mark.parametrize("slice_bytes", [200, 1 << 20])
def test_weights_are_normalised_over_all_rows_of_an_id(monkeypatch, spark, kind, slice_bytes):
    monkeypatch.setattr(TR, "SLICE_BYTES", slice_bytes)
    rows = [(k, t, 0, 0.0, 0, 0) for k, t, *_ in _rows()] + [(None, "alpha beta", 0, 0.0, 0, 0), (None, "gamma alpha", 0, 0.0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4, "id")
    v = TR.fit(df, text(), ANALYZERS[kind], min_df=1, max_features=25)
    out = TR.weigh_terms(df, text(), v, "id", ["slot"])
    idf = dict(zip(v.terms, v.idf[:, 0]))
    want, norm = [], Counter()
    for k, t, *_ in rows:
        w = {x: (1 + math.log(n)) * idf[x] for x, n in Counter(_grams(kind, t)).items() if x in idf}
        norm[k] += sum(x * x for x in w.values())
        want += [(k, x, y) for x, y in w.items()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["id"], r["term"], round(r["tfidf"], 9)) for r in out.collect()), key=order) == \
        sorted(((k, x, round(y / math.sqrt(norm[k]), 9)) for k, x, y in want), key=order)


def test_words_reach_tasks_as_words_and_terms_are_not_sorted(spark, sf_small):
    from foldwise.plans import tfidf_queries as Q
    df = spark.createDataFrame([(1, "Alpha beta  alpha")], "id long, t string")
    assert TR.Analyzer("words", 1, 3).prepared(df, text(), "w").first()["w"] == ["alpha", "beta", "alpha"]
    for q in (Q.tfidf_word, Q.tfidf_char, Q.topic_coherence):
        plan = q(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan


def test_doc_terms_and_counts_of_every_length(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for kind, a in ANALYZERS.items():
        got = Counter({(r["id"], r["term"], r["tf"]): 1 for r in TR.doc_terms(df.where("id <> 7"), text(), a, ["id"]).collect()})
        assert got == Counter({(r[0], t, n): 1 for r in rows if r[0] != 7 for t, n in Counter(_grams(kind, r[1])).items()})
        bags = [Counter(_grams(kind, r[1])) for r in rows]
        df_of, ctf = Counter(t for b in bags for t in b), Counter()
        for b in bags:
            ctf.update(b)
        counts = TR.term_counts(df, text(), a).groupBy("term").agg(F.sum("df"), F.sum("ctf")).collect()
        assert {r[0]: (r[1], r[2]) for r in counts} == {t: (n, ctf[t]) for t, n in df_of.items()}


def test_codes_too_large_to_pack_with_fold_and_document(spark):
    rows = [(k, "".join(chr(0x4E00 + (k * 3500 + j) % 7000) for j in range(3500)), k % 2, 0.0, 0, 0) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    v = TR.fit(df, text(), TR.Analyzer("chars", 3, 4), 2, "fold", 1, 1.0, 60)
    for k in (0, 1):
        count = Counter(g for r in rows if r[2] != k for p in [f" {r[1]} "] for n in (3, 4) for g in (p[i:i + n] for i in range(len(p) - n + 1)))
        assert [t for t, x in zip(v.terms, v.idf[:, k]) if x == x] == sorted(sorted(count, key=lambda t: (-count[t], t))[:60])
