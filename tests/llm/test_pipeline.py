"""The pipeline: each stage against a plain version on its own input, and the whole run."""

import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline as P
from test_decontaminate import brute as overlaps
from test_jaccard import brute as groups_at
from test_secret_scan import brute as secrets

from foldwise.sources.tables import table


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def near_groups(docs):
    import test_jaccard
    real = test_jaccard.shingle_set
    try:
        test_jaccard.shingle_set = lambda t, n=5: real(t, 5)
        return groups_at(docs, Fraction(4, 5))
    finally:
        test_jaccard.shingle_set = real


def test_stages(spark, sf_small, tmp_path):
    docs = table(spark, sf_small, "documents")
    columns = docs.schema
    for name, stage in P.STAGES:
        before = rows(docs)
        out = stage(spark, docs, sf_small)
        if name == "packing":
            check_packing(out, before)
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in columns]
        after = rows(docs)
        if name == "language_id":
            lost = [r["text"] for d, r in before.items() if d not in after]
            assert all(d in after for d, r in before.items() if len(re.findall(r"[^\W\d_]", r["text"] or "")) > 40), len(lost)
        elif name == "jaccard_join":
            want = near_groups({d: r["text"] for d, r in before.items()})
            assert set(after) == {d for d, (_, c) in want.items() if c == d}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_small, "benchmark").collect()]
            hit = {d for d, _ in overlaps([(d, r["text"]) for d, r in before.items()], items)}
            assert hit and not hit & set(after)
            assert len(before) - len(after) <= len(hit) * 1.5 + 2
        else:
            assert set(after) == set(before)
            changed = 0
            for d, r in after.items():
                assert not secrets(r["text"])
                if not secrets(before[d]["text"]) and before[d]["text"] != r["text"]:
                    changed += 1
                assert r["n_chars"] == len(r["text"])
            assert changed <= 2  # only for kinds beyond the base rules


def check_packing(out, docs):
    got = out.collect()
    per_doc, per_seq = Counter(), {}
    for r in got:
        per_doc[r["doc_id"]] += r["length"]
        per_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(per_doc) == set(docs)
    assert all(per_doc[r["doc_id"]] == r["doc_tokens"] for r in got)
    for parts in per_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_run(spark, sf_small):
    assert P.run(spark, sf_small).count() > 0
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES][0] == "language_id"


def test_stages_on_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "...", "en", "s", 3), (None, "words here", "en", "s", 10),
                                (4, "some english words token=abcdefgh", "en", "s", 33), (4, "some english words token=abcdefgh", "en", "s", 33),
                                (5, "quelques mots", "fr", None, 13)], schema)
    for start in (df, df.limit(0)):
        docs = start
        for name, stage in P.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "packing":
                docs = spark.createDataFrame(docs.collect(), schema)
        n = docs.count()
    assert n == 0
    kept = P.redact_secrets(spark, df, "").where("doc_id = 4").collect()
    assert [r["text"] for r in kept] == ["some english words [assign]"] * 2 and kept[0]["n_chars"] == 27
