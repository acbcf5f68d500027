"""Reversed search against a plain ranking of all documents for every item."""

import math
import re
from collections import Counter

import pytest

from foldwise.llm import queries as Q
from foldwise.llm import reversed_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return TERM.findall((t or "").translate(FOLD))


def plain(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in own.items():
        scored = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in ts if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def pairs(df, a, b):
    return [(r[a], r[b]) for r in df.collect()]


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_query_on_whole_tables(spark, sf_small):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    got = Q.op12_reversed_search(spark, sf_small)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block", [60, 1_000_000])
def test_edges_and_blocks(monkeypatch, spark, block):
    monkeypatch.setattr(S, "CELLS", 40)  # many small batches
    docs = [(k, f"Común word{k % 7} x{k}") for k in range(60)] + [(k, "same tie text") for k in (9, 3, 3, 77, 50, 51, 52, 53, 54, 55, 56)]
    docs += [(None, "same tie text"), (100, None), (101, ""), (102, "!!! --"), (103, "rare " * 5000 + "Word1"), (104, "日本 日本é 9")]
    items = [(1, "same TIE"), (1, "same tie"), (2, "word1 word2 word3 rare"), (3, None), (4, "nowhere"), (5, "日本 9 común"), (None, "rare x5"),
             (6, " ".join(f"x{k}" for k in range(80)))]
    d = spark.createDataFrame([r + (1, "z") for r in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    i = spark.createDataFrame([r + (1, 2) for r in items], "item_id long, text string, term int, doc_id int")
    got = sorted((tuple(r) for r in S.search(d, i, block_postings=block).collect()), key=key)
    assert got == sorted(plain(docs, items), key=key)
    assert S.search(d.limit(0), i).count() == 0 and S.search(d, i.limit(0)).count() == 0
