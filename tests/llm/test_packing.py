"""Packing: every id in one piece, gapless windows, little padding, differencing against a plain version."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from foldwise.llm import packing as P
from foldwise.llm import queries as Q
from foldwise.llm import tok

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, window=2048):
    t = tok.pieces(PATH).tokenizer
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array(t.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] >= 1 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    filled = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        filled += at
    return filled, len(by_seq)


def test_query_on_whole_table(spark, sf_small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    filled, n = check(Q.op8_packing(spark, sf_small).collect(), texts)
    assert filled / (n * 2048) > 0.98


def plain_difference(lengths, k):
    """The same differencing on lists of items."""
    import heapq
    heap = [(-x, i, [(x, [i])] + [(0, [])] * (k - 1)) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda s: -s[0])
        low = c[-1][0]
        heapq.heappush(heap, (-(c[0][0] - low), tie, [(x - low, p) for x, p in c]))
        tie += 1
    return sorted(sum(lengths[i] for i in p) for _, p in heap[0][2])


@pytest.mark.parametrize("n,k", [(1, 1), (2, 3), (5, 2), (30, 4), (200, 17)])
def test_differencing_equals_plain_version(n, k):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 512, n)
    to = P.difference(lengths, k)
    assert sorted(np.bincount(to, lengths, k).astype(int).tolist()) == plain_difference(lengths.tolist(), k)


def test_windows_are_near_equal_and_never_over():
    rng = np.random.default_rng(5)
    for n, most in ((512, 512), (100, 2047), (3, 2047), (1, 5), (700, 3)):
        lengths = rng.integers(1, most + 1, n)
        sums = np.bincount(P.assign(lengths, 2048), lengths)
        assert sums.max() <= 2048 and sums.min() > 0
        if most == 512:
            assert sums.max() - sums.min() < 64
    assert P.assign(np.array([1500, 1500, 1500]), 2048).tolist() != [0, 0, 1]  # the window count rises


def test_edges(spark):
    texts = {1: None, 2: "", 3: "one two", 4: "word " * 9000, 5: "日本 <|endoftext|>"}
    df = spark.createDataFrame([(d, t, 7) for d, t in texts.items()], "doc_id long, text string, offset int")
    check(P.pack(P.cut_documents(df, PATH)).collect(), texts)
    twice = P.pack(P.cut_documents(df.union(df).union(spark.createDataFrame([(None, "x", 7)], df.schema)), PATH)).collect()
    assert sum(r["length"] for r in twice if r["doc_id"] == 4) == 2 * 9001 and sum(r["doc_id"] is None for r in twice) == 1
    assert P.pack(P.cut_documents(df.limit(0), PATH)).count() == 0


def test_rows_that_repeat_are_dealt_to_many_shards(spark):
    from foldwise.llm import packing as K
    rows = [(1, 0, 100, 5, 100)] * 6000
    out = K.pack(spark.createDataFrame(rows, K.SCHEMA), shard_pieces=500).collect()
    assert len(out) == 6000
    per_shard = {}
    for r in out:
        per_shard[r["sequence_id"] >> 24] = per_shard.get(r["sequence_id"] >> 24, 0) + 1
    assert max(per_shard.values()) < 1000
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in used.values():
        v.sort()
        assert [o for o, _ in v] == [100 * k for k in range(len(v))] and 100 * len(v) <= 2048
