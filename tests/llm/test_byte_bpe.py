"""Byte-level BPE against the tiktoken library, compatibility against merging, and the round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from foldwise.llm import byte_bpe as B
from foldwise.llm import queries as Q

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return B.encoder(PATH, P.PATTERN)


def library(ranks, pattern=P.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def merge(ranks, b):
    parts = [b[i:i + 1] for i in range(len(b))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_compatibility_is_what_merging_says(encoder):
    rng, bpe = random.Random(3), encoder.bpe
    for _ in range(4000):
        x, y = rng.randrange(3000), rng.randrange(50256)
        assert bpe.compatible(x, y) == (merge(bpe.ranks, bpe.token[x] + bpe.token[y]) == [x, y])


@pytest.mark.parametrize("alphabet", ["ab", "aab ", "etaoin shrdlu'", "0123 \n\t", "-=_ ", "日本éß  z"])
def test_random_texts(encoder, alphabet):
    rng, ref = random.Random(5), library(encoder.bpe.ranks)
    for _ in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        got = encoder.encode(s)
        assert np.frombuffer(got, "<u4").tolist() == ref.encode_ordinary(s), repr(s)
        assert B.decode_ids(got, PATH) == s.encode()


def test_random_vocabularies():
    """Small tables trained by merging, where ties and overlaps are frequent; one token that no merge reaches."""
    rng = random.Random(8)
    for _ in range(60):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        for _ in range(30):
            x, y = rng.choice(list(ranks)), rng.choice(list(ranks))
            if len(x + y) < 9 and x + y not in ranks and merge(ranks, x + y) == [ranks[x], ranks[y]]:
                ranks[x + y] = len(ranks)
        ranks[b"cabcabcac"] = len(ranks) + 5
        bpe, ref = B.Backtracker(ranks), library(ranks, r".+")
        for _ in range(200):
            s = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            assert bpe.encode_piece(s.encode()) == ref.encode_ordinary(s), (ranks, s)


def test_memory_is_bounded(encoder):
    small = B.Encoder(PATH, P.PATTERN, cache_pieces=10)
    small.bpe.memo_pairs = 50
    for k in range(300):
        assert small.encode(f"pre{k}token x{k}y") == encoder.encode(f"pre{k}token x{k}y")
    assert len(small.cache.new) + len(small.cache.old) <= 30 and len(small.bpe.memo) <= 50


def test_a_long_piece_takes_linear_time(encoder):
    import time
    for s in ("a" * 400_000, "ab" * 200_000, " " * 400_000, "-=" * 150_000):
        t = time.perf_counter()
        got = encoder.encode(s)
        assert B.decode_ids(got, PATH) == s.encode() and time.perf_counter() - t < 10


def test_query_on_whole_table(spark, sf_small, encoder):
    ref = library(encoder.bpe.ranks)
    want = {}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        ids, text = ref.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
    got = Q.op13_byte_bpe(spark, sf_small).collect()
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_edges(spark, encoder):
    ref = library(encoder.bpe.ranks)
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "x <|endoftext|> y", 0), (3, "long " * 50_000, 0), (4, "z" * 100_000, 0), (5, "\x00 é", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in B.decode(B.encode(df, PATH, P.PATTERN), PATH).collect()]
    want = [(d, np.array(ref.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert B.encode(df.limit(0), PATH, P.PATTERN).count() == 0
