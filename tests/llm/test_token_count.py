"""Token counts by distinct piece against the library on every text."""

import public_tokenizers
import pytest

from foldwise.llm import queries as Q
from foldwise.llm import tok
from foldwise.llm import token_count as C

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = ["", "a  b\n\n c", "<|endoftext|> x", "ǅ İ Σας ΣΑΣ ﬁ", "don't DON'T we'll\t\tx", "１２ ２³ a²b", "x\x1cy z w", "日本語 текст",
       "é é", " lead", "x\r\ny \n z", "isn't 's 't", "a  \n b\n\n\tc  ", "a\n b", "a \nb", " x ", "tab\tsep \t two"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name, sf_small, spark):
    import numpy as np
    p = tok.Pieces(public_tokenizers.path(name))
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").limit(60).collect()]
    texts += [a + b for a in ODD for b in ODD]
    for t in texts:
        want = np.array(p.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert p.ids(t) == want, repr(t)


def test_cache_is_bounded():
    p = tok.Pieces(PATH, cache_pieces=5)
    for k in range(50):
        p.ids(f"word{k} other{k}")
    assert len(p.cache) <= 12


@pytest.mark.parametrize("head", [0, 50, 200_000])
def test_query_on_whole_table(spark, sf_small, head):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    t = tok.pieces(PATH).tokenizer
    if head == 200_000:
        rows = Q.op10_token_count(spark, sf_small).collect()
    else:
        rows = C.count_tokens(spark.read.parquet(f"{sf_small}/documents.parquet"), PATH, head_pieces=head).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(t.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"]) == (len(docs[r["doc_id"]].encode()), n)
        if head == 200_000:
            assert r["over_limit"] == (n > 2048)


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "one two", 1), (3, "one two", 1), (3, "other text entirely", 1), (None, "x y z", 1),
            (5, "<|endoftext|> 日本", 1), (6, "long " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    t = tok.pieces(PATH).tokenizer
    want = sorted({(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, _ in rows}, key=repr)
    for head in (0, 100):
        got = sorted((tuple(r) for r in C.count_tokens(df, PATH, head_pieces=head).collect()), key=repr)
        assert got == want
    assert C.count_tokens(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_other_scripts_give_the_library_ids(name):
    import random
    p, rng = tok.Pieces(public_tokenizers.path(name)), random.Random(9)
    ranges = [(0x20, 0x300), (0x20, 0x3000), (0x300, 0x370), (0x2000, 0x2100), (0x1100, 0x1200), (0xAC00, 0xAC80), (0xFB00, 0xFFFF)]
    for _ in range(3000):
        lo, hi = rng.choice(ranges)
        t = "".join(chr(rng.randrange(lo, hi)) if rng.random() < .7 else rng.choice(" \n\t'sa1.") for _ in range(rng.randrange(25)))
        assert p.cut(t) is not None and p.ids(t) == p.encode_whole(t), repr(t)
