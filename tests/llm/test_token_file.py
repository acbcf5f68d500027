"""Range coder and token files: exact round trips, and ids equal to the library's."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from foldwise.llm import queries as Q
from foldwise.llm import range_coder as R
from foldwise.llm import token_file as T


def reference_ids(text, name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [np.array([], np.uint32), np.array([0], np.uint32), np.array([2**32 - 1] * 50 + [0, 5, 7] * 30, np.uint32),
              rng.integers(0, 2**32, 500, dtype=np.uint64).astype(np.uint32),
              rng.zipf(1.3, 3000).clip(0, 50_000).astype(np.uint32), np.full(5000, 7, np.uint32)]
    blocks += [rng.integers(0, 1 << int(rng.integers(1, 32)), int(rng.integers(0, 400))).astype(np.uint32) for _ in range(300)]
    data = R.encode(blocks)
    for got, want in zip(R.decode(data, [len(b) for b in blocks]), blocks):
        assert (got == want).all() and len(got) == len(want)
    # blocks are coded independently: alone or among others, the bytes are the same
    assert R.encode([blocks[4]])[0] == data[4]
    assert len(data[5]) < 60  # a repeated id is learned


def test_carries():
    """Many improbable symbols drive `low` up against its limit, so that carries occur."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        b = [rng.choice(np.array([1, 65535, 131070, 2**31], np.uint32), 300) for _ in range(40)]
        assert all((x == y).all() for x, y in zip(R.decode(R.encode(b), [len(x) for x in b]), b))


def test_checksum_is_checked():
    ids = np.arange(10_000, dtype=np.uint32) % 777
    blocks, sizes, crcs = T.encode_frame(ids)
    assert (T.decode_frame(blocks, sizes, crcs) == ids).all()
    damaged = bytearray(blocks[1])
    damaged[100] ^= 1
    with pytest.raises(T.CorruptBlock):
        T.decode_frame([blocks[0], bytes(damaged), *blocks[2:]], sizes, crcs)


def test_query_on_whole_table(spark, sf_small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in Q.op7_token_file(spark, sf_small).collect()}
    start = 0
    for d, t in docs:
        ids = np.array(reference_ids(t) + [2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 50)
    monkeypatch.setattr(T, "BLOCK_IDS", 16)
    texts = [(3, None, 1), (1, "", 1), (2, "a  b\n\n c <|endoftext|> x", 1), (2, "a  b\n\n c <|endoftext|> x", 1), (None, "日本語 текст", 1),
             (9, "long words " * 3000, 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string, shard int")
    T.write(df, str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"))
    got = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in T.read(spark, str(tmp_path / "f")).orderBy("start").collect()]
    want, at = [], 0
    for d, t, _ in sorted(texts, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(reference_ids(t) + [2], "<u4")
        want.append((d, at, ids.tobytes()))
        at += len(ids)
    assert got == want
    T.write(df.limit(0), str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"))
    assert T.read(spark, str(tmp_path / "e")).count() == 0
