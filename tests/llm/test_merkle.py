"""Merkle manifest against a plain build over lists, and the closed-form positions against the log itself."""

import hashlib
import zlib

import pytest

from foldwise.llm import merkle as M
from foldwise.llm import queries as Q
from foldwise.session import materialize

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, lower=False):
    r = dict(r)
    if lower and r["text"] is not None:
        r["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[c] for c in M.COLUMNS)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, i):
    others = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        others.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return others


def plain(rows):
    """``{(doc_id, leaf): [(subroot, root, proof, folded, verified)...]}`` by the contract's words."""
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for s in keys:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        lower[s] = levels_of([leaf(r) for r in trees[s]])
    top = levels_of([lower[s][-1][0] for s in keys])
    root, out = top[-1][0], []
    for j, s in enumerate(keys):
        for i, r in enumerate(trees[s]):
            others = way(lower[s], i) + way(top, j)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf(r, lower=tampered)
            for a, b in others:
                node = sha("".join(a) + node + "".join(b))
            out.append((r["doc_id"], leaf(r), lower[s][-1][0], root, sha("".join("".join(a) + "".join(b) for a, b in others)),
                        node, node == root))
    return out


def run(monkeypatch, spark, df):
    monkeypatch.setattr(Q, "table", lambda *_: df)
    return [tuple(r) for r in Q.op11_merkle_manifest(spark, "").collect()]


def row_key(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 4097])
def test_positions_find_the_nodes_of_the_log(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    top = M.height(n)
    log = M.append_log(leaves, top)
    levels = levels_of([x.hex() for x in leaves])
    assert len(levels) == top + 1 and len(log) == 32 * sum(map(len, levels))
    seen = set()
    for level, nodes in enumerate(levels):
        assert len(nodes) == M.width(level, n)
        for j, node in enumerate(nodes):
            at = M.position(level, j, n, top)
            seen.add(at)
            assert log[32 * at:32 * at + 32].hex() == node
    assert seen == set(range(len(log) // 32))
    for i in {0, n // 2, n - 1}:
        assert M.fold(leaves[i], M.siblings(log, n, top)[i], M.steps(i, n)) == log[-32:]


def test_query_on_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = sorted(plain([r.asDict() for r in docs.collect()]), key=row_key)
    got = [tuple(r) for r in Q.op11_merkle_manifest(spark, sf_small).collect()]
    assert sorted(got, key=row_key) == want
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_trees_of_several_layers_and_many_sources(monkeypatch, spark):
    # one source over three builder layers' sizes (a third of all rows and more), 300 sources, most of one or two rows
    rows = [(k, "hot", "en", 1, f"Text {k}") for k in range(70_000)]
    rows += [(k, f"s{k % 299}", None, None, "Ab") for k in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    want = sorted(plain([dict(zip(M.COLUMNS, r)) for r in rows]), key=row_key)
    assert sorted(run(monkeypatch, spark, df), key=row_key) == want


def test_log_positions_of_segments(spark):
    n = 600
    rows = [(k, "a", None, None, str(k)) for k in range(n)]
    log = M.build(spark.createDataFrame(rows, DOCS)).log().where("layer = 0").orderBy("seg").collect()
    assert [r["first_position"] for r in log] == [M.position(0, 256 * s, n, M.height(n)) for s in range(3)]


def test_edges(monkeypatch, spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "x", 3, ""), (None, None, "x", 3, "É ÀA"),
            (5, "b", "en", -4, "A" * 200_000), (5, "b", "en", -4, "B"), (7, "é", "en", 0, "aZ"), (2, "b", "en", 0, "A-b")]
    df = spark.createDataFrame([r + ("t",) * 6 for r in rows], DOCS + ", tree string, idx string, n string, digest string, path string, root string")
    want = sorted(plain([dict(zip(M.COLUMNS, r)) for r in rows]), key=row_key)
    assert sorted(run(monkeypatch, spark, df), key=row_key) == want
    assert run(monkeypatch, spark, df.limit(0)) == []
    one = spark.createDataFrame(rows[:1], DOCS)
    assert sorted(run(monkeypatch, spark, one)) == plain([dict(zip(M.COLUMNS, rows[0]))])


def test_any_change_of_a_leaf_is_found(spark):
    from pyspark.sql import functions as F
    rows = [(k, f"s{k % 3}", "en", 1, "x" * k) for k in range(100)]
    proofs = materialize(M.build(spark.createDataFrame(rows, DOCS)).proofs())
    ok = M.folded(proofs, "leaf").where(F.col("folded_root") == F.col("root")).count()
    wrong = M.folded(proofs.withColumn("other", F.unhex(F.sha2(F.hex("leaf"), 256))), "other")
    assert ok == 100 and wrong.where(F.col("folded_root") == F.col("root")).count() == 0
