"""N-gram Jaccard join: components and sizes against all pairs."""

import random
from fractions import Fraction

import numpy as np

from foldwise.llm import jaccard as J
from foldwise.llm import queries as Q
from foldwise.llm.common import WordHashes, shingles


def shingle_set(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(docs, share=Fraction(9, 10)):
    """doc_id -> (size, component) by comparing all pairs that share a word n-gram."""
    s = {d: shingle_set(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, x in s.items():
        for g in x:
            by.setdefault(g, []).append(d)
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                inter = len(s[a] & s[b])
                if inter * share.denominator >= share.numerator * (len(s[a]) + len(s[b]) - inter):
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
    return {d: (len(s[d]), root(d)) for d in docs}


def test_query_on_whole_table(spark, sf_small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op1_jaccard_join(spark, sf_small).collect()}
    assert got == brute(docs)


def test_chains_and_groups(spark):
    """Near copies at the limit: chains whose ends are far apart, groups around a base, edits of one word."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, k = {}, 0
    for _ in range(6):
        base = [word() for _ in range(rng.choice((4, 12, 40, 90, 200)))]
        docs[k], k = " ".join(base), k + 1
        cur = list(base)
        for _ in range(25):
            t = list(rng.choice((base, cur)))
            for _ in range(rng.choice((1, 1, 2))):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += [word()]
            cur = t
            docs[k], k = " ".join(t), k + 1
    ids = list(docs)
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_components(df).collect()}
    assert got == brute(docs)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(0)
    for share in (Fraction(9, 10), Fraction(8, 10)):
        bands = J.Bands(share)
        for _ in range(1500):
            m = int(rng.choice([1, 2, 5, 9, 10, 11, 19, 20, 57, 300]))
            base = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2))
            drop = rng.integers(0, max(1, int(m * 0.12)) + 1)
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, rng.integers(0, 1 + m // 9), dtype=np.uint64)]))
            inter = len(np.intersect1d(base, other))
            if len(other) and Fraction(inter, len(base) + len(other) - inter) >= share:
                assert len(np.intersect1d(J.signatures(base, bands), J.signatures(other, bands)))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "a", 1), (5, "A", 1), (5, "A", 1), (None, "a", 1),
                                (6, "a b", 1), (7, "x " * 50_000, 1), (8, "x x x", 2)], "doc_id long, text string, sig int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.link_components(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7)]
    assert J.link_components(df.limit(0)).count() == 0


def test_shingles_count_distinct():
    h = WordHashes()
    assert len(shingles(h(b"a b a b a b".split()), 3)) == 2
    assert len(shingles(h(b"a b".split()), 3)) == 1


def test_sketch_never_exceeds_the_difference(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    rows, want = [], []
    for m in (5, 40, 200, 900):
        base = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2))
        for cut in (0, 1, m // 10, m // 2):
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)]))
            a, b = J.sketch(base, 4 * 21), J.sketch(other, 4 * 21)
            rows.append((a.tolist(), b.tolist()))
            plain = sum((x.to_bytes(8, "little", signed=True)[k] != y.to_bytes(8, "little", signed=True)[k])
                        for x, y in zip(a.tolist(), b.tolist()) for k in range(8))
            assert plain <= len(np.setxor1d(base, other))
            want.append(plain)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert [r[0] for r in df.select(J._differing(F.col("a"), F.col("b"))).collect()] == want


def test_small_sketch_of_the_signature_s_band(spark):
    """A signature names the parity of its band, so a row needs one sketch; its fields never exceed the difference."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    bands, rows, want = J.Bands(Fraction(4, 5)), [], []
    for m in (1, 5, 40, 200, 900):
        base = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2))
        own = bands.of(len(base))
        sigs = J.signatures(base, bands)
        for band in (own, own + 1):
            assert np.any(sigs & np.uint64(0xFFFF) == np.uint64(band & 1))
        assert np.all(sigs & np.uint64(0xFFFF) <= 1)
        for cut in (0, 1, m // 10, m // 2):
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)]))
            parts = J.SKETCH * (bands.differ(own) + 1)
            a, b = J.sketch(base, parts, J.SKETCH_BITS), J.sketch(other, parts, J.SKETCH_BITS)
            assert len(a) == -(-parts // (63 // J.SKETCH_BITS)) and a.min() >= 0 and b.min() >= 0
            each = 1 << J.SKETCH_BITS
            plain = sum(x // each**k % each != y // each**k % each for x, y in zip(a.tolist(), b.tolist()) for k in range(63 // J.SKETCH_BITS))
            assert plain <= len(np.setxor1d(base, other))
            rows.append((a.tolist(), b.tolist()))
            want.append(plain)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert [r[0] for r in df.select(J._differing(F.col("a"), F.col("b"), J.SKETCH_BITS)).collect()] == want


def test_links_between_members_of_a_signature_join_across_bands(spark):
    """Members apart from their centre, of one band and of neighbouring ones, repeated ids with other texts among them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, k = {}, 0
    for _ in range(8):
        base = [word() for _ in range(rng.choice((30, 60, 150)))]
        for _ in range(14):
            t = base[:len(base) - rng.randrange(len(base) // 4)]
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = word()
            docs[k], k = " ".join(t), k + 1
    share = Fraction(4, 5)
    df = spark.createDataFrame([*docs.items(), *[(d, t) for d, t in docs.items() if d % 5 == 0]], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_components(df, 3, share).collect()}
    assert got == brute(docs, share)


def test_texts_are_signed_once(spark, monkeypatch):
    signed_rows, plain = spark.sparkContext.accumulator(0), J._posts

    def counted(*args):
        work = plain(*args)

        def count(it):
            def seen():
                for b in it:
                    signed_rows.add(b.num_rows)
                    yield b
            yield from work(seen())
        return count

    monkeypatch.setattr(J, "_posts", counted)
    texts = [" ".join(f"w{i % 7}_{k}" for k in range(30)) for i in range(40)] + [None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r["component_id"] for r in J.link_components(df).collect()}
    assert signed_rows.value == len(texts) == len(rows)
    assert [rows[i] for i in range(40)] == [i % 7 for i in range(40)] and [rows[40], rows[41], rows[42]] == [40, 41, 42]
