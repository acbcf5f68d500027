"""Spaced-seed decontamination: planted overlaps with substitutions, and whole tables against direct alignment."""

import random

import numpy as np

from foldwise.llm import decontaminate as D
from foldwise.llm import queries as Q


def words(t):
    return (t or "").encode().lower().split()


def brute(docs, items):
    """Pairs with a run of MIN_WORDS equal words (or a whole short item): a subset that no method may miss."""
    grams = {}
    for i, t in items:
        w = words(t)
        m = min(D.MIN_WORDS, len(w))
        if len(w) >= D.MIN_ITEM:
            for k in range(len(w) - m + 1):
                grams.setdefault((m, tuple(w[k:k + m])), set()).add(i)
    sizes = {m for m, _ in grams}
    out = set()
    for d, t in docs:
        w = words(t)
        for m in sizes:
            for k in range(len(w) - m + 1):
                for i in grams.get((m, tuple(w[k:k + m])), ()):
                    out.add((d, i))
    return out


def test_query_on_whole_table(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    rows = Q.op5_decontaminate(spark, sf_small).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got and got >= brute(docs, items)
    text, item = dict(docs), dict(items)
    for r in rows:  # each reported run is there, and holds what it says
        w, q = words(text[r["doc_id"]])[r["start"]:][:r["n_words"]], words(item[r["item_id"]])
        assert r["n_equal"] >= D.MIN_SHARE * r["n_words"]
        assert any(sum(x == y for x, y in zip(w, q[j:j + len(w)])) == r["n_equal"] for j in range(len(q) - len(w) + 1))


def test_substitutions_are_tolerated(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 50)))) for i in range(20)]
    docs, want = [], set()
    for d in range(60):
        body = [word() for _ in range(200)]
        if d % 2:
            i, t = items[d % 20]
            t = t.split()
            for k in range(rng.randrange(5), len(t), 11):  # one substitution in every 11 words
                t[k] = word()
            body[70:70] = t
            want.add((d, i))
        docs.append((d, " ".join(body)))
    got = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_parts_give_the_same_result(spark, sf_small, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, D.find_overlaps(docs, items).collect()))
    monkeypatch.setattr(D, "PART_WORDS", 700)
    assert sorted(map(tuple, D.find_overlaps(docs, items).collect())) == whole


def test_edges(spark):
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c d", 0), (4, "one two three four five six", 0), (None, "q " * 30, 0)],
                                  "item_id long, text string, start int")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f"), (4, "zero ONE two three four five six seven"),
                                  (4, "zero ONE two three four five six seven"), (5, "w " * 100_000), (None, "one two three four five six")],
                                 "doc_id long, text string")
    assert [tuple(r) for r in D.find_overlaps(docs, items).collect()] == [(4, 4, 1, 6, 6)]
    assert D.find_overlaps(docs, items.limit(0)).count() == 0
    assert D.find_overlaps(docs.limit(0), items).count() == 0


def test_one_substitution_leaves_a_seed():
    h = np.arange(12, dtype=np.uint64)
    for k in range(12):
        g = h.copy()
        g[k] = np.uint64(99)
        assert any((D.seeds(h, m) == D.seeds(g, m)).all() for m in D.MASKS)


def test_loose_neighbours_do_not_hide_a_core(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items, docs, least = [], [], {}
    for d, (core, blocks) in enumerate([(13, 0), (13, 5), (13, 20), (30, 12)]):
        item = [word() for _ in range(core + 7 * blocks)]
        copy = [word() if k >= core and (k - core) % 7 < 2 else w for k, w in enumerate(item)]
        for turn in (1, -1):  # the loose part behind the core, and before it
            items.append((len(items), " ".join(item[::turn])))
            docs.append((len(docs), " ".join([word() for _ in range(40)] + copy[::turn] + [word() for _ in range(40)])))
            least[len(docs) - 1] = core
    got = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d) for d in least}
    assert all(r["n_equal"] >= least[r["doc_id"]] and r["n_equal"] >= D.MIN_SHARE * r["n_words"] for r in got)


def test_best_run_against_all_runs():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n, least = int(rng.integers(1, 45)), int(rng.integers(5, 14))
        same = rng.random(n) < rng.choice([0.5, 0.7, 0.8, 0.9])
        runs = [(int(same[a:b].sum()), b - a) for a in range(n) for b in range(a + least, n + 1)
                if 5 * int(same[a:b].sum()) >= 4 * (b - a)]
        got = D._best_run(same, least)
        assert (got is None) == (not runs)
        if got:
            a, b = got
            equal = max(e for e, _ in runs)
            assert 0 <= a and b <= n and (equal, b - a) in runs and int(same[a:b].sum()) == equal
            assert b - a == least or same[a] and same[b - 1]


def test_every_passage_that_meets_the_rule_is_found():
    """Random substitutions down to the rule's share, in whole items of 5 words and more."""
    rng = np.random.default_rng(5)
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    for n in [*range(5, 26), 30, 60]:
        for k in range(n // 5 + 1):
            items = [" ".join(f"w{x}" for x in word(n)) for _ in range(30)]
            part = D.index_items([(i, t.encode()) for i, t in enumerate(items)])
            hs = []
            for i in range(30):
                body = np.concatenate([word(40), part.words[part.start[i]:part.start[i + 1]], word(40)])
                body[40 + rng.choice(n, k, replace=False)] = word(k)
                hs.append(body)
            got = D.overlaps(part, np.concatenate(hs), np.cumsum([0] + [len(x) for x in hs]))
            assert {(t, i) for t, i, *_ in got} == {(i, i) for i in range(30)}, (n, k)


def test_seeds_lose_no_run():
    """Every placing of the substituted words that meets the rule leaves a seed, and nothing else is reported."""
    from itertools import combinations
    for n in range(5, 26):
        item = np.arange(1, n + 1, dtype=np.uint64)
        masks = D.MASKS if n >= D.MIN_WORDS else D.short_masks(n)
        for gone in combinations(range(n), n // 5):
            copy = item.copy()
            copy[list(gone)] = 0
            assert any((D.seeds(item, m) == D.seeds(copy, m)).any() for m in masks), (n, gone)
    part = D.index_items([(0, " ".join(f"a{k}" for k in range(12)).encode())])
    copy = part.words.copy()
    copy[[1, 5, 9]] = 7  # 9 of 12
    assert D.overlaps(part, copy, np.array([0, 12])) == []


def test_hits_in_small_lots_give_the_same(monkeypatch):
    part = D.index_items([(0, b"q " * 30), (1, b"r " * 30)])
    h = np.concatenate([part.words, part.words[20:50]])
    starts = np.array([0, 25, 25, 60, 90])
    whole = D.overlaps(part, h, starts)
    assert {t for t, *_ in whole} == {0, 2, 3}
    monkeypatch.setattr(D, "_HITS", 5)
    assert D.overlaps(part, h, starts) == whole
