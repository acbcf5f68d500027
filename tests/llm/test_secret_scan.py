"""Secret scans: spans against the same rules written as regular expressions."""

import hashlib
import random
import re

import numpy as np

from foldwise.llm import automaton as A
from foldwise.llm import queries as Q
from foldwise.llm import secret_scan as S

REF = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
               lambda m: len(m[1]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    out = []
    for i, (rx, keep) in enumerate(REF.values()):
        out += [(m.start(), i, m.end()) for m in rx.finditer(text or "") if keep(m)]
    return sorted(out)


PARTS = ["token", "secret", "API_KEY", "apikey", "passWD", "=", ":", " ", "'", '"', "abcdef", "é", "AKIA",
         "ABCDEFGH01234567", "0123456789abcdef01234567", "x", "-", "ß", "\n"]


def test_spans_equal_regular_expressions():
    rng = random.Random(3)
    s = S.scanner()
    for _ in range(5000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        assert [x for x in s.spans(t.encode()) if x[1] < 3] == brute(t), t


def test_added_rules():
    s = S.scanner()
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "aZ" * 18 + " xoxb-123456789-ab eyJhbGci.eyJzdWIi.abc ghp_short"
    kinds = [S.RULES[k].kind for _, k, _ in s.spans(text.encode())]
    assert kinds == ["private_key", "github", "slack", "jwt"]


def test_minimal_automaton_equals_regex():
    for pattern in ("a(b|c)*d", "[0-9]{2,3}x?", "(ab|a)(c|bcd)", "\\x41+[^a-z]"):
        dfa = A.compile_rules([A.parse(pattern)], anchored=True)
        rx = re.compile(pattern.encode())
        rng = random.Random(1)
        for _ in range(500):
            t = bytes(rng.choice(b"abcdx0123A") for _ in range(rng.randrange(8)))
            s = 0
            for b in t:
                s = dfa.table[s, b]
            assert bool(dfa.accepts[s]) == bool(rx.fullmatch(t))
        # minimal: no two states are equal in outcome and moves
        assert len(np.unique(np.column_stack([dfa.accepts, dfa.table]), axis=0)) == len(dfa.table)


def test_query_on_whole_table(spark, sf_small):
    rows = {r["doc_id"]: r for r in Q.op9_secret_scan(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = brute(d["text"])
        names = list(REF)
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in names] == [sum(1 for _, j, _ in want if j == i) for i in range(3)]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "token=abcdef", 0), (3, "x" * 300_000, 1), (4, "token=abcdef", 1),
                                (4, "token=abcdef", 1)], "doc_id long, text string, found int")
    got = [(r["doc_id"], len(r["found"])) for r in S.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0), (2, 0), (None, 1), (3, 0), (4, 1), (4, 1)], key=repr)
    assert S.scan(df.limit(0)).count() == 0


def test_hostile_texts_take_linear_time():
    import time
    s = S.scanner()
    for text in (b"eyJ" * 350_000 + b" .eyJa", b"eyJa." * 200_000 + b" .eyJa", b"token= " * 150_000, b"-----BEGIN " * 90_000, b"AKIA" * 250_000,
                 b"eyJa" * 1000 + b".eyJb.c " + b"eyJ" * 300_000):
        t = time.perf_counter()
        s.spans(text)
        assert time.perf_counter() - t < 5, text[:20]
    found = s.spans(b"eyJa" * 1000 + b".eyJb.c " + b"eyJ" * 30_000 + b" eyJx.eyJy.z")
    assert [(a, S.RULES[k].kind, b) for a, k, b in found] == [(0, "jwt", 4007), (94009, "jwt", 94020)]


def test_starts_from_the_end_give_the_same_spans():
    rng, s = random.Random(6), S.scanner()
    parts = [b"eyJ", b".", b"eyJa", b" ", b"-", b"x", b"token", b"=", b"AKIA", b"AB12", b"0123abcdef", b"-----", b"BEGIN ", b"PRIVATE KEY"]
    for _ in range(1500):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        for one in s.spans_of:
            flags = one.starts(data)
            assert [p for p in range(len(data)) if flags[p]] == [p for p in range(len(data)) if one.longest(data, p) > p]
