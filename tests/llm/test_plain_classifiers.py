"""op2 and op6 computed again in plain Python on a small table: features, document frequencies, training and scores."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from foldwise.llm import langid, quality

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


class PlainFtrl:
    """Proximal updates one coordinate at a time, in dictionaries."""

    def __init__(self, classes, bias, alpha, l1, l2, beta=1.0):
        self.c, self.bias, self.alpha, self.l1, self.l2, self.beta = classes, bias, alpha, l1, l2, beta
        self.z, self.n = [{} for _ in range(classes)], [{} for _ in range(classes)]

    def w(self, k, i):
        z, n = self.z[k].get(i, 0.0), self.n[k].get(i, 0.0)
        l1, l2 = (0.0, 0.0) if i == self.bias else (self.l1, self.l2)
        return 0.0 if abs(z) <= l1 else -math.copysign(abs(z) - l1, z) / ((self.beta + math.sqrt(n)) / self.alpha + l2)

    def raw(self, k, row):
        return sum(self.w(k, i) * v for i, v in row.items()) + self.w(k, self.bias)

    def errors(self, row, label):
        if self.c == 1:
            return [1 / (1 + math.exp(-self.raw(0, row))) - label]
        raw = [self.raw(k, row) for k in range(self.c)]
        e = [math.exp(x - max(raw)) for x in raw]
        return [x / sum(e) - (k == label) for k, x in enumerate(e)]

    def fit(self, rows, labels, passes):
        for p in range(passes):
            for at in np.random.default_rng(p).permutation(len(rows)):
                err = self.errors(rows[at], labels[at])
                for k in range(self.c):
                    for i, v in [*rows[at].items(), (self.bias, 1.0)]:
                        g, w, n = err[k] * v, self.w(k, i), self.n[k].get(i, 0.0)
                        self.z[k][i] = self.z[k].get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
                        self.n[k][i] = n + g * g
        return self


def _mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


GOLD = 0x9E3779B97F4A7C15


def word_features(text, p):
    pieces = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        if len(w) > 1 and w.isupper():
            pieces.append(b"\x00up")
        pieces += re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+", w.lower())
    h = [xxhash.xxh3_64_intdigest(x) for x in pieces]
    grams = h + [0x5DEECE66D if a == b else _mix((a * GOLD + b) & M64) for a, b in zip(h, h[1:])]
    row = {}
    for g in grams:
        i = (g * GOLD & M64) >> (64 - p.bits)
        row[i] = row.get(i, 0.0) + p.scale / len(grams)
    return row


def char_features(text, p):
    cp, out = [ord(c) for c in text.lower()], {}
    for s in range(len(cp)):
        h = 1
        for n in range(p.orders):
            if s + n >= len(cp):
                break
            h = ((h ^ cp[s + n]) * 0x9E3779B1 + n) & M32
            h ^= h >> 15
            i = (h * 0x85EBCA6B & M32) >> (32 - p.bits)
            out[i] = out.get(i, 0) + 1
    return out


def _docs(n=90):
    rng = random.Random(12)
    langs = {"aa": "el la casa Señor 12 que, y", "bb": "the house IS big and so on.", "cc": "das haus ist groß und so !!"}
    out = []
    for k in range(n):
        lang = rng.choice(list(langs))
        out.append((k, " ".join(rng.choice(langs[lang].split()) for _ in range(rng.randrange(1, 25))), lang if k % 7 else None))
    return out + [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "?! 12", "cc")]


def test_quality_by_hand(spark):
    docs = _docs()
    labels = [(i, int("house" in (t or "") or "casa" in (t or ""))) for i, t, _ in docs if i % 4]
    p = quality.Params(bits=12, sample_rows=1_000_000, passes=3)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, quality.fit(df, lab, p), p).collect()}
    text = {i: t for i, t, _ in docs}
    plain = PlainFtrl(1, 1 << p.bits, p.alpha, p.l1, p.l2).fit([word_features(text[i], p) for i, _ in labels], [y for _, y in labels], p.passes)
    for i, t, _ in docs:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-plain.raw(0, word_features(t, p)))), abs=1e-5)


def test_language_by_hand(spark):
    docs = _docs()
    p = langid.Params(bits=11, sample_rows=1_000_000, passes=2)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df, p)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, p).collect()}
    known = [(t, lang) for _, t, lang in docs if t is not None and lang is not None]
    df_of = {}
    for t, _ in known:
        for i in char_features(t, p):
            df_of[i] = df_of.get(i, 0) + 1
    names = sorted({lang for _, lang in known})

    def row(t):
        w = {i: (1 + math.log(tf)) * (math.log((1 + len(known)) / (1 + df_of.get(i, 0))) + 1) for i, tf in char_features(t, p).items()}
        norm = max(math.sqrt(sum(x * x for x in w.values())), 1e-12)
        return {i: x / norm for i, x in w.items()}

    fitted = [x for k, x in enumerate(known) if k % 4 != 3]
    plain = PlainFtrl(len(names), 1 << p.bits, p.alpha, p.l1, p.l2).fit([row(t) for t, _ in fitted], [names.index(g) for _, g in fitted], p.passes)

    def probabilities(t, heat):
        raw = [plain.raw(k, row(t)) / heat for k in range(len(names))]
        e = [math.exp(x - max(raw)) for x in raw]
        return [x / sum(e) for x in e]

    # the temperature is where the held-back quarter has the least loss
    back = [x for k, x in enumerate(known) if k % 4 == 3]
    loss = lambda heat: sum(-math.log(max(probabilities(t, heat)[names.index(g)], 1e-12)) for t, g in back) / len(back) + 1e-4 * math.log(heat) ** 2
    assert loss(model.temperature) <= min(loss(model.temperature * f) for f in (0.9, 0.97, 1.03, 1.1)) + 1e-6
    for i, t, _ in docs:
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        want = probabilities(t, model.temperature)
        assert got[i][0] == names[want.index(max(want))] and got[i][1] == pytest.approx(max(want), abs=1e-3)
