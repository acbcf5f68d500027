"""Adaptive context-mixing range coder for blocks of token ids.

Each block is coded by itself: all models start anew. A token is first predicted by the id that followed the last two
ids (order 2), or else the last one (order 1); how far either is to be trusted, and how often predictions held lately
(order 0), are adaptive probabilities that a small online mixer joins in the logistic domain. If the prediction fails,
the id is coded by an adaptive order-0 model of its bit length, and its lower bits follow as they are. All coding and
learning is integer arithmetic, so any machine decodes alike.

The blocks of a call are coded side by side, one lane each: step ``t`` codes token ``t`` of every block that has one.
A coded block is a list of 16-bit words, most significant byte first. The range coder keeps 32 bits; a carry out of
``low`` is added to the word before and settled at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

TABLE_BITS = 10
LANES = 512
CLASSES = 18        # bit lengths 1 to 17 of the id plus one; the last class holds all longer ones
REBUILD = 16        # steps after which the order-0 intervals follow the counts
_TOP = 1 << 32
_LEAST = 1 << 16
_PLUS = 32          # added to the count of a class that occurred
_MOST = 1 << 13     # sum of counts at which they are halved

# 4096 / (1 + 2^(-x / 177)) in whole steps would need a transcendental function; a cubic blend is exact.
_X = np.arange(-2048, 2048, dtype=np.int64)
_HALF = np.minimum(2047, np.abs(_X))
_RISE = 2048 - (2048 - _HALF) ** 3 // 2048 ** 2          # 0 to 2047, steep at first as a logistic curve
SQUASH = np.clip(np.where(_X < 0, 2048 - _RISE, 2048 + _RISE), 1, 4095)
STRETCH = np.clip(np.searchsorted(SQUASH, np.arange(4096), "left"), 1, 4095) - 2048


class _Encoder:
    def __init__(self, lengths: np.ndarray) -> None:
        n = len(lengths)
        room = 4 * lengths + 8
        self.at = np.cumsum(room) - room + 1  # one word before, for a carry
        self.first = self.at.copy()
        self.out = np.zeros(int(room.sum()) + 1, np.int64)
        self.low = np.zeros(n, np.int64)
        self.range = np.full(n, _TOP - 1, np.int64)

    def code(self, lanes, low, freq, bits) -> None:
        """An interval ``[low, low + freq)`` of ``2^bits`` in each of ``lanes``."""
        r = self.range[lanes] >> bits
        base = self.low[lanes] + r * low
        r = r * freq
        at = self.at[lanes]
        over = base >= _TOP
        if over.any():
            self.out[at[over] - 1] += 1
            base = np.where(over, base - _TOP, base)
        small = np.flatnonzero(r < _LEAST)
        if len(small):
            self.out[at[small]] = base[small] >> 16
            base[small] = (base[small] << 16) & (_TOP - 1)
            r[small] <<= 16
            at[small] += 1
            self.at[lanes] = at
        self.low[lanes] = base
        self.range[lanes] = r

    def bit(self, m: int, p, y) -> None:
        """One decision in each of the first ``m`` lanes; ``p`` of 4096 is the share of ``y``."""
        left = (self.range[:m] >> 12) * p
        low = self.low[:m]
        low += np.where(y, 0, left)
        rng = np.where(y, left, self.range[:m] - left)
        over = np.flatnonzero(low >= _TOP)
        if len(over):
            self.out[self.at[over] - 1] += 1
            low[over] -= _TOP
        small = np.flatnonzero(rng < _LEAST)
        if len(small):
            self.shift(small, rng)
        self.range[:m] = rng

    def shift(self, lanes, rng) -> None:
        base, at = self.low[lanes], self.at[lanes]
        self.out[at] = base >> 16
        self.low[lanes] = (base << 16) & (_TOP - 1)
        rng[lanes] <<= 16
        self.at[lanes] = at + 1

    def finish(self) -> list[bytes]:
        for shift in (16, 0):
            self.out[self.at] = (self.low >> shift) & 0xFFFF
            self.at += 1
        while len(over := np.flatnonzero(self.out > 0xFFFF)):
            np.subtract.at(self.out, over, 1 << 16)
            np.add.at(self.out, over - 1, 1)
        words = self.out.astype(">u2")
        return [words[a:b].tobytes() for a, b in zip(self.first, self.at)]


class _Decoder:
    def __init__(self, data: Sequence[bytes]) -> None:
        size = np.array([len(d) // 2 for d in data])
        self.at = np.cumsum(size + 4) - size - 4
        self.words = np.frombuffer(b"".join(d + bytes(8) for d in data), ">u2").astype(np.int64)
        self.code = (self.words[self.at] << 16) | self.words[self.at + 1]
        self.at += 2
        self.range = np.full(len(data), _TOP - 1, np.int64)

    def point(self, lanes, bits):
        """Where the code lies in ``[0, 2^bits)``, and the unit."""
        r = self.range[lanes] >> bits
        return np.minimum(self.code[lanes] // r, (1 << bits) - 1), r

    def take(self, lanes, r, low, freq) -> None:
        code = self.code[lanes] - r * low
        r = r * freq
        small = np.flatnonzero(r < _LEAST)
        if len(small):
            at = self.at[lanes]
            code[small] = (code[small] << 16) | self.words[at[small]]
            r[small] <<= 16
            at[small] += 1
            self.at[lanes] = at
        self.code[lanes] = code
        self.range[lanes] = r

    def bit(self, m: int, p):
        left = (self.range[:m] >> 12) * p
        code = self.code[:m]
        y = code < left
        code -= np.where(y, 0, left)
        rng = np.where(y, left, self.range[:m] - left)
        small = np.flatnonzero(rng < _LEAST)
        if len(small):
            at = self.at[small]
            self.code[small] = (self.code[small] << 16) | self.words[at]
            rng[small] <<= 16
            self.at[small] = at + 1
        self.range[:m] = rng
        return y


class _Model:
    """The models of all lanes. Ids are held plus one, so that 0 is no prediction; table entries are id and trust."""

    def __init__(self, n: int) -> None:
        size = 1 << TABLE_BITS
        self.base = np.arange(n, dtype=np.int64) << TABLE_BITS
        self.next2, self.next1 = np.zeros(n * size, np.int64), np.zeros(n * size, np.int64)
        self.p = [np.full(n * 16, 1 << 15, np.int64) for _ in range(3)]  # by trust in order 2, order 1, by recent hits
        self.weight = [np.full(n, 22000, np.int64) for _ in range(3)]
        self.counts = np.ones((n, CLASSES), np.int64)
        self.edges = np.empty((n, CLASSES + 1), np.int64)
        self.recent = np.zeros(n, np.int64)
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.lane16 = np.arange(n, dtype=np.int64) << 4

    def rebuild(self, m: int) -> None:
        """Order-0 intervals of 4096 in proportion to the counts, none empty."""
        counts = self.counts[:m]
        full = np.flatnonzero(counts.sum(axis=1) > _MOST)
        counts[full] = (counts[full] + 1) >> 1
        upto = np.cumsum(counts, axis=1)
        self.edges[:m, 0] = 0
        self.edges[:m, 1:] = upto * (4096 - CLASSES) // upto[:, -1:] + np.arange(1, CLASSES + 1)

    def predict(self, m: int):
        last1 = self.last1[:m]
        mask = (1 << TABLE_BITS) - 1
        self.i1 = (last1 * 40503 >> 4 & mask) + self.base[:m]
        self.i2 = (last1 * 2654435761 + self.last2[:m] * 40503 >> 9 & mask) + self.base[:m]
        self.e2, self.e1 = self.next2.take(self.i2), self.next1.take(self.i1)
        self.a2, self.a1 = self.e2 >> 4, self.e1 >> 4
        self.guess = np.where(self.a2 > 0, self.a2, self.a1)
        lane = self.lane16[:m]
        self.at = (lane + (self.e2 & 15), lane + (self.e1 & 15) * (self.a1 == self.guess), lane + self.recent[:m])
        self.q = [p.take(at) for p, at in zip(self.p, self.at)]
        self.s = [STRETCH.take(q >> 4) for q in self.q]
        w, s = self.weight, self.s
        dot = (w[0][:m] * s[0] + w[1][:m] * s[1] + w[2][:m] * s[2]) >> 16
        self.joint = SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2048)
        return self.joint

    def learn(self, m: int, y: np.ndarray) -> None:
        hit = y.astype(np.int64)
        err = ((hit << 12) - self.joint) * 6
        goal = hit << 16
        for w, s, p, q, at in zip(self.weight, self.s, self.p, self.q, self.at):
            w[:m] += (s * err + 0x8000) >> 16
            p[at] = q + ((goal - q) >> 5)
        recent = self.recent[:m]
        recent <<= 1
        recent |= hit
        recent &= 15

    def push(self, m: int, x: np.ndarray) -> None:
        """``x``: the ids plus one."""
        fresh = x << 4 | 1
        for table, at, e, a in ((self.next2, self.i2, self.e2, self.a2), (self.next1, self.i1, self.e1, self.a1)):
            trust = e & 15
            # held: trust grows; failed: trust falls by half, and an entry of little trust is replaced
            table[at] = np.where(a == x, e + (trust < 15), np.where(trust > 2, e - (trust + 1 >> 1), fresh))
        self.last2[:m] = self.last1[:m]
        self.last1[:m] = x


def _class(x: np.ndarray) -> np.ndarray:
    """Bit length less one of positive integers, the last class for all longer ones."""
    return np.minimum(np.frexp(x.astype(np.float64))[1] - 1, CLASSES - 1)


def _order(lengths: np.ndarray) -> np.ndarray:
    return np.argsort(-lengths, kind="stable")


def encode(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Each block of unsigned 32-bit ids as bytes."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    out: list[bytes] = [b""] * len(blocks)
    order = _order(lengths)
    for lo in range(0, len(blocks), LANES):
        pick = order[lo:lo + LANES]
        for k, data in zip(pick, _encode_lanes([blocks[k] for k in pick], lengths[pick])):
            out[k] = data
    return out


def _steps(lengths: np.ndarray) -> list[int]:
    """Lanes that still have a token at each step (lengths fall)."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left").tolist()


def _encode_lanes(blocks: list[np.ndarray], lengths: np.ndarray) -> list[bytes]:
    model, coder = _Model(len(blocks)), _Encoder(lengths)
    start = np.cumsum(lengths) - lengths
    ids = np.concatenate(blocks).astype(np.int64) + 1
    for t, m in enumerate(_steps(lengths)):
        if t % REBUILD == 0:
            model.rebuild(m)
        x = ids.take(start[:m] + t)
        p = model.predict(m)
        y = x == model.guess
        coder.bit(m, p, y)
        model.learn(m, y)
        lanes = np.flatnonzero(~y)
        if len(lanes):
            v = x[lanes]
            c = _class(v)
            low = model.edges[lanes, c]
            coder.code(lanes, low, model.edges[lanes, c + 1] - low, 12)
            model.counts[lanes, c] += _PLUS
            long = c == CLASSES - 1
            if long.any():
                for high, bits in ((v[long] >> 24, 9), (v[long] >> 16 & 255, 8)):
                    coder.code(lanes[long], high, 1, bits)
            bits = np.minimum(c, 16)
            coder.code(lanes, v & ((1 << bits) - 1), 1, bits)
        model.push(m, x)
    return coder.finish()


def decode(data: Sequence[bytes], lengths: Sequence[int]) -> list[np.ndarray]:
    """The ids of each block; ``lengths`` are their counts."""
    lengths = np.asarray(lengths, np.int64)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(data)
    order = _order(lengths)
    for lo in range(0, len(data), LANES):
        pick = order[lo:lo + LANES]
        for k, ids in zip(pick, _decode_lanes([data[k] for k in pick], lengths[pick])):
            out[k] = ids
    return out


def _decode_lanes(data: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    model, coder = _Model(len(data)), _Decoder(data)
    start = np.cumsum(lengths) - lengths
    ids = np.zeros(int(lengths.sum()), np.int64)
    for t, m in enumerate(_steps(lengths)):
        if t % REBUILD == 0:
            model.rebuild(m)
        p = model.predict(m)
        y = coder.bit(m, p)
        model.learn(m, y)
        x = model.guess.copy()
        lanes = np.flatnonzero(~y)
        if len(lanes):
            edges = model.edges[lanes]
            at, r = coder.point(lanes, 12)
            c = (edges <= at[:, None]).sum(axis=1) - 1
            row = np.arange(len(lanes))
            low = edges[row, c]
            coder.take(lanes, r, low, edges[row, c + 1] - low)
            model.counts[lanes, c] += _PLUS
            bits = np.minimum(c, 16)
            v = np.int64(1) << bits
            long = np.flatnonzero(c == CLASSES - 1)
            if len(long):
                v[long] = 0
                for bits_long in (9, 8):
                    at, r = coder.point(lanes[long], bits_long)
                    coder.take(lanes[long], r, at, 1)
                    v[long] = v[long] << bits_long | at
                v[long] <<= 16
            at, r = coder.point(lanes, bits)
            coder.take(lanes, r, at, 1)
            x[lanes] = v + at
        model.push(m, x)
        ids[start[:m] + t] = x
    ids -= 1
    return np.split(ids.astype(np.uint32), np.cumsum(lengths)[:-1])
