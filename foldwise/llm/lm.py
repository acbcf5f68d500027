"""Language-model scoring by deleted interpolation of unigrams and bigrams.

``P(w | u) = l2 c(u w)/c(u) + l1 c(w)/N + l0 1/(V + 1)``, with mixture weights by the bucket ``floor(log2 c(u))`` of
the context's frequency. The weights are learned by expectation-maximisation on held-out counts: every training
token is predicted from counts with that token itself deleted. Counts and held-out statistics cover every training
text; every text is scored, whole. Each text ends with one end token, which is also the context of its first word.

How the counts meet the texts without a row per n-gram:

1. Consecutive documents of a task form blocks of about ``BLOCK_WORDS`` words. A block sends its distinct hashes with
   their training counts as packed, sorted slices, one per hash range (bounded: the ranges follow the corpus size), so
   a word that stands in every text costs one entry per block.
2. A range adds up the counts of its hashes over all blocks and answers each block with the totals in its own order.
3. A block's text meets its answers, which leaves the counts of each token, packed by block.

Defined cases: a null or empty text is the end token alone; repeated rows are scored, and learned from, as often as
they occur; a null id is a value like any other (its row is learned from unless ``held_out`` is true); without
training rows every probability is 1/(V + 1) = 1; only the id and text columns and the flag are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import _GOLD, WordHashes, batches, id_text, mix
from .packed import pack, pack_sorted, slices, unpack, unpack_sorted

BLOCK_WORDS = 1_500_000
RANGE_WORDS = 1_000_000  # corpus words per hash range, so that a range's entries stay bounded
BUCKETS = 26             # context frequencies from 2^25 share the last bucket
STEPS = 4                # of a held-out probability per octave, in the statistics for EM
END = np.uint64(0x454E44)
UNSEEN = -1


# ---- blocks

class Block:
    """Consecutive documents of one task."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.texts: list[bytes] = []
        self.words = 0

    def add(self, doc_id, held, text: bytes) -> None:
        text = b" ".join(text.lower().split())
        self.ids.append(doc_id)
        self.held.append(bool(held))
        self.texts.append(text)
        self.words += text.count(b" ") + 2

    def key(self) -> int:
        """Depends on the block's documents alone."""
        h = xxhash.xxh3_64()
        for d, t in zip(self.ids, self.texts):
            h.update(f"{d}:{len(t)}:{xxhash.xxh3_64_intdigest(t)};")
        return h.intdigest() - (1 << 63)


def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for b, texts in batches(it):
        for d, held, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), texts):
            block.add(d, held, t)
            if block.words >= BLOCK_WORDS:
                yield block
                block = Block()
    if block.ids:
        yield block


def hashes(texts: list[bytes], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram and bigram hashes of every token, and the tokens of each text."""
    parts = [np.append(words(t.split()), END) for t in texts]
    uni = np.concatenate(parts)
    before = np.concatenate([[END], uni[:-1]]).astype(np.uint64)
    return uni, mix(before * _GOLD + uni), np.array([len(p) for p in parts])


MESSAGE = "block long, kind int, part long, hashes binary, counts binary"


def _messages(bits: int):
    """A block's distinct hashes with training counts, sliced by the top ``bits`` bits."""
    def work(it):
        words = WordHashes()
        for block in blocks(it):
            uni, bi, lens = hashes(block.texts, words)
            train = np.repeat(~np.array(block.held), lens)
            key, rows = block.key(), []
            for kind, h in ((1, uni), (2, bi)):
                at, inv = np.unique(h, return_inverse=True)
                n = np.bincount(inv[train], minlength=len(at)).astype(np.uint32)
                for part, lo, hi in slices(at, bits):
                    rows.append((key, kind, part, pack_sorted(at[lo:hi]), pack(n[lo:hi])))
            yield _batch(rows, ["block", "kind", "part", "hashes", "counts"])
    return work


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.int64())) for k, c in zip(names, zip(*rows))], names)


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one range: for each block in the order of its slice; ``block`` null carries tokens and types."""
    got = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    n = np.concatenate([unpack(b, np.uint32) for b in table.column("counts").to_pylist()])
    at, inv = np.unique(np.concatenate(got), return_inverse=True)
    total = np.bincount(inv, weights=n, minlength=len(at)).astype(np.int64)
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    each = np.split(total[inv], np.cumsum([len(g) for g in got])[:-1])
    rows = [(b, kind, part, pack(t.astype(np.uint64)), 0, 0) for b, t in zip(table.column("block").to_pylist(), each)]
    rows.append((None, kind, part, None, int(total.sum()), int((total > 0).sum())))
    names = ["block", "kind", "part", "totals", "tokens", "types"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _states(it):
    """A block's documents and text."""
    for block in blocks(it):
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.key()]), pa.array([block.ids], pa.list_(pa.int64())), pa.array([block.held], pa.list_(pa.bool_())),
             pa.array([zstandard.compress(b"\n".join(block.texts), 1)], pa.binary())], ["block", "ids", "held", "text"])


COUNTED = "block long, ids array<long>, held array<boolean>, lens array<int>, uni binary, bi binary"


def _meet(state: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of each token of a block: of the token (``uni``) and of the pair with the token before it (``bi``)."""
    out = []
    for i in range(state.num_rows):  # equal blocks (repeated documents) share a key and answers
        texts = zstandard.decompress(state.column("text")[i].as_py()).split(b"\n")
        uni, bi, lens = hashes(texts, WordHashes())
        packed = []
        for kind, h in ((1, uni), (2, bi)):
            mine = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("part")
            seen, total = {}, []
            for part, b in zip(mine.column("part").to_pylist(), mine.column("totals").to_pylist()):
                if part not in seen:
                    seen[part] = True
                    total.append(unpack(b, np.uint64))
            at, inv = np.unique(h, return_inverse=True)
            total = np.concatenate(total) if total else np.empty(0, np.uint64)
            if len(total) != len(at):
                raise RuntimeError("a block and its counts differ: the input changed while it was read")
            packed.append(pack(total[inv]))
        out.append((state.column("block")[i].as_py(), state.column("ids")[i].as_py(), state.column("held")[i].as_py(),
                    lens.astype(np.int32), *packed))
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["block", "ids", "held", "lens", "uni", "bi"])


def count(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Per block the training counts of each token, and the numbers of training tokens and types."""
    docs = id_text(df, id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(size / 6 / RANGE_WORDS, 1)))))
    answers = materialize(docs.mapInArrow(_messages(bits), MESSAGE).groupBy("kind", "part").applyInArrow(
        _answer, "block long, kind int, part long, totals binary, tokens long, types long"))
    n = answers.where(F.col("block").isNull() & (F.col("kind") == 1)).agg(F.sum("tokens"), F.sum("types")).first()
    states = docs.mapInArrow(_states, "block long, ids array<long>, held array<boolean>, text binary")
    counted = states.groupBy("block").cogroup(
        answers.where(F.col("block").isNotNull()).select("block", "kind", "part", "totals").groupBy("block")
    ).applyInArrow(lambda s, a: _meet(s, a) if s.num_rows else _none(), COUNTED)
    return materialize(counted), int(n[0] or 0), int(n[1] or 0)


def _none() -> pa.Table:
    return pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                      ("lens", pa.list_(pa.int32())), ("uni", pa.binary()), ("bi", pa.binary())]).empty_table()


def _tokens(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of token, pair and context, and the tokens of each document."""
    uni, bi = (unpack(b.column(c)[i].as_py(), np.uint64).astype(np.float64) for c in ("uni", "bi"))
    lens = np.array(b.column("lens")[i].as_py())
    context = np.empty_like(uni)
    context[1:] = uni[:-1]
    context[0] = uni[-1]  # the end token, whose count is that of every first context
    return uni, bi, context, lens


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(int), BUCKETS - 1)


# ---- mixture weights

def _step(p: np.ndarray) -> np.ndarray:
    """A probability's place on the scale of EM statistics; UNSEEN for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.floor(-STEPS * np.log2(np.maximum(p, 1e-300))), UNSEEN).astype(np.int64)


def held_out_statistics(counted: DataFrame, tokens: int) -> DataFrame:
    """``(cell, n)``: training tokens by context bucket and by deleted bigram and unigram probability."""
    def work(it):
        for b in it:
            for i in range(b.num_rows):
                uni, bi, ctx, lens = _tokens(b, i)
                train = np.repeat(~np.array(b.column("held")[i].as_py()), lens)
                uni, bi, ctx = uni[train], bi[train], ctx[train]
                two = _step(np.where(ctx > 1, (bi - 1) / np.maximum(ctx - 1, 1), 0.0))
                one = _step((uni - 1) / max(tokens - 1, 1))
                cell = (bucket(ctx) << 40) | ((two + 1) << 20) | (one + 1)
                at, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["cell", "n"])

    return counted.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def mixture(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = 40) -> np.ndarray:
    """Weights ``(bucket, [bigram, unigram, uniform])`` by expectation-maximisation."""
    w = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    two, one = (cells >> 20 & 0xFFFFF) - 1, (cells & 0xFFFFF) - 1
    value = lambda s: np.where(s == UNSEEN, 0.0, 2.0 ** (-(s + 0.5) / STEPS))
    p = np.column_stack([value(two), value(one), np.full(len(cells), 1.0 / (types + 1))])
    own = cells >> 40
    for _ in range(rounds):
        share = w[own] * p
        share *= (n / share.sum(axis=1))[:, None]
        total = np.column_stack([np.bincount(own, share[:, k], BUCKETS) for k in range(3)]) + np.array([0.05, 0.05, 0.05])
        w = total / total.sum(axis=1, keepdims=True)
    return w


# ---- scores

def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row; learns from the rows
    whose ``held_out`` is not true. ``base_score`` is the add-one unigram model's, ``score`` the interpolated one's."""
    counted, tokens, types = count(df, held_out, id_col, text_col)
    # at most BUCKETS x (probability steps)^2 rows, whatever the corpus
    stats = held_out_statistics(counted, tokens).collect()
    w = mixture(np.array([r["cell"] for r in stats], np.int64), np.array([r["n"] for r in stats], float), types)

    def work(it):
        for b in it:
            for i in range(b.num_rows):
                uni, bi, ctx, lens = _tokens(b, i)
                mix_w = w[bucket(ctx)]
                p = mix_w[:, 0] * bi / np.maximum(ctx, 1) + mix_w[:, 1] * uni / max(tokens, 1) + mix_w[:, 2] / (types + 1)
                # a context never seen has no bigram share: its weight goes to the others
                p = np.where(ctx > 0, p, p / np.maximum(1 - mix_w[:, 0], 1e-9))
                if not tokens:
                    p = np.ones_like(p)
                at = np.cumsum(lens) - lens
                add = lambda x: np.add.reduceat(x, at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, b.column("held")[i].values, pa.array(lens.astype(np.int64)),
                     pa.array(add((uni > 0).astype(np.int64))), pa.array(np.full(len(lens), tokens, np.int64)),
                     pa.array(add(np.log10((uni + 1) / (tokens + types + 1)))), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                    "base_score double, score double")
