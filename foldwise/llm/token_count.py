"""Token counts: every distinct pre-token is counted once, and joined to the pre-token frequencies of each document.

1. Tasks count the pieces of their texts; the counts are summed by piece, and the tokenizer then sees each distinct
   piece once. The table of pieces grows with the corpus and is never held whole anywhere.
2. The most frequent pieces (at most ``head_pieces``, a documented bound) are broadcast, so a document's sum over
   them is taken in its row. The document's other pieces, rare by construction, meet their counts in a shuffle join.
3. The parts are summed by document. No ids are kept anywhere.

Texts that the pre-token pattern does not cover (see ``tok``) are counted whole by the library.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows with the same id and the same text give one row,
the same id with different texts one row each; a null id is a key like any other; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tok
from .common import batches, id_text

HEAD_PIECES = 200_000
_FLUSH = 400_000  # distinct pieces a task holds before it hands its counts on


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(piece, freq, n)``: corpus frequency and token count of every distinct pre-token of ``(doc_id, text)``."""
    def count(it):
        p, seen = tok.pieces(path), Counter()
        for _, texts in batches(it):
            for t in texts:
                seen.update(p.cut(tok.text_of(t)) or ())
                if len(seen) > _FLUSH:
                    yield _columns(piece=list(seen), freq=list(seen.values()))
                    seen = Counter()
        if seen:
            yield _columns(piece=list(seen), freq=list(seen.values()))

    def encode(it):
        p = tok.pieces(path)
        for b in it:
            pieces = b.column("piece").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(x) // 4 for x in p.encode_pieces(pieces)], pa.int32())], ["piece", "freq", "n"])

    return docs.mapInArrow(count, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq")) \
        .mapInArrow(encode, "piece string, freq long, n int")


def _columns(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


def _head_frequency(counts: DataFrame, head_pieces: int) -> int:
    """The least frequency so that no more than ``head_pieces`` pieces reach it (frequencies in steps of 1/8 octave)."""
    step = F.floor(F.log2("freq") * 8)
    rows = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    total, least = 0, float("inf")
    for r in rows:
        total += r["n"]
        if total > head_pieces:
            break
        least = r["step"]
    return least


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 head_pieces: int = HEAD_PIECES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every document."""
    docs = id_text(df, id_col, text_col)
    counts = materialize(piece_counts(docs, path))
    least = _head_frequency(counts, head_pieces)
    in_head = F.floor(F.log2("freq") * 8) >= F.lit(least)
    # at most `head_pieces` short strings
    head = {r["piece"]: r["n"] for r in counts.where(in_head).select("piece", "n").toLocalIterator()}
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(head)

    def work(it):
        p, known = tok.pieces(path), shared.value
        for b, texts in batches(it):
            key, doc, same, n_bytes, base, freq = [], [], [], [], [], []
            for i, (d, t) in enumerate(zip(b.column("doc_id").to_pylist(), texts)):
                s = tok.text_of(t)
                pieces, total = p.cut(s), 0
                mark = hash_text(t)
                if pieces is None:
                    total = len(p.encode_whole(s)) // 4
                else:
                    for piece, f in Counter(pieces).items():
                        n = known.get(piece)
                        if n is not None:
                            total += f * n
                        else:
                            key.append(piece)
                            doc.append(d)
                            same.append(mark)
                            n_bytes.append(None)
                            base.append(0)
                            freq.append(f)
                # the document's own row; its key equals no piece (pieces have no such byte) and spreads the rows
                key.append(f"\x00{d}:{mark}")
                doc.append(d)
                same.append(mark)
                n_bytes.append(len(t))
                base.append(total)
                freq.append(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.string()), pa.array(doc, pa.int64()), pa.array(same, pa.int64()),
                 pa.array(n_bytes, pa.int64()), pa.array(base, pa.int64()), pa.array(freq, pa.int32())],
                ["piece", "doc_id", "same", "n_bytes", "base", "freq"])

    parts = docs.mapInArrow(work, "piece string, doc_id long, same long, n_bytes long, base long, freq int")
    tail = counts.where(~in_head).select("piece", "n")
    # repeats of a row add up in every term alike, so dividing by the rows that carry n_bytes undoes them
    total = F.sum(F.col("base") + F.col("freq") * F.coalesce(F.col("n"), F.lit(0)))
    return parts.join(tail, "piece", "left").groupBy("doc_id", "same").agg(
        F.max("n_bytes").alias("n_bytes"), (total / F.count("n_bytes")).cast("long").alias("n_tokens")).drop("same")


def hash_text(t: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(t) - (1 << 63)
