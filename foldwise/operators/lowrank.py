"""SV-1 over blocks of term counts (``termrows.hit_blocks``): the truncated SVD of several TF-IDF spaces in two passes.

Documents stay packed: each pass unpacks a few hundred rows of a block at a time. The first sums ``x'x`` of every space by task
(features x features, bounded by the vocabulary), Spark adds the sums by feature, and only the totals come to the driver; the
second projects every document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import top_vectors
from .termrows import Vocabulary, dense_rows

_FEATURES = 256  # rows of a total that travel together


def svd_fit(blocks: DataFrame, vocabs: Sequence[Vocabulary], components: Sequence[int]) -> list[np.ndarray]:
    """For each space the top right singular vectors (no centring) of the flagged documents, as features x components."""
    held = blocks.sparkSession.sparkContext.broadcast(list(vocabs))
    names = ["space", "feature", "part"]
    schema = "space int, feature int, part binary"

    def gram(it):
        total = [np.zeros((len(v.terms),) * 2) for v in held.value]
        for b in it:
            for flags, hits in zip(b.column("flags").to_pylist(), b.column("hits").to_pylist()):
                keep = np.flatnonzero(flags)
                for g, v, packed in zip(total, held.value, hits):
                    for x in dense_rows(packed, len(flags), v, keep):
                        g += x.T @ x
        for j, g in enumerate(total):
            for lo in range(0, len(g), _FEATURES):
                rows = range(lo, min(lo + _FEATURES, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(rows), pa.int32()), pa.array(rows, pa.int32()),
                                                  pa.array([g[i, i:].astype(np.float32).tobytes() for i in rows], pa.binary())], names)

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32).astype(float) for x in t.column("part").to_pylist()], axis=0)
        return pa.table([t.column("space").slice(0, 1), t.column("feature").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names)

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = blocks.select("flags", "hits").coalesce(cores).mapInArrow(gram, schema)
    totals = [np.zeros((len(v.terms),) * 2) for v in vocabs]
    for r in parts.groupBy("space", "feature").applyInArrow(add, schema).toLocalIterator():  # features rows
        totals[r["space"]][r["feature"], r["feature"]:] = np.frombuffer(bytes(r["part"]), float)
    return [top_vectors(g, k) for g, k in zip(totals, components)]


def svd_project(blocks: DataFrame, vocabs: Sequence[Vocabulary], vectors: Sequence[np.ndarray], names: Sequence[str],
                id_col: str = "id") -> DataFrame:
    """``(id, <name>_0, ...)`` of every document; zero in a space where it has no term."""
    held = blocks.sparkSession.sparkContext.broadcast((list(vocabs), list(vectors)))

    def work(it):
        vs, Vs = held.value
        for b in it:
            for ids, hits in zip(b.column("ids").to_pylist(), b.column("hits").to_pylist()):
                every = np.arange(len(ids))
                out = [np.concatenate([x @ V for x in dense_rows(p, len(ids), v, every)]) for v, V, p in zip(vs, Vs, hits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *[pa.FixedSizeListArray.from_arrays(pa.array(z.reshape(-1)), z.shape[1]).cast(pa.list_(pa.float64()))
                                                  for z in out]], [id_col, *names])

    rows = blocks.select("ids", "hits").mapInArrow(work, ", ".join([f"{id_col} long", *[f"{n} array<double>" for n in names]]))
    return rows.select(id_col, *[F.col(n)[j].alias(f"{n}_{j}") for n, V in zip(names, vectors) for j in range(V.shape[1])])
