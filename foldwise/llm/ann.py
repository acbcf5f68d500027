"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Every block of vectors keeps a file per pivot: for each of its
vectors the pivot's place in the vector's order (``POSTED`` where the pivot is not among the vector's nearest). A
query reads the files of its own nearest pivots and adds up the differences of places (the footrule distance); the
vectors of a block with the smallest sums are ranked again by the exact inner product, and the best of all blocks
are merged. Blocks are dealt by hash, so each holds the same share of everything. Equal vectors of a block are
indexed once, so that copies cannot crowd out other candidates; their ids come back in order of size, at most
``k + 1`` of them, as no more can be among a query's nearest.

For largest inner products of vectors of any length, all vectors get one more component that makes them equally long
(none for queries); nearest pivots are then those of largest inner product.

The index covers every row. Each block of queries meets each block of vectors once; a task holds one of each.

Defined cases: a vector that is null, zero or of another length than most pivots, or that holds null or non-finite
components, takes no part, neither does a null id; an id that is repeated counts once (its largest vector); ties go
to the smaller id; with fewer than ``k`` others all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PIVOTS = 256
POSTED = 128          # pivots in a vector's order
READ = 64             # pivot files that a query reads
SHARE = 0.06          # of a block's distinct vectors, that is ranked again
LEAST = 600           # distinct vectors of a block that are ranked again, at least
CLOSE = READ * POSTED // 8  # every vector with a footrule sum up to this is ranked again, however many they are
APART = 0.9           # two pivots' cosine is below this, so that a group of near copies gives one pivot
BLOCK_ROWS = 8192
QUERY_ROWS = 1024


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the vectors that take part, one row per id."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("v")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")) \
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)) \
        .groupBy("vec_id").agg(F.max("v").alias("v"))


def _matrix(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(-1, dims)


def _packed(name: str):
    """All rows of a block as one row: ids in order and a matrix."""
    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        v = t.column("v").combine_chunks().values.to_numpy(zero_copy_only=False)
        return pa.Table.from_arrays([pa.array([t.column("block")[0].as_py()]), pa.array([t.column("vec_id").to_numpy().tobytes()]),
                                     pa.array([np.ascontiguousarray(v, np.float64).tobytes()])], ["block", f"{name}_ids", f"{name}_v"])
    return work


def distinct_rows(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct rows in order of their smallest id (``ids`` rise), and up to ``most`` smallest ids of each."""
    as_bytes = np.ascontiguousarray(x + 0.0).view(f"V{x.shape[1] * 8}").ravel()
    of: dict[bytes, list[int]] = {}
    for i, key in enumerate(as_bytes.tolist()):
        of.setdefault(key, []).append(i)
    groups = list(of.values())
    return x[[g[0] for g in groups]], [ids[g[:most]] for g in groups]


def _blocks(vectors: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)))
    return dealt.groupBy("block").applyInArrow(_packed(name), f"block long, {name}_ids binary, {name}_v binary"), n


def places(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """For each row of ``x`` the place of every pivot in its order; ``depth`` for those beyond."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth]
    out = np.full((len(x), len(pivots)), depth, np.int16)
    np.put_along_axis(out, order, np.arange(depth, dtype=np.int16)[None, :order.shape[1]], axis=1)
    return out


def spread_out(drawn: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` vectors, in the order drawn, that are not nearly parallel to one before."""
    keep: list[np.ndarray] = []
    units = np.empty((0, drawn.shape[1]))
    for v in drawn:
        u = v / np.sqrt(v @ v)
        if len(keep) < most and (not len(units) or (units @ u).max() < APART):
            keep.append(v)
            units = np.vstack([units, u])
    return np.array(keep).reshape(-1, drawn.shape[1])


def nearest_in_block(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray,
                     pivots: np.ndarray, length: float, k: int):
    """``(query id, id, score)`` of the best of one block for each query. ``pivots`` have the added component."""
    vectors, groups = distinct_rows(vectors, v_ids, k + 1)
    extra = np.sqrt(np.maximum(length * length - (vectors * vectors).sum(axis=1), 0.0))
    files = np.ascontiguousarray(places(np.column_stack([vectors, extra]), pivots, min(POSTED, len(pivots))).T)
    read = np.argsort(-(queries @ pivots[:, :-1].T), axis=1, kind="stable")[:, :READ]
    n = len(vectors)
    most = min(n, max(LEAST, int(SHARE * n), 2 * k))
    row = np.arange(n, dtype=np.int64)
    for i, q in enumerate(queries):
        footrule = np.zeros(n, np.int32)
        for place, p in enumerate(read[i]):
            footrule += np.abs(files[p] - np.int16(place))
        key = footrule * np.int64(n) + row  # ties: smaller ids first, as rows are in order of id
        near = np.argpartition(key, most - 1)[:most] if most < n else row
        near = np.union1d(near, np.flatnonzero(footrule <= CLOSE))  # in order of smallest id
        # row by row, so that equal vectors have equal scores
        score = (vectors[near] * q).sum(axis=1)
        top = np.argsort(-score, kind="stable")[:k + 1]
        ids = np.concatenate([groups[j] for j in near[top]])
        score = np.repeat(score[top], [len(groups[j]) for j in near[top]])
        other = ids != q_ids[i]
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, -score))[:k]
        yield q_ids[i], ids[best], score[best]


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every query among all other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    vectors = materialize(usable(df, id_col, vec_col))
    # a bounded sample: 4 * PIVOTS rows in order of a hash
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(4 * PIVOTS).collect()
    sizes = [len(r["v"]) for r in drawn]
    dims = max(set(sizes), key=sizes.count) if sizes else 1
    vectors = vectors.where(F.size("v") == dims)
    length = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    length = float(np.sqrt(length))
    pivots = spread_out(np.array([r["v"] for r in drawn if len(r["v"]) == dims]).reshape(-1, dims), PIVOTS)
    pivots = np.column_stack([pivots, np.sqrt(np.maximum(length ** 2 - (pivots ** 2).sum(axis=1), 0.0))])

    stored, n_blocks = _blocks(vectors, "v", BLOCK_ROWS)
    asked, _ = _blocks(vectors.where(is_query), "q", QUERY_ROWS)
    visits = asked.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))

    def work(it):
        for b in it:
            for i in range(b.num_rows):
                ids = [np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("q_ids", "v_ids")]
                mats = [_matrix(b.column(c)[i].as_py(), dims) for c in ("q_v", "v_v")]
                got = list(nearest_in_block(mats[0], ids[0], mats[1], ids[1], pivots, length, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)),
                     pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))],
                    ["query_id", "vec_id", "score"])

    found = visits.join(stored, "block").mapInArrow(work, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
