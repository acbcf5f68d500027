"""TE-5 / TE-6: leave-fold-out target encodings of many columns for every role, from one aggregate.

Rows are read once, in blocks. A block folds each column's keys to ``(key, cell)`` entries, where a cell is an (outer, inner) pair
of folds, and sends them packed, a slice per column and hash range, with their sums of ``y``. The task of a range puts the cells
of each key together; the statistics of the train part that leaves out outer fold ``o`` and inner fold ``i`` are sums over the
cells of neither, and so are the sums over keys behind the automatic smoothing. It answers each slice, in its order, with what the
slice's entries are encoded from, and the block's rows pick their values there. No fold is read again, nothing is fitted in a
loop, rows are never unpivoted in an exchange, and a frequent key is one entry per block and cell.

A key whose rows all lie in one cell tells nothing about those rows themselves: each part that encodes them leaves the cell
out. Such keys (most keys of a column with many values) enter the smoothing as sums by cell.

Keys travel as 96 bits of hash within their column (64 to find them, 32 to tell keys apart that agree in these), so they stay
as short as numbers whatever the column holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packed import pack, pack_sorted, slices, unpack, unpack_sorted
from ..session import materialize
from .encode import key_expr
from .rowlookup import HEAD_BYTES

BLOCK_ROWS = 1 << 17
ENTRY_BYTES = 128  # of an entry in a range's task
_SUMS = ("K1", "C1", "M0", "M1", "M2")  # of the variances within keys and their number, of keys, means and squared means
_SCHEMA = "kind int, part long, block long, sums array<double>, " + ", ".join(f"f{k} binary" for k in range(6))
_BLOCK, _POST, _ANSWER, _TOTAL = range(4)


def _row(kind: int, part: int, block: int, sums=None, fields=()):
    import pyarrow as pa

    f = [*fields, *[None] * (6 - len(fields))]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([sums], pa.list_(pa.float64())),
         *[pa.array([x], pa.binary()) for x in f]], ["kind", "part", "block", "sums", *[f"f{k}" for k in range(6)]])


def _order(h: np.ndarray, h2: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by key (and ``last``), and where a new key begins in it."""
    by = (h,) if last is None else (last, h)
    order = np.lexsort(by)
    new_h, new_h2 = np.diff(h[order], prepend=0) != 0, np.diff(h2[order].astype(np.int64), prepend=0) != 0
    if (new_h2 & ~new_h)[1:].any():  # unequal keys of one hash
        order = np.lexsort((*by[:-1], h2, h))
        new_h, new_h2 = np.diff(h[order], prepend=0) != 0, np.diff(h2[order].astype(np.int64), prepend=0) != 0
    new = new_h | new_h2
    new[:1] = True
    return order, new


def _post_blocks(n_cols: int, bits: int, block_rows: int, id_col: str):
    """Rows ``(id, _cell, _y, _h, _h2)`` -> a BLOCK row with the ids, cells and places of the keys, and POST rows with the entries."""
    import pyarrow as pa
    from pyspark import TaskContext

    def flush(block: int, held: list):
        t = pa.Table.from_batches(held).combine_chunks()
        cell = t.column("_cell").to_numpy().astype(np.uint16)
        known = t.column("_y").is_valid().to_numpy(zero_copy_only=False)
        y = np.where(known, t.column("_y").to_numpy(zero_copy_only=False), 0.0)
        keys = t.column("_h").combine_chunks().flatten()
        null = keys.is_null().to_numpy(zero_copy_only=False).reshape(-1, n_cols)
        h = keys.fill_null(0).to_numpy().view(np.uint64).reshape(-1, n_cols)
        h2 = t.column("_h2").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(-1, n_cols)
        places = []
        for p in range(n_cols):
            rows = np.flatnonzero(~null[:, p])
            order, new = _order(h[rows, p], h2[rows, p], cell[rows])
            rows = rows[order]
            new[1:] |= cell[rows[1:]] != cell[rows[:-1]]
            place = np.full(t.num_rows, -1, np.int32)
            place[rows] = np.cumsum(new) - 1
            places.append(pack(place))
            first = np.flatnonzero(new)
            if not len(first):
                continue
            at = rows[first]
            sums = [np.add.reduceat(x[rows], first) for x in (known.astype(np.int64), y, y * y)]
            for part, a, b in slices(h[at, p], bits):
                yield _row(_POST, (p << bits) + part, block, None, [
                    pack_sorted(h[at[a:b], p]), pack(h2[at[a:b], p]), pack(cell[at[a:b]]), *[pack(x[a:b]) for x in sums]])
        sink = pa.BufferOutputStream()
        ids = t.select([id_col])
        with pa.ipc.new_stream(sink, ids.schema) as w:
            w.write_table(ids)
        sizes = np.array([len(x) for x in places], np.int64)
        yield _row(_BLOCK, -1 - block, block, None, [sink.getvalue().to_pybytes(), pack(cell), sizes.tobytes(), b"".join(places)])

    def work(it):
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in it:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= block_rows:
                yield from flush(block, held)
                block, held, n = block + 1, [], 0
        if held:
            yield from flush(block, held)
    return work


def _key_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> list[np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where(n > 1, (ss - s * s / n) / (n - 1), 0.0)
        mu = np.where(n > 0, s / n, 0.0)
    return [var, n > 1, n > 0, mu, mu * mu]


KEYS_AT_ONCE = 20_000


def _combine(inside: np.ndarray, pick: np.ndarray, bits: int):
    """One hash range of a column: its POST rows -> an ANSWER row each, counts and sums by entry and outer fold, and a TOTAL row.

    ``inside[cell, part]``: whether the part holds the cell's rows; ``pick[cell, k]``: the part that encodes them for outer fold k.
    """
    import pyarrow as pa
    n_cells, n_parts = inside.shape

    def work(t):
        part = t.column("part")[0].as_py()
        if part < 0:
            return t
        f = [t.column(f"f{k}").to_pylist() for k in range(6)]
        h = [unpack_sorted(x) for x in f[0]]
        sizes = [len(x) for x in h]
        h = np.concatenate(h)
        h2, cell, n, s, ss = (np.concatenate([unpack(x, d) for x in col]) for col, d in zip(
            f[1:], (np.uint32, np.uint16, np.int64, np.float64, np.float64)))
        order, new = _order(h, h2)
        first = np.flatnonzero(new)
        c = cell[order]
        shared = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        total = np.zeros((len(_SUMS), n_parts))
        alone = first[~shared]
        by_cell = [np.bincount(c[alone], x[~shared], n_cells) for x in _key_sums(*[np.add.reduceat(x[order].astype(float), first) for x in (n, s, ss)])]
        total += np.array(by_cell) @ inside  # a key of one cell is whole in every part that leaves the cell in
        answers = np.zeros((2, len(h), pick.shape[1]))
        ends = np.append(first[1:], len(h))
        key = np.flatnonzero(shared)
        for lo in range(0, len(key), KEYS_AT_ONCE):
            some = key[lo:lo + KEYS_AT_ONCE]
            length = ends[some] - first[some]
            of = np.repeat(np.arange(len(some)), length)
            at = np.arange(len(of)) + np.repeat(first[some] - (np.cumsum(length) - length), length)
            e = order[at]
            sums = [np.bincount(of * n_cells + cell[e], x[e], len(some) * n_cells).reshape(-1, n_cells) @ inside for x in (n, s, ss)]
            total += np.array([x.sum(axis=0) for x in _key_sums(*sums)])
            for k in range(2):
                answers[k][e] = sums[k][of[:, None], pick[cell[e]]]
        out, lo = [], 0
        for block, size in zip(t.column("block").to_pylist(), sizes):
            n_of, s_of = answers[:, lo:lo + size]
            lo += size
            out.append(_row(_ANSWER, part, block, None, [pack(n_of.astype(np.int64).reshape(-1)), pack(s_of.reshape(-1))]))
        out.append(_row(_TOTAL, part >> bits, -1, total.reshape(-1).tolist()))
        return pa.Table.from_batches(out)
    return work


def _smoothing(totals: DataFrame, n_cols: int, n_outer: int, n_inner: int) -> np.ndarray:
    """``m[column, outer, inner]``: mean variance within keys over the variance between them, NaN where none is defined.

    Reads columns x sums x folds x folds rows to the driver.
    """
    n_parts = n_outer * n_inner
    sums = np.zeros((n_cols, len(_SUMS), n_parts + n_outer))
    long = totals.select(F.col("part").alias("column"), F.posexplode("sums").alias("at", "x"))
    for r in long.groupBy("column", "at").agg(F.sum("x").alias("x")).collect():
        sums[r["column"]].reshape(-1)[r["at"]] = r["x"]
    k1, c1, m0, m1, m2 = np.moveaxis(sums[:, :, :n_parts].reshape(n_cols, len(_SUMS), n_outer, n_inner), 1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        within = np.where(c1 > 0, k1 / c1, np.nan)
        between = np.where(m0 > 1, (m2 - m1 * m1 / m0) / (m0 - 1), np.nan)
        return np.where(between > 0, within / np.maximum(between, 1e-9), 0.0)


ROWS_AT_ONCE = 4096


def _encode_blocks(bits: int, outer: np.ndarray, pick: np.ndarray, m: np.ndarray, g: np.ndarray, id_col: str, names: Sequence[str]):
    """Rows of a block side by side, BLOCK first -> ``(id, _k, _role, names...)``. ``m[column, part]`` and ``g[part]`` have the parts
    without an outer fold alone at their end, which are not smoothed; ``outer[cell]`` is a cell's outer fold."""
    import pyarrow as pa
    n_cols, n_o = len(names), pick.shape[1]

    def encode(block: dict, answers: list):
        ids = pa.ipc.open_stream(block["f0"]).read_all().combine_chunks()
        cell, sizes = unpack(block["f1"], np.uint16), np.frombuffer(block["f2"], np.int64)
        ends, got = np.cumsum(sizes), [[] for _ in range(n_cols)]
        for column, n, s in answers:  # by hash range
            got[column].append((unpack(n, np.int64).reshape(-1, n_o), unpack(s, np.float64).reshape(-1, n_o)))
        values = np.empty((n_cols, len(cell), n_o))
        part = pick[cell]
        mean = g[part]
        for p in range(n_cols):
            place = unpack(block["f3"][ends[p] - sizes[p]:ends[p]], np.int32)
            if place.max(initial=-1) + 1 != sum(len(x[0]) for x in got[p]):
                raise ValueError("a block has no answer for some of its keys")
            # the last entry stands for "no key"
            n, s = (np.concatenate([*[x[k] for x in got[p]], np.zeros((1, n_o))])[place] for k in range(2))
            by = m[p][part]
            with np.errstate(divide="ignore", invalid="ignore"):
                v = np.where(n > 0, (s + by * mean) / (n + by), np.nan)
            values[p] = np.where(np.isnan(v), mean, v)
        for lo in range(0, len(cell), ROWS_AT_ONCE):
            v = values[:, lo:lo + ROWS_AT_ONCE]
            here, o = ids.column(id_col)[lo:lo + ROWS_AT_ONCE].combine_chunks(), outer[cell[lo:lo + ROWS_AT_ONCE]]
            for k in range(n_o):
                role = np.where(o == -1, "test", np.where(o == k, "valid", "train"))
                yield pa.RecordBatch.from_arrays([here, pa.array(np.full(len(o), k, np.int32)), pa.array(role), *[pa.array(np.ascontiguousarray(x[:, k])) for x in v]],
                                                 [id_col, "_k", "_role", *names])

    def work(it):
        block, answers = None, []
        for b in it:
            for r in b.to_pylist():
                if r["kind"] == _BLOCK:
                    if block is not None:
                        yield from encode(block, answers)
                    block, answers = r, []
                else:
                    answers.append((r["part"] >> bits, r["f0"], r["f1"]))
        if block is not None:
            yield from encode(block, answers)
    return work


def target_encode_roles(df: DataFrame, cols: Sequence[str], y: str, inner: str, outer: str | None = None, id_col: str = "id",
                        smooth: str | float = "auto", prefix: str = "TE_", suffix: str = "_mean",
                        max_bytes: int = HEAD_BYTES) -> DataFrame:
    """``(id, outer_fold, role, TE_<col>_mean...)`` for every row and outer fold.

    * ``train``, rows of another outer fold: smoothed mean over the rows that lie neither in that outer fold nor in the row's
      inner fold (TE-3, TE-4 inside the outer train part);
    * ``valid``, rows of that outer fold, and ``test``, rows without folds: plain mean over all rows outside the outer fold
      (TE-1, TE-2).

    A null or unknown key, or one whose smoothing is undefined, gets the mean of ``y`` over the part. Without ``outer`` nothing
    is left out at that level: one output row per row, ``outer_fold`` is absent. ``df`` is read twice. ``max_bytes`` bounds the
    entries that the task of a hash range holds.
    """
    # folds x folds rows
    folds = df.groupBy(*([outer] if outer else []), inner).agg(
        F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).alias("rows")).collect()
    n_rows = sum(r["rows"] for r in folds)
    folds = [r for r in folds if r[inner] is not None]
    if not folds:
        raise ValueError("no row has a fold")
    inners = sorted({r[inner] for r in folds})
    outers = sorted({r[outer] for r in folds}) if outer else [None]
    n_o, n_i, n_parts = len(outers), len(inners), len(outers) * len(inners)

    def place(c: str, values: Sequence) -> Column:
        e = F.lit(-1)
        for k, v in enumerate(values):
            e = F.when(F.col(c) == F.lit(v), F.lit(k)).otherwise(e)
        return e

    n, s = np.zeros((n_o + (outer is None), n_i)), np.zeros((n_o + (outer is None), n_i))
    for r in folds:
        at = (outers.index(r[outer]) if outer else 1, inners.index(r[inner]))
        n[at], s[at] = r["n"], r["s"] or 0.0
    mean = lambda keep_o, keep_i: s[np.ix_(keep_o, keep_i)].sum() / max(n[np.ix_(keep_o, keep_i)].sum(), 1)
    rest = lambda k, size: [j for j in range(size) if j != k]
    g = np.array([[mean(rest(o, len(n)), rest(i, n_i)) for i in range(n_i)] for o in range(n_o)])
    g_v = np.array([mean(rest(o, len(n)), range(n_i)) for o in range(n_o)])

    # cells by number; without an outer level each row lies in a fold beside the one that is "left out"
    o_col = place(outer, outers) if outer else F.when(F.col(inner).isNull(), F.lit(-1)).otherwise(F.lit(1))
    o_of, i_of = (x.reshape(-1, 1) - 1 for x in np.divmod(np.arange((max(n_o, 2) + 1) * (n_i + 1)), n_i + 1))
    part_o, part_i = np.divmod(np.arange(n_parts), n_i)
    inside = np.hstack([(o_of != part_o) & (i_of != part_i), o_of != np.arange(n_o)]).astype(float)
    # a train row takes its inner fold's value of the part, the others the value of the whole outer train part
    k = np.arange(n_o)
    pick = np.where((o_of == -1) | (o_of == k) | (i_of == -1), n_parts + k, k * n_i + i_of)

    spark = df.sparkSession
    bits = min(12, max(0, math.ceil(math.log2(max(n_rows * ENTRY_BYTES / max(max_bytes, 1), 1)))))
    cores = spark.sparkContext.defaultParallelism
    block_rows = min(BLOCK_ROWS, max(ROWS_AT_ONCE, n_rows // (4 * cores)))
    keys = F.array(*[key_expr(c) for c in cols])
    h = F.transform(keys, lambda x: F.when(x.isNotNull(), F.xxhash64(x)))
    i_col = place(inner, inners)
    rows = df.select(id_col, ((o_col + 1) * (n_i + 1) + i_col + 1).alias("_cell"), F.when(i_col >= 0, F.col(y).cast("double")).alias("_y"),
                     h.alias("_h"),
                     F.transform(keys, lambda x: F.hash(x)).alias("_h2"))
    sent = rows.mapInArrow(_post_blocks(len(cols), bits, block_rows, id_col), _SCHEMA)
    answered = sent.groupBy("part").applyInArrow(_combine(inside, pick, bits), _SCHEMA)
    # written: each block's rows and answers side by side
    answered = materialize(answered.repartition(max(4 * cores, n_rows // BLOCK_ROWS), "block").sortWithinPartitions("block", "kind", "part"))
    m = _smoothing(answered.where(F.col("kind") == _TOTAL), len(cols), n_o, n_i) if smooth == "auto" \
        else np.full((len(cols), n_o, n_i), float(smooth))
    m = np.hstack([m.reshape(len(cols), n_parts), np.zeros((len(cols), n_o))])
    names = [f"{prefix}{c}{suffix}" for c in cols]
    schema = df.select(id_col, F.lit(0).alias("_k"), F.lit("").alias("_role"), *[F.lit(0.0).alias(c) for c in names]).schema
    out = answered.where(F.col("kind") != _TOTAL).mapInArrow(
        _encode_blocks(bits, o_of.reshape(-1), pick, m, np.concatenate([g.reshape(-1), g_v]), id_col, names), schema)
    label = [F.element_at(F.array(*[F.lit(v) for v in outers]), F.col("_k") + 1).alias("outer_fold")] if outer else []
    return out.select(id_col, *label, F.col("_role").alias("role"), *names)
