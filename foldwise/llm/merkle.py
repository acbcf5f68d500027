"""Merkle manifest of a dataset, kept as a postorder append log.

A tree's leaves stand in order; every ``RUN`` consecutive nodes (the last run: fewer, even one) become their hash until
one node remains. Aligned builders of ``SPAN`` leaves write their nodes in the order in which they are completed: a leaf,
then every parent that it closes. Where a node stands in such a log follows from the sizes of the subtrees before it
(``position``), so a proof addresses the siblings directly and nothing is searched. A builder's last node is a leaf of the
builders one layer up; a layer has ``SPAN`` times fewer rows than the one below, so even the largest tree meets no single
task. The roots of all trees, in the order of their keys, are the leaves of one more tree, built the same way.

Steps: leaves are hashed in the JVM and written without their texts; a range sort gives each its index in its tree;
builders write the log layer by layer; proofs go down the layers again, each segment with the siblings of those above.

Defined cases: a null value is ``-`` in its leaf; rows with a null key form the first tree; null ids come first in their
tree; rows that tie in the id stand in the order of their leaves, and repeated rows are leaves of their own; an empty
table gives no leaf and no root; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

RUN = 16
LEVELS = 2  # that one builder closes
SPAN = RUN ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 32  # bytes of a digest


# ---------------------------------------------------------------- shape of a tree

def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    h = 0
    while RUN ** h < n:
        h += 1
    return h


def width(level: int, n: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    return -(-n // RUN ** level)


def position(level: int, j: int, n: int, top: int) -> int:
    """Place of node ``j`` of ``level`` in the postorder log of ``n`` leaves whose levels up to ``top`` are closed."""
    last = (j + 1) * RUN ** level - 1
    if last < n:
        # before the leaf that completes it stand that many nodes of each level; the levels below it close in between
        return sum(last // RUN ** k for k in range(top + 1)) + level
    # an incomplete subtree closes at the end: after all complete nodes and the incomplete ones below it
    return sum(n // RUN ** k for k in range(top + 1)) + sum(n % RUN ** k > 0 for k in range(1, level))


def steps(i: int, n: int) -> list[tuple[int, int]]:
    """``(own place, length)`` of the runs on the way from leaf ``i`` to the root over ``n`` leaves."""
    out = []
    for level in range(height(n)):
        j = i // RUN ** level
        out.append((j % RUN, min(RUN, width(level, n) - (j - j % RUN))))
    return out


# ---------------------------------------------------------------- builders and folding

def parent(digests: bytes) -> bytes:
    """Hash of concatenated digests, each as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def append_log(leaves: Sequence[bytes], levels: int) -> bytes:
    """All nodes over ``leaves`` up to ``levels``, in the order in which they are completed."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = parent(b"".join(open_runs[level]))
        open_runs[level].clear()
        open_runs[level + 1].append(node)
        log.append(node)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        for level in range(levels):
            if len(open_runs[level]) < RUN:
                break
            close(level)
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return b"".join(log)


def closed_levels(n: int) -> int:
    """Levels that the builders of a layer with ``n`` leaves in the tree close."""
    return LEVELS if n > SPAN else height(n)


def siblings(log: bytes, count: int, levels: int) -> list[bytes]:
    """For each of a segment's ``count`` leaves the other digests of its runs, level by level and left to right."""
    out = [b""] * count
    for level in range(levels):
        n = width(level, count)
        at = [WIDTH * position(level, j, count, levels) for j in range(n)]
        nodes = [log[a:a + WIDTH] for a in at]
        size = RUN ** level
        for first in range(0, n, RUN):
            run = nodes[first:first + RUN]
            for o in range(len(run)):
                others = b"".join(run[:o] + run[o + 1:])
                for i in range((first + o) * size, min((first + o + 1) * size, count)):
                    out[i] += others
    return out


def fold(leaf: bytes, others: bytes, way: Sequence[tuple[int, int]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    node, at = leaf, 0
    for o, size in way:
        run = others[at:at + WIDTH * (size - 1)]
        at += WIDTH * (size - 1)
        node = parent(run[:WIDTH * o] + node + run[WIDTH * o:])
    return node


# ---------------------------------------------------------------- leaves

def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as its byte count, ``:`` and itself, ``-`` where null."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in columns]), 256))


def tree_key(c: Column) -> Column:
    """A key whose byte order puts null first."""
    return F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit(""))


def _ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``idx`` (place in the tree, from 0) and ``n`` (leaves of the tree)."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 16)
    # rows that tie in everything are dealt to several ranges by their place in the written table
    t = materialize(leaves).withColumn("_row", F.monotonically_increasing_id())
    t = materialize(t.repartitionByRange(parts, "tree", *order, "_row").withColumn("_part", F.spark_partition_id()))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per range and tree
    offsets = t.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_c")).select(
        "tree", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(by_tree).alias("n"))
    within = Window.partitionBy("tree", "_part").orderBy(*order, "_row")
    t = t.withColumn("_rn", F.row_number().over(within) - 1).join(offsets, ["tree", "_part"])
    return t.withColumn("idx", F.col("_off") + F.col("_rn")).drop("_part", "_row", "_off", "_rn")


# ---------------------------------------------------------------- the log

_SEGMENT = "tree string, seg long, n long, n_leaves long, log binary, root binary, ids array<long>, carried array<binary>"


def _segments(items: DataFrame) -> DataFrame:
    """One row per builder from ``(tree, idx, n, digest, id, carried)``; ``n`` counts the layer's leaves in the tree."""
    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n = t.column("n")[0].as_py()
        log = append_log(t.column("digest").to_pylist(), closed_levels(n))
        return pa.table({"tree": t.column("tree").slice(0, 1), "seg": t.column("seg").slice(0, 1), "n": pa.array([n], pa.int64()),
                         "n_leaves": pa.array([t.num_rows], pa.int64()), "log": pa.array([log], pa.binary()),
                         "root": pa.array([log[-WIDTH:]], pa.binary()),
                         "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())),
                         "carried": pa.array([t.column("carried").to_pylist()], pa.list_(pa.binary()))})

    dealt = items.withColumn("seg", F.floor(F.col("idx") / SPAN).cast("long"))
    return materialize(dealt.groupBy("tree", "seg").applyInArrow(build, _SEGMENT))


def _layers(items: DataFrame) -> list[DataFrame]:
    """The segments of each layer, lowest first; a tree ends in the layer where one segment holds it."""
    out = [_segments(items)]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > SPAN:
        out.append(_segments(out[-1].where(F.col("n") > SPAN).select(
            "tree", F.col("seg").alias("idx"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("carried"))))
    return out


def _tree_roots(layers: Sequence[DataFrame]) -> DataFrame:
    """``(tree, subroot)``: the last node of each tree."""
    last = [s.where(F.col("n") <= SPAN).select("tree", F.col("root").alias("subroot")) for s in layers]
    out = last[0]
    for s in last[1:]:
        out = out.unionByName(s)
    return out


def _rows(b: pa.RecordBatch, step: int = 64):
    """Rows of a batch as dicts, a few at a time."""
    for lo in range(0, b.num_rows, step):
        yield from b.slice(lo, step).to_pylist()


_ABOVE = "path binary, subroot binary, root binary, trees long, tree_rank long, tree_leaves long"


def _below(segments: DataFrame, above: DataFrame) -> DataFrame:
    """``above``, ``(tree, seg, path...)`` of a layer's segments, for the segments of the layer below."""
    def work(it):
        for b in it:
            for r in _rows(b):
                others = siblings(r["log"], r["n_leaves"], closed_levels(r["n"]))
                first = r["seg"] * SPAN
                yield pa.RecordBatch.from_pylist(
                    [{"tree": r["tree"], "seg": first + i, "path": o + r["path"], **{k: r[k] for k in _KEPT}}
                     for i, o in enumerate(others)], _BELOW)

    joined = segments.select("tree", "seg", "n", "n_leaves", "log").join(above, ["tree", "seg"])
    return joined.mapInArrow(work, "tree string, seg long, " + _ABOVE)


_KEPT = ("subroot", "root", "trees", "tree_rank", "tree_leaves")
_BELOW = pa.schema([("tree", pa.string()), ("seg", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()),
                    ("root", pa.binary()), ("trees", pa.int64()), ("tree_rank", pa.int64()), ("tree_leaves", pa.int64())])


class Manifest:
    """The log of a dataset: segments by layer, the roots of the trees and the root of all."""

    def __init__(self, layers: list[DataFrame], trees: DataFrame, top: list[DataFrame]) -> None:
        self.layers, self.trees, self.top = layers, trees, top

    def log(self) -> DataFrame:
        """``(tree, layer, seg, n_leaves, first_position, log)``; positions count the nodes of the tree's whole log.

        The nodes of a segment of layer 0 stand side by side from ``first_position`` on. Those of higher layers are
        found one by one: leaf ``j`` of layer ``t`` is node ``j`` of level ``LEVELS * t``.
        """
        parts = []
        for t, s in enumerate(self.layers):
            first = F.col("seg") * SPAN ** (t + 1)
            place = sum((F.floor(first / RUN ** k) for k in range(1, 16)), first).cast("long")
            parts.append(s.select("tree", F.lit(t).alias("layer"), "seg", "n_leaves", place.alias("first_position"), "log"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def proofs(self) -> DataFrame:
        """``(id, leaf, carried, subroot, root, siblings, idx, tree_leaves, tree_rank, trees)`` of every leaf.

        ``siblings`` are the digests beside the way from the leaf over its tree's root to the root, lowest first.
        """
        last = self.top[-1].select("root").first()  # one row: the tree of trees ends in one segment
        nothing = F.lit(0).cast("long")
        above = self.top[-1].select(
            "tree", "seg", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"),
            F.lit(bytes(last["root"]) if last else None).cast("binary").alias("root"),
            nothing.alias("trees"), nothing.alias("tree_rank"), nothing.alias("tree_leaves"))
        for s in reversed(self.top):
            above = _below(s, above)
        sizes = self.layers[0].groupBy("tree").agg(F.sum("n_leaves").cast("long").alias("tree_leaves"))
        # one row per tree: its place among the trees and the way from there to the root
        ends = materialize(
            self.trees.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), F.col("idx").alias("tree_rank"),
                              F.col("n").alias("trees"))
            .join(above.select(F.col("seg").alias("tree_rank"), "path", "root"), "tree_rank").join(sizes, "tree")
            .select("tree", nothing.alias("seg"), "path", "subroot", "root", "trees", "tree_rank", "tree_leaves"))
        down = None
        for s in reversed(self.layers):
            # trees that end in this layer start here, the others come down from above
            here = ends.join(s.where(F.col("n") <= SPAN).select("tree"), "tree", "left_semi")
            above = here if down is None else here.unionByName(down)
            if s is not self.layers[0]:
                down = _below(s, above)
        return _leaf_proofs(self.layers[0], above)


_PROOF = pa.schema([("id", pa.int64()), ("leaf", pa.binary()), ("carried", pa.binary()), ("subroot", pa.binary()),
                    ("root", pa.binary()), ("siblings", pa.binary()), ("idx", pa.int64()), ("tree_leaves", pa.int64()),
                    ("tree_rank", pa.int64()), ("trees", pa.int64())])
_PROOF_SQL = ("id long, leaf binary, carried binary, subroot binary, root binary, siblings binary, idx long, tree_leaves long, "
              "tree_rank long, trees long")


def _leaf_proofs(segments: DataFrame, above: DataFrame) -> DataFrame:
    def work(it):
        for b in it:
            for r in _rows(b):
                m, levels, log = r["n_leaves"], closed_levels(r["n"]), r["log"]
                others = siblings(log, m, levels)
                at = [WIDTH * position(0, i, m, levels) for i in range(m)]
                first = r["seg"] * SPAN
                same = lambda v: [v] * m
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([
                    r["ids"], [log[a:a + WIDTH] for a in at], r["carried"], same(r["subroot"]), same(r["root"]),
                    [o + r["path"] for o in others], range(first, first + m), same(r["tree_leaves"]), same(r["tree_rank"]),
                    same(r["trees"])], _PROOF)], schema=_PROOF)

    return segments.select("tree", "seg", "n", "n_leaves", "log", "ids", "carried").join(above, ["tree", "seg"]) \
        .mapInArrow(work, _PROOF_SQL)


def build(df: DataFrame, columns: Sequence[str] = COLUMNS, tree_col: str = "source", id_col: str = "doc_id",
          carry: Column | None = None) -> Manifest:
    """The manifest of a table: one tree per value of ``tree_col``, leaves by ``id_col``.

    ``carry`` is a binary column that travels with each leaf to its proof and is part of no hash.
    """
    carried = (carry if carry is not None else F.lit(None)).cast("binary")
    leaves = df.select(tree_key(F.col(tree_col)).alias("tree"), F.col(id_col).cast("long").alias("id"),
                       leaf_hash([F.col(c) for c in columns]).alias("digest"), carried.alias("carried"))
    layers = _layers(_ranked(leaves, ["id", "digest"]))
    trees = materialize(_ranked(_tree_roots(layers).select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("digest")), ["key"]))
    return Manifest(layers, trees, _layers(trees.select(
        "tree", "idx", "n", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("carried"))))


def folded(proofs: DataFrame, leaf: str) -> DataFrame:
    """Adds ``folded_root``: what the binary column ``leaf`` and the siblings of ``proofs`` fold to."""
    schema = proofs.withColumn("folded_root", F.lit(b"")).schema

    def work(it):
        for b in it:
            top: dict[tuple[int, int], list] = {}
            out = []
            for node, others, i, n, j, k in zip(*[b.column(c).to_pylist() for c in (
                    leaf, "siblings", "idx", "tree_leaves", "tree_rank", "trees")]):
                if (j, k) not in top:
                    top[j, k] = steps(j, k)
                out.append(fold(node, others, steps(i, n) + top[j, k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "folded_root"])

    return proofs.mapInArrow(work, schema)
