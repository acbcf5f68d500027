"""Many lookups per row without a join per column: key -> values tables held by every task, as far as they fit.

A mapping ``(column, key, vals)`` is split by key frequency at a bound in bytes. The frequent keys are broadcast, and each
row's keys are found there in its own task (exact string match, a batch and a column at a time), so rows are neither
unpivoted nor shuffled and no frequent key meets a shuffle. Beyond the bound the remaining keys, rare by construction,
are joined by shuffle with the unpivoted keys of the columns they belong to, and come back by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HEAD_BYTES = 128 << 20  # of keys and values in a broadcast


def _least_step(mapping: DataFrame, freq: str, width: int, bound: int) -> float:
    """The least frequency class (an eighth of an octave) of the broadcast keys: their keys and values stay under ``bound``."""
    size = F.octet_length("key") + F.lit(8 * width + 16)
    steps = mapping.groupBy(_step(freq).alias("step")).agg(F.sum(size).alias("bytes")).collect()  # some hundred classes
    total, least = 0, float("inf")
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["bytes"]
        if total > bound:
            break
        least = r["step"]
    return least


def _step(freq: str) -> Column:
    return F.floor(F.log2(F.col(freq)) * 8)


def look_up(df: DataFrame, keys: Sequence[Column], mapping: DataFrame, width: int, freq: str, id_col: str,
            picks: Column | None = None, n_picks: int | None = None, out: str = "_found", max_bytes: int = HEAD_BYTES) -> DataFrame:
    """Adds ``out``: for each of ``keys`` in turn the picked values, NaN where the key is null or not in the mapping.

    ``mapping``: ``(column, key, vals)`` and ``freq``, where ``column`` is a place in ``keys``, ``vals`` an array of ``width``
    doubles and ``freq`` at least 1. ``picks``: an int array of ``n_picks`` places in ``vals``, by row (default: all).
    Repeated ids are looked up each; a null id is a value like any other. The mapping should be written before.
    """
    least = _least_step(mapping, freq, width, max_bytes)
    in_head = _step(freq) >= F.lit(least)
    head = mapping.where(in_head).select("column", "key", "vals").toArrow()  # at most `max_bytes`
    n = width if picks is None else n_picks
    t = df.withColumn("_picks", picks if picks is not None else F.array(*[F.lit(k) for k in range(width)]))
    late = _late(t, keys, mapping.where(~in_head), id_col)
    names = [f"_k{p}" for p in range(len(keys))]
    t = t.select("*", *[k.cast("string").alias(c) for k, c in zip(keys, names)])
    if late is not None:
        t = t.join(late, F.col(id_col).eqNullSafe(F.col("_late_id")), "left").drop("_late_id")
    return _in_task(t, df.columns, names, head, width, n, out, late is not None)


def _late(t: DataFrame, keys: Sequence[Column], tail: DataFrame, id_col: str) -> DataFrame | None:
    """``(_late_id, _late)``: what the rare keys give, by id; None if there is none."""
    own = [r["column"] for r in tail.select("column").distinct().collect()]  # at most one row per key column
    if not own:
        return None
    long = t.select(F.col(id_col).alias("_late_id"), "_picks", F.explode(F.array(*[
        F.struct(F.lit(p).alias("column"), keys[p].cast("string").alias("key")) for p in own])).alias("_e")) \
        .select("_late_id", "_picks", "_e.column", "_e.key")
    got = long.join(tail.select("column", "key", "vals"), ["column", "key"]).select(
        "_late_id", F.struct(F.col("column").cast("int").alias("column"), "_picks",
                             F.transform("_picks", lambda p: F.element_at("vals", p + 1)).alias("vals")).alias("_x"))
    # at most one entry per key column, and per picks if an id repeats
    return got.groupBy("_late_id").agg(F.collect_set("_x").alias("_late"))


def _in_task(t: DataFrame, keep: Sequence[str], names: Sequence[str], head, width: int, n: int, out: str, has_late: bool) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sets = {}
    column = head.column("column").to_numpy()
    for p in range(len(names)):
        mine = head.filter(pa.array(column == p))
        vals = mine.column("vals").combine_chunks()
        flat = np.full((mine.num_rows + 1, width), np.nan)  # the last row stands for "not found"
        if mine.num_rows:
            flat[:-1] = vals.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        sets[p] = (mine.column("key").combine_chunks().cast(pa.string()), flat)
    shared = t.sparkSession.sparkContext.broadcast(sets)

    def work(it):
        held = shared.value
        for b in it:
            pick = np.stack(b.column("_picks").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, n), np.int64)
            found = np.full((b.num_rows, len(names), n), np.nan)
            for p, c in enumerate(names):
                values, flat = held[p]
                if len(values):
                    at = pc.fill_null(pc.index_in(b.column(c), value_set=values, skip_nulls=True), len(values)).to_numpy(zero_copy_only=False)
                    found[:, p] = flat[at[:, None], pick]
            if has_late:
                for row, entries in enumerate(b.column("_late").to_pylist()):
                    for e in entries or ():
                        if e["_picks"] == pick[row].tolist():
                            found[row, e["column"]] = [np.nan if v is None else v for v in e["vals"]]
            flat_out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (len(names) * n), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], flat_out], [*keep, out])

    schema = t.select(*keep, F.array(F.lit(0.0)).alias(out)).schema
    cols = [*keep, "_picks", *names, *(["_late"] if has_late else [])]
    return t.select(*cols).mapInArrow(work, schema)
