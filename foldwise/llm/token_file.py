"""Token-id output: documents in ascending id order as range-coded blocks in a table of frames, and back.

A frame holds consecutive whole documents of one shard, about ``FRAME_IDS`` ids (more only for a longer document).
Its ids are cut into blocks of ``BLOCK_IDS``; each block is coded with fresh models (``range_coder``), so a block can
be read alone, and carries the CRC-32 of its ids, which reading checks. A frame's blocks are coded side by side.

A frame is one row: ``shard``, ``frame``, ``ids_before`` (in its shard), ``doc_ids``, ``doc_lengths``, ``blocks``,
``block_ids`` (the ids in each block) and ``block_crc32``. Frames are written as Parquet by Spark, so any store that
Spark writes to will do, and a lost task is simply run again.

Defined cases: a null text is empty and has its end id alone; repeated ids follow each other in order of a hash of the
text, repeated rows are kept; null ids come first; an empty table gives an empty file; only id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import range_coder, tok
from .common import batches, id_text

BLOCK_IDS = 4096
FRAME_IDS = BLOCK_IDS * range_coder.LANES
SHARD_BYTES = 32 << 20  # text bytes of a shard

FRAME = ("shard int, frame int, ids_before long, doc_ids array<long>, doc_lengths array<int>, blocks array<binary>, "
         "block_ids array<int>, block_crc32 array<long>")
_FRAME_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()),
                pa.list_(pa.int32()), pa.list_(pa.int64())]
_FRAME_NAMES = [x.split()[0] for x in FRAME.split(", ")]


class CorruptBlock(ValueError):
    """A block's ids do not have its checksum."""


def encode_frame(ids: np.ndarray) -> tuple[list[bytes], list[int], list[int]]:
    """Blocks, their numbers of ids, their checksums."""
    parts = [ids[k:k + BLOCK_IDS] for k in range(0, len(ids), BLOCK_IDS)]
    return range_coder.encode(parts), [len(p) for p in parts], [zlib.crc32(p.tobytes()) for p in parts]


def decode_frame(blocks: list[bytes], sizes: list[int], crcs: list[int]) -> np.ndarray:
    parts = range_coder.decode(blocks, sizes)
    for p, crc in zip(parts, crcs):
        if zlib.crc32(p.astype("<u4").tobytes()) != crc:
            raise CorruptBlock("checksum of a block of token ids")
    return np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")


def _frames(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def work(it: Iterator[pa.RecordBatch]):
        p, shard = tok.pieces(path), TaskContext.get().partitionId()
        docs, ids, held, before, frame = [], [], 0, 0, 0

        def flush():
            all_ids = np.frombuffer(b"".join(ids), "<u4")
            row = (shard, frame, before, docs, [len(x) // 4 for x in ids], *encode_frame(all_ids))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FRAME_TYPES)], _FRAME_NAMES)

        for b, texts in batches(it):
            for d, x in zip(b.column("doc_id").to_pylist(), p.ids_of(list(map(tok.text_of, texts)))):
                docs.append(d)
                ids.append(x + end)
                held += len(ids[-1]) // 4
                if held >= FRAME_IDS:
                    yield flush()
                    before, frame = before + held, frame + 1
                    docs, ids, held = [], [], 0
        if docs:
            yield flush()
    return work


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all rows, in ascending order of id, to a new folder ``path``."""
    docs = id_text(df, id_col, text_col)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    docs.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")) \
        .mapInArrow(_frames(tokenizer, end_id), FRAME).write.option("compression", "none").parquet(path)


def _documents(it):
    for b in it:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in _FRAME_NAMES}
            ids = decode_frame(row["blocks"], row["block_ids"], row["block_crc32"])
            n = np.array(row["doc_lengths"], np.int64)
            start = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(n), row["shard"], np.int32)),
                 pa.array(start + row["ids_before"]), pa.array(n), pa.array([ids[s:s + k].tobytes() for s, k in zip(start, n)], pa.binary())],
                ["doc_id", "shard", "start", "n_tokens", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of a file; ``ids`` as little-endian unsigned 32-bit."""
    frames = spark.read.schema(FRAME).parquet(path)
    # one number per shard
    totals = {r["shard"]: r["n"] for r in frames.select("shard", F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
              .groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    before, sum_before = {}, 0
    for shard in sorted(totals):
        before[shard], sum_before = sum_before, sum_before + totals[shard]
    docs = frames.mapInArrow(_documents, "doc_id long, shard int, start long, n_tokens long, ids binary")
    if not before:
        return docs.drop("shard")
    offsets = spark.createDataFrame(list(before.items()), "shard int, before long")
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/token-file-{uuid.uuid4().hex}"
