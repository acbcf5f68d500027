"""Packed columns of 64-bit hashes, as in ``llm.packed`` but with Arrow's own compression, so that no further library is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed, after their length in bytes."""
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else x.view(np.uint8)
    raw = planes.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    import pyarrow as pa

    raw = np.frombuffer(pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def slices(at: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    part = (at >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 62))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(part[lo]), lo, hi
