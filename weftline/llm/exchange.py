"""Packed exchange: many small records travel as one binary row per (slice of input, bucket), so a shuffle costs a few
bytes a record instead of a row each, and Python reads them back as whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(raw: bytes | memoryview) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(raw)) as r:
        return r.read_all()


def pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays as one zstd frame. Sorted integers are best given as differences."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    # Byte planes: high bytes of differences and small counts are mostly equal, and compress away.
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * count)
    at, out = 8 * len(head), []
    for k in range(count):
        kind, n = np.dtype(chr(head[1 + 2 * k])), int(head[2 + 2 * k])
        size = n * kind.itemsize
        out.append(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += size
    return out


def deal(df: DataFrame, n: int, bucket: str = "bucket") -> DataFrame:
    """Rows to the partition that their bucket (0 to n - 1) names."""
    return df.repartitionById(n, bucket)


def all_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> pa.Table | None:
    """A partition's rows as one table, or None if it has none."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that groups records by bucket, and n + 1 offsets."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))


#: A packed row: its kind, the partition it goes to, the block it concerns.
ROWS = "kind int, bucket int, block long, payload binary"


def packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, block, payload = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], ["kind", "bucket", "block", "payload"])


def groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal records in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of a sorted column: only buckets that are met."""
    at = groups(bucket)
    return list(zip(bucket[at].tolist(), at.tolist(), np.append(at[1:], len(bucket)).tolist()))


def range_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 48-bit keys by range, so that sorted keys are sorted by bucket too."""
    return ((keys * np.uint64(n)) >> np.uint64(48)).astype(np.int64)


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0)) if len(x) else x


def at_keys(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys among sorted ones, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys
