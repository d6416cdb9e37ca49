"""Counting sketches of fixed size, added up in the tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 4096
SCHEMA = "block int, counts binary"


def blocks_of(total: np.ndarray) -> pa.RecordBatch:
    """A task's counters as rows (block, packed counts); blocks of zeros are left out."""
    at = [i for i in range(len(total) // BLOCK) if total[i * BLOCK : (i + 1) * BLOCK].any()]
    return pa.RecordBatch.from_pydict(
        {"block": pa.array(at, pa.int32()), "counts": pa.array([zlib.compress(total[i * BLOCK : (i + 1) * BLOCK].astype(np.uint32).tobytes(), 1) for i in at], pa.binary())}
    )


def log_sketch(parts: DataFrame, size: int) -> np.ndarray:
    """8 * log2 of the summed counters as one byte each; at most ``size`` bytes reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(c.as_buffer()), np.uint32)
                total[b] = total[b] + x if b in total else x.astype(np.uint64)
        packed = [np.round(8 * np.log2(np.maximum(v, 1) + (v > 0) * 0.1)).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "counts": pa.array(packed, pa.binary())})

    out = np.zeros(size, np.uint8)
    for r in parts.repartition("block").mapInArrow(add, SCHEMA).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint8)
    return out
