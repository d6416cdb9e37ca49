"""Filters of keys: bitmaps of bounded size, built in tasks and broadcast, that sift rows where they lie before anything is shuffled.

A filter lets all its keys pass, and few others; a join behind it decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm import grams as G

#: Bits per key, and binary logarithms of the least and the largest size of a filter (64 MB; more keys than it is made for only let more rows pass).
BITS, LEAST, MOST = 16, 16, 29
U = np.uint64


def bits_for(n: int) -> int:
    """Binary logarithm of the size of a filter of ``n`` keys."""
    return min(max(int(n * BITS).bit_length(), LEAST), MOST)


def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each key: at 16 bits a key, few in a thousand others pass."""
    h = G.mix(keys.view(U) if keys.dtype == np.int64 else keys.astype(U))
    mask = U((1 << bits) - 1)
    return [(x & mask).astype(np.int64) for x in (h, h >> U(32), G.mix(h))]


def packed(at: np.ndarray) -> bytes:
    """Ascending places within a block as distances of two bytes, or of four where one is wider."""
    step = np.diff(at, prepend=0)
    width = 2 if int(step.max()) < 1 << 16 else 4
    return bytes([width]) + step.astype(f"<u{width}").tobytes()


def unpacked(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64))


def filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits that holds the first column of ``keys``, longs; merged block by block in tasks."""
    block = min(bits, 22)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(np.concatenate(slots(batch.column(0).to_numpy(), bits))) for batch in batches)]))
        cut = np.searchsorted(at >> block, np.arange((1 << (bits - block)) + 1))
        rows = [(i, at[a:z] - (i << block)) for i, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([packed(x) for _, x in rows], pa.binary())], names=["block", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.setdefault(i, np.zeros(1 << block, bool))[unpacked(x.as_buffer())] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in total.values()], pa.binary())], names=["block", "at"])

    schema = "block int, at binary"
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (block - 3)
    for r in keys.select(keys.columns[0]).mapInArrow(mark, schema).repartition("block").mapInArrow(merge, schema).toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.at, np.uint8)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys may be in the filter."""
    first, *others = slots(keys, bits)
    ok = (held[first >> 3] >> (first & 7).astype(np.uint8) & 1).astype(bool)
    for at in others:
        left = np.flatnonzero(ok)
        at = at[left]
        ok[left] = (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def sifted(df: DataFrame, column: str, held: object, bits: int) -> DataFrame:
    """The rows of ``df`` whose ``column``, a long without nulls, the broadcast filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, batch.column(batch.schema.get_field_index(column)).to_numpy(), bits)))

    return df.mapInArrow(run, df.schema)
