"""Sketch strings of texts, their segments, and segments in packed form.

A text's set of word n-grams is drawn into a string of symbols: symbol i is the n-gram that takes the least
value under hash function i (minwise sampling), so two texts of similarity J agree in a symbol with probability J whatever
other texts there are. The string is cut into segments of fixed number and length; a segment is stored under its position.
Two texts of similarity J have no segment in common with probability (1 - J^length)^segments: 1.8e-7 at 0.6 and 2e-14 at 0.7.

Segments move between tasks packed: a row holds those of many texts for one bucket of segment values, as 4 bytes
a segment and one or two a text number. A segment that comes back in a task's chunk of texts more than ``HOT`` times, such as one that a
third of all texts share, passes by the buckets and goes on as it is, so no bucket holds all of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import grams as G

class Shape(NamedTuple):
    """Segments of a sketch string, and symbols in each: longer segments keep unrelated texts with common phrases apart, more segments let no pair at the threshold slip."""

    segments: int
    length: int

    @property
    def symbols(self) -> int:
        return self.segments * self.length


#: The shape of all indexes and forests here.
SHAPE = Shape(112, 4)
#: 64-bit words of a text's bitmap.
WORDS = 8
#: Texts that a task packs together, places of a segment among them above which it is hot, and segments that a bucket should hold.
CHUNK, HOT, BUCKET = 16_384, 64, 1_000_000
#: N-grams that are drawn from at once; a longer text is drawn from alone.
DRAWN = 32_768
_SEEDS = G.mix(np.arange(1, SHAPE.symbols + 1, dtype=np.uint64)) | np.uint64(1)
U = np.uint64
#: A packed text: number, size, clustering symbol, bitmap.
RECORD = np.dtype([("cid", "<i8"), ("n", "<i4"), ("near", "<u4"), ("bits", "<u8", WORDS)])


def draw(g: np.ndarray, doc: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments, symbols, near) of each text, in order of appearance: 32-bit hashes of the segments, the symbols cut to a byte, and one symbol of 32 bits to order texts by."""
    start, _ = G.spans(doc)
    n, end = len(start), np.append(start[1:], len(g))
    segs, symbols, near = np.zeros((shape.segments, n), U), np.zeros((shape.symbols, n), np.uint8), np.zeros(n, np.uint32)
    a = 0
    while a < n:  # some texts at a time, whose n-grams stay in the cache over all draws
        z = max(a + 1, min(a + DRAWN // 16, int(np.searchsorted(end, start[a] + DRAWN, side="right"))))
        part, at = g[start[a] : end[z - 1]], start[a:z] - start[a]
        held, least = np.empty_like(part), np.empty((shape.symbols, z - a), U)
        for j, seed in enumerate(_SEEDS[: shape.symbols]):
            np.multiply(part, seed, out=held)  # n-grams are uniform hashes already: an odd factor permutes them
            np.minimum.reduceat(held, at, out=least[j])
        least = G.mix(least)
        symbols[:, a:z] = (least >> U(8)).astype(np.uint8)
        for k in range(shape.length):
            segs[:, a:z] = G.mix(segs[:, a:z] + least[k :: shape.length])
        near[a:z] = (G.mix(least[0]) >> U(32)).astype(np.uint32)
        a = z
    return np.ascontiguousarray((segs.T >> U(32)).astype(np.uint32)), np.ascontiguousarray(symbols.T), near


def bitmaps(g: np.ndarray, rank: np.ndarray, n_docs: int) -> np.ndarray:
    """A bitmap of WORDS 64-bit words per text."""
    m = np.zeros((n_docs, 64 * WORDS), bool)
    m[rank, (g % U(64 * WORDS)).astype(np.int64)] = True
    return np.packbits(m, axis=1).view(np.uint64)


def _binaries(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(m).view(np.uint8).reshape(len(m), -1) if len(m) else np.zeros((0, 1), np.uint8)
    off = np.arange(len(m) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(off), pa.py_buffer(data)])


def matrix(a: pa.Array, kind: np.dtype | type) -> np.ndarray:
    """Binary values of one length as rows; the inverse of :func:`_binaries`."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if not len(a):
        return np.zeros((0, 1), kind)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(a), -1)


def sketches(rows: DataFrame, key: str, text: str, carry: list[str], n: int, min_words: int, shape: Shape) -> DataFrame:
    """(key, carry..., n, sum, segs, rec) of each row with at least ``min_words`` words: size and sum of its word ``n``-grams, segments and packed text."""
    kept = rows.select(F.col(key).cast("long").alias(key), *carry, F.col(text).alias("t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in G.slices(batch, "t"):
                g, doc, words = G.word_grams(s.column(s.num_columns - 1), n)
                ok = words[doc] >= max(min_words, n)
                g, doc = g[ok], doc[ok]
                start, ids = G.spans(doc)
                if not len(ids):
                    continue
                counts = np.diff(np.append(start, len(doc)))
                segs, _, near = draw(g, doc, shape)
                rec = np.zeros(len(ids), RECORD)
                cols = [c.take(pa.array(ids)) for c in s.columns[:-1]]
                rec["cid"], rec["n"], rec["near"] = cols[0].to_numpy(zero_copy_only=False), counts, near
                rec["bits"] = bitmaps(g, np.repeat(np.arange(len(ids)), counts), len(ids))
                sums = np.add.reduceat(G.mix(g), start).view(np.int64)
                cols += [pa.array(counts, pa.int32()), pa.array(sums), _binaries(segs), _binaries(rec[:, None])]
                yield pa.RecordBatch.from_arrays(cols, names=[*s.schema.names[:-1], "n", "sum", "segs", "rec"])

    return kept.mapInArrow(make, f"{schema}, n int, sum long, segs binary, rec binary")


def encode_ids(ids: np.ndarray) -> bytes:
    """Ascending numbers as the first one and its distances in as few bytes as the widest needs."""
    step = np.diff(ids)
    width = next(w for w in (1, 2, 4, 8) if not len(step) or int(step.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + ids[:1].astype("<i8").tobytes() + step.astype(f"<u{width}").tobytes()


def decode_ids(data: bytes | memoryview) -> np.ndarray:
    step = np.frombuffer(data, f"<u{data[0]}", offset=9)
    out = np.empty(len(step) + 1, np.int64)
    out[0] = np.frombuffer(data, "<i8", 1, 1)[0]
    out[1:] = step.astype(np.int64)
    return np.cumsum(out, out=out)


PACKED = "bucket int, kind byte, roots binary, cids binary"
#: Kinds of packed rows: places of ordinary segments, the names of hot ones, and the places of hot ones.
PLACES, NAMES, HOT_PLACES = 0, 1, 2


def packed(sigs: DataFrame, buckets: int, shape: Shape) -> DataFrame:
    """(bucket, kind, roots, cids): the segments of ``sigs`` (cid, segs) by bucket, packed."""

    def chunk(cid: np.ndarray, segs: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(cid, kind="stable")
        cid, segs = np.repeat(cid[order], shape.segments), segs[order]
        full = G.mix(((np.arange(shape.segments, dtype=U) << U(32))[None, :] | segs.astype(U)).reshape(-1))
        bucket = ((full >> U(32)) % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted by radix
        order = np.argsort(full)
        start = np.flatnonzero(np.concatenate(([True], full[order[1:]] != full[order[:-1]])))
        count = np.diff(np.append(start, len(full)))
        hot, name = np.zeros(len(full), bool), np.zeros(len(full), bool)
        hot[order] = np.repeat(count > HOT, count)
        name[np.minimum.reduceat(order, start)[count > HOT]] = True
        out: dict[str, list] = {"bucket": [], "kind": [], "roots": [], "cids": []}
        for kind, rows in ((PLACES, np.flatnonzero(~hot)), (NAMES, np.flatnonzero(name)), (HOT_PLACES, np.flatnonzero(hot))):
            at = rows[np.argsort(bucket[rows], kind="stable")]
            cut = np.flatnonzero(np.diff(bucket[at].astype(np.int64), prepend=-1))
            for a, z in zip(cut, np.append(cut[1:], len(at))):
                part = at[a:z]
                out["bucket"].append(int(bucket[part[0]]))
                out["kind"].append(kind)
                out["roots"].append((full[part] & U(0xFFFFFFFF)).astype(np.uint32).tobytes())
                out["cids"].append(encode_ids(cid[part]))
        kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), matrix(batch.column(1), np.uint32)))
                size += batch.num_rows
            if size >= CHUNK:
                yield chunk(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield chunk(*(np.concatenate(x) for x in zip(*held)))

    return sigs.select(F.col("cid").cast("long").alias("cid"), "segs").mapInArrow(run, PACKED)


def buckets_for(n_texts: int, shape: Shape) -> int:
    return max(24, -(-n_texts * shape.segments // BUCKET))


def root_ids(bucket: int, roots: np.ndarray) -> np.ndarray:
    """Names of segments: the bucket and 32 bits. A clash of two segments only adds candidates."""
    return (np.int64(bucket) << np.int64(32)) | roots.astype(np.int64)


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(bucket, kind, roots, cids) of packed rows."""
    for b, k, r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
        yield b, k, np.frombuffer(r.as_buffer(), np.uint32), decode_ids(c.as_buffer())


def shared(parts: DataFrame, buckets: int, node: int) -> DataFrame:
    """(root, cid, big): the places of segments that several texts have; ``big`` if they may be more than ``node``, the same for all places of a segment."""

    def batch_of(root: np.ndarray, cid: np.ndarray, big: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(cid), pa.array(big)], names=["root", "cid", "big"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            none = [np.zeros(0, np.uint32)]
            roots = np.concatenate([r for k, r, _ in held if k == PLACES] or none)
            cids = np.concatenate([c for k, _, c in held if k == PLACES] or [np.zeros(0, np.int64)])
            order = np.argsort(roots, kind="stable")
            roots, cids = roots[order], cids[order]
            start = np.flatnonzero(np.diff(roots.astype(np.int64), prepend=-1))
            count = np.diff(np.append(start, len(roots)))
            hot = np.isin(roots[start], np.concatenate([r for k, r, _ in held if k == NAMES] or none))
            keep = np.repeat(hot | (count > 1), count)
            return batch_of(root_ids(now, roots[keep]), cids[keep], np.repeat(hot | (count > node), count)[keep])

        for batch in batches:
            for bucket, kind, r, c in unpack(batch):
                if kind == HOT_PLACES:
                    yield batch_of(root_ids(bucket, r), c, np.ones(len(r), bool))
                    continue
                if bucket != now:
                    if held:
                        yield close()
                    now, held = bucket, []
                held.append((kind, r, c))
        if held:
            yield close()

    # places of hot segments go anywhere, all others to their bucket
    where = F.when(F.col("kind") == HOT_PLACES, F.xxhash64("roots", "cids")).otherwise(F.col("bucket").cast("long"))
    return parts.repartition(buckets, where).sortWithinPartitions("bucket").mapInArrow(run, "root long, cid long, big boolean")
