"""Problem 8: exact encoding with a public byte-level BPE tokenizer.

A text is split by the tokenizer's pattern; merges never cross the pieces. Within a piece
the ids come from dynamic programming over prefixes: a suffix automaton of the vocabulary
(a trie of the tokens read backwards) yields the tokens that end at each position; the
last token of a prefix is the one that is compatible with the last token of the prefix
before it, and there is exactly one. Following the back-pointers from the end gives the
ids that the merge rules give, in time linear in the piece.

Two tokens are compatible if their own merges finish before any merge across their border
could happen. Pieces recur, so each Python worker keeps a bounded memo of piece -> ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.runtime import table

TOKENIZER = "byte_bpe_50k"
#: Pieces remembered per Python worker (about 100 MB at most), and the longest one remembered.
MEMO, MEMO_CHARS = 300_000, 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Encoder for one vocabulary file (``vocab`` and ``merges`` in the public JSON form)."""

    def __init__(self, path: str, pattern: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab: dict[str, int] = model["vocab"]
        # printable stand-ins of bytes in the vocabulary file: visible Latin-1 characters stand for themselves, the rest follow from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        stand_in = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.token = {bytes(stand_in[c] for c in t): i for t, i in vocab.items() if all(c in stand_in for c in t)}
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.whole = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.byte = [self.token[bytes([b])] for b in range(256)]
        # the trie of reversed tokens: node * 256 + byte -> node; accept[node] is the token id or -1
        self.step: dict[int, int] = {}
        self.accept = [-1]
        for t, i in self.token.items():
            if i not in self.whole and len(t) > 1:
                continue  # special tokens are ordinary text
            node = 0
            for b in reversed(t):
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(self.accept)
                    self.accept.append(-1)
                node = nxt
            self.accept[node] = i
        self.size = {i: len(t) for t, i in self.token.items()}
        self.fits: dict[int, bool] = {}
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self)

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that touch its left (0) or right (1) border over time, with the rank of the merge that ends each."""
        out, end = [(token, 1 << 40)], 0
        while (made := self.whole.get(token)) is not None:
            token, end = made[side], made[2]
            out.append((token, end))
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules leave ``left`` and ``right`` side by side.

        A merge across the border happens at its rank if both parts are there by then; of
        merges with equal rank the one further left goes first.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            rights = self._border(right, 0)
            known = True
            for x, end_x in self._border(left, 1):
                for y, end_y in rights:
                    r = self.rank.get((x, y))
                    if r is not None and r < end_x and r <= end_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.token.get(data)
        if whole is not None and len(data) < 3:
            return [whole]
        step, accept, size = self.step, self.accept, self.size
        last = [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            node, at = 0, end
            found = []
            while at:
                at -= 1
                node = step.get(node << 8 | data[at])
                if node is None:
                    break
                if accept[node] >= 0:
                    found.append((at, accept[node]))
            for at, t in reversed(found):
                if at == 0 or self.compatible(last[at], t):
                    if end > 1 and at < end - 1 and not self._own(t):
                        continue
                    last[end] = t
                    break
            else:
                raise ValueError(f"no token ends {data[:end]!r}: the vocabulary lacks a byte")
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def _own(self, token: int) -> bool:
        """Whether a token's bytes alone encode to the token: its two parts must be compatible and so on down."""
        key = -1 - token
        known = self.fits.get(key)
        if known is None:
            made = self.whole.get(token)
            if made is None:
                known = True
            else:
                a, b, r = made
                known = self._own(a) and self._own(b) and self._only_merge(a, b, r)
            self.fits[key] = known
        return known

    def _only_merge(self, a: int, b: int, rank: int) -> bool:
        """No merge across the border of ``a`` and ``b`` comes before the one that joins them."""
        for x, end_x in self._border(a, 1):
            for y, end_y in self._border(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r != rank and r < end_x and r <= end_y and r < rank:
                    return False
        return True

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts give none."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text)))) if text else []


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encoded(rows: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """(key, ids): the token ids of every row, without special tokens; null and empty texts give an empty list."""
    path, pattern = tokenizer_path(name), split_pattern()
    kept = rows.select(F.col(key), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        memo, split = enc.memo.__getitem__, enc.split
        for batch in batches:
            ends, parts = np.zeros(batch.num_rows + 1, np.int32), []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.fromiter(chain.from_iterable(map(memo, split(t))), np.int32) if t else ()
                ends[i + 1] = ends[i] + len(ids)
                if len(ids):
                    parts.append(ids)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[key, "ids"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(rows: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """(key, tokens): the number of tokens of every row."""
    path, pattern = tokenizer_path(name), split_pattern()
    kept = rows.select(F.col(key), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        memo, split = enc.memo.__getitem__, enc.split
        for batch in batches:
            n = [sum(map(len, map(memo, split(t)))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, tokens long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
