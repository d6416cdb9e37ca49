"""A linear classifier of lines of pages: main body or beside it.

The tag-path ratios of marked-up pages (see mainbody) label the training lines; the classifier
carries what they say over to text without markup, and to lines inside a content path.
Features are hashed: words and word pairs of the line, its first and last words, length, ending,
the tag, the first words and lengths of the lines around it, and the distance to both ends.
Every training line counts twice, with and without what only markup tells, so that extracted text is
judged by what it has. All of it is computed over whole batches with numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.llm import grams as G

#: Hashed features of the model.
FEATURES = 1 << 18
#: Kinds of features, hashed apart.
_SALT = {n: np.uint64(zlib.crc32(n.encode()) << 20 | 1) for n in ("one", "two", "first", "firsttwo", "last", "prev", "prevtwo", "next", "shape", "tag", "around", "place", "title", "site", "prevtag")}
U = np.uint64


def _fold(h: np.ndarray, kind: str) -> np.ndarray:
    return (G.mix(h + _SALT[kind]) & U(FEATURES - 1)).astype(np.int32)


def word_lists(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, line number of each word, first word of each line); digits count as 0."""
    arr = pc.replace_substring_regex(pa.array(texts, pa.string()), "[0-9]+", "0")
    h, doc = G.word_hashes(arr)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return h, doc, first


class Batch:
    """Feature numbers of the lines of several pages.

    ``page`` numbers the page of each line, ascending; ``tags`` is '' for lines without markup. ``site`` and
    ``title`` hold the site's name and the title of each page.
    """

    def __init__(self, texts: list[str], page: np.ndarray, tags: list[str], linked: np.ndarray, sites: list[str], titles: list[str]):
        n = self.n = len(texts)
        self.page = page
        h, doc, first = word_lists(texts)
        self.words = np.diff(first)
        has = self.words > 0
        f = np.where(has, h[np.minimum(first[:-1], max(len(h) - 1, 0))] if len(h) else U(0), U(1))
        last = np.where(has, h[np.maximum(first[1:] - 1, 0)] if len(h) else U(0), U(1))
        two = self.words > 1
        second = np.where(two, h[np.minimum(first[:-1] + 1, max(len(h) - 1, 0))] if len(h) else U(0), U(2))
        firsttwo = f * U(0x9E3779B97F4A7C15) + second
        same = np.flatnonzero(doc[1:] == doc[:-1])
        pair = h[same] * U(0x9E3779B97F4A7C15) + h[same + 1]
        size = np.array([len(t).bit_length() for t in texts], np.int64)
        ends = np.array([(2 if t[-1:] in ".!?…。" else 1 if t[-1:] in ":;," else 0) if t else 3 for t in texts], np.int64)
        upper = np.array([t[:1].isupper() + 2 * t[:1].isdigit() for t in texts], np.int64)
        shape = (size * 4 + ends).astype(U)
        start = np.searchsorted(page, page)  # first line of the line's page
        stop = np.searchsorted(page, page, side="right")
        at = np.arange(n)
        before = np.where(at > start, at - 1, n)
        after = np.where(at + 1 < stop, at + 1, n)

        def near(v: np.ndarray, where: np.ndarray) -> np.ndarray:
            return np.append(v, U(3))[where]

        idx: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def add(feature: np.ndarray, row: np.ndarray) -> None:
            idx.append(feature)
            rows.append(row)

        add(_fold(h, "one"), doc)
        add(_fold(pair, "two"), doc[same])
        for v, kind in ((f, "first"), (firsttwo, "firsttwo"), (last, "last"), (shape, "shape"), (near(f, before), "prev"), (near(firsttwo, before), "prevtwo"), (near(f, after), "next")):
            add(_fold(v, kind), at)
        add(_fold(near(shape, before) * U(64) + near(shape, after), "around"), at)
        place = np.minimum(at - start, 4) * 8 + np.minimum(stop - 1 - at, 4)
        add(_fold(place.astype(U) * U(4) + upper.astype(U), "place"), at)
        self._titles(texts, titles, h, doc, first, sites, add)
        self.plain = self._pack(idx, rows)
        # what only markup tells
        tag = np.array([zlib.crc32(t.encode()) for t in tags], U)
        marked = np.flatnonzero(np.array([t != "" for t in tags], bool))
        link = (np.minimum(linked, 1.0) * 4).astype(U)
        add(_fold(tag * U(8) + link, "tag")[marked], marked)
        add(_fold(near(tag, before) * U(8) + tag, "prevtag")[marked], marked)
        self.full = self._pack(idx, rows)

    def _titles(self, texts, titles, h, doc, first, sites, add) -> None:
        """Whether a line is the page's title, and whether it names the site."""
        low = [" ".join(t.lower().split()) for t in titles]
        mark = np.array([1 + (2 if texts[i].lower() == low[p] else 1 if len(texts[i]) > 12 and texts[i].lower() in low[p] else 0) for i, p in enumerate(self.page)], U)
        add(_fold(mark, "title"), np.arange(self.n))
        named, of, _ = word_lists(sites)
        name = np.zeros(len(sites), U)
        name[of[::-1]] = named[::-1]
        hit = np.unique(doc[(h == name[self.page[doc]]) & (name[self.page[doc]] != 0)]) if len(h) else np.zeros(0, np.int64)
        add(_fold(np.ones(len(hit), U), "site"), hit)

    def _pack(self, idx: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers by line, and the first of each line; every line has some."""
        i, r = np.concatenate(idx), np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        return i[order], np.searchsorted(r[order], np.arange(self.n))

    def scores(self, weights: np.ndarray, marked: bool) -> np.ndarray:
        """Above 0: beside the main body."""
        if not self.n:
            return np.zeros(0, np.float32)
        idx, start = self.full if marked else self.plain
        counts = np.diff(np.append(start, len(idx)))
        return np.add.reduceat(weights[idx], start) / np.sqrt(counts) + weights[-1]


def fit(idx: np.ndarray, start: np.ndarray, labels: np.ndarray, l2: float = 1e-6, rounds: int = 120, features: int = FEATURES, trust: float = 1.0, balanced: bool = False, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Logistic regression by full-batch Adam; ``features`` weights and the intercept. Rows are scaled to unit length.

    With ``more``, further features and the row of each, every row counts twice, as it is and with those; labels are for one of both.

    ``trust`` below 1 weighs the label 0 less than 1, for labels that miss cases; ``balanced`` weighs a rare label more, by the root of its rarity.
    """
    w = np.zeros(features + 1, np.float32)
    n = len(start)
    if not n or labels.all() or not labels.any():
        w[-1] = 10.0 if n and labels.all() else -10.0
        return w
    counts = np.diff(np.append(start, len(idx)))
    scale = (1 / np.sqrt(counts)).astype(np.float32)
    y = labels.astype(np.float32)
    weight = np.where(labels, 1.0, trust).astype(np.float32)
    if balanced:
        weight = np.where(labels, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32) ** 0.5
    used, idx = np.unique(idx if more is None else np.concatenate((idx, more[0])), return_inverse=True)
    total = n
    if more is not None:
        idx, extra, of = idx[: len(idx) - len(more[0])], idx[len(idx) - len(more[0]) :], more[1]
        scale2 = (1 / np.sqrt(counts + np.bincount(of, minlength=n))).astype(np.float32)
        total = 2 * n
    row = np.repeat(np.arange(n), counts)
    held, spread = np.empty(len(idx), np.float32), np.empty(len(idx))
    w, m, v = (np.zeros(len(used) + 1, np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        plain = np.add.reduceat(np.take(w, idx, out=held, mode="clip"), start)
        z = plain * scale + w[-1]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        pull, last = d * scale, d.sum()
        if more is not None:
            z = (plain + np.bincount(of, w[extra], n).astype(np.float32)) * scale2 + w[-1]
            d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
            full = d * scale2
            pull, last = pull + full, last + d.sum()
        g = np.empty_like(w)
        sums = np.bincount(idx, np.take(pull.astype(np.float64), row, out=spread, mode="clip"), len(used))
        if more is not None:
            sums += np.bincount(extra, full[of], len(used))
        g[:-1] = sums + l2 * w[:-1]
        g[-1] = last
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - 0.9 * t / rounds)
    out = np.zeros(features + 1, np.float32)
    out[used] = w[:-1]
    out[-1] = w[-1]
    return out
