"""Problem 6: pages that show template residue, filler, an error notice or a demand for scripts.

A page has three slots: its title, its headline and the blocks of its body. A linear classifier with
L2 regularisation judges every block on hashed features: word n-grams with their borders (up to three
words), runs of punctuation, length class, ending and slot; the title is a slot of its own, and whether the headline repeats
it is a feature. The classifier is trained here on weak labels: phrases (pagelines.is_residue), and error statuses
over a short body. None of the phrases is a feature, and the sample's labels are corrected once by
the classifier's own sure judgements, so wording that no phrase names is learned from statuses and from what it shares with
known cases. Training takes a bounded sample of ``TRAIN_PAGES`` pages; hosts of one fold in ``FOLDS`` are never trained on and serve for validation.

A page is found if its title or headline scores above 0, or the larger part of its body does. Lines beside the body (by
the line classifier of problem 1, without its residue labels) and code don't count. A post that only quotes such text keeps a body of prose.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import grams as G
from pagewright.llm import lineclass as LC
from pagewright.llm import mainbody as M
from pagewright.llm import pagelines as P
from pagewright.llm.source import source_of
from pagewright.plans.runtime import table

#: Bound of the training sample in pages, and hashed features of the model.
TRAIN_PAGES, FEATURES = 4000, LC.FEATURES
FOLDS, SEED = 5, 6
#: Body length in characters below which an error status counts as a weak label.
SHORT_BODY = 160
#: Share of the body's characters that must score above 0.
BODY_SHARE = 0.5
#: Score above which the classifier's judgement corrects a label in training.
SURE = 0.5
#: Score of the line classifier above which a line doesn't count as body; below 0, as a page that shows a notice has few other lines.
BESIDE = -2.0
_RUN = re.compile(r"[^\w\s]{2,}|__+|[{}<>\[\]%$@#|\\]")
_SALT = {n: np.uint64(zlib.crc32(n.encode()) << 20 | 5) for n in ("one", "two", "three", "begin", "end", "run", "slot", "same")}
U = np.uint64
TITLE, HEADLINE, BODY = 0, 1, 2


class Blocks:
    """The blocks of several pages: page number, slot and normalised text of each, title first."""

    def __init__(self, pages: list[M.Page], chrome: np.ndarray):
        self.page: list[int] = []
        self.slot: list[int] = []
        self.text: list[str] = []
        self.beside: list[bool] = []
        beside = self._beside(pages, chrome)
        i = 0
        for n, p in enumerate(pages):
            head = _title(p.title, p.site)
            if head and p.lines:
                self._add(n, TITLE, head, False)
            last = None
            for x in p.lines:
                if x.tag not in ("code", "pre"):
                    slot = HEADLINE if x.tag == "h1" else BODY
                    text = P.normal(x.text)
                    if last == (x.block, slot):
                        self.text[-1] += " " + text
                        self.beside[-1] &= bool(beside[i])
                    else:
                        self._add(n, slot, text, bool(beside[i]) and slot == BODY)
                    last = (x.block, slot)
                i += 1

    def _add(self, page: int, slot: int, text: str, beside: bool) -> None:
        self.page.append(page)
        self.slot.append(slot)
        self.text.append(text)
        self.beside.append(beside)

    @staticmethod
    def _beside(pages: list[M.Page], chrome: np.ndarray) -> np.ndarray:
        if not any(p.lines for p in pages):
            return np.zeros(0, bool)
        paths = np.fromiter((o for p in pages for o in p.out), bool)
        return paths | (M._features(pages).scores(chrome, True) > BESIDE)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers by block, and the first of each block; every block has some."""
        n = len(self.text)
        h, doc, first = LC.word_lists(self.text)
        at = np.arange(n)
        words = np.diff(first)
        some = np.flatnonzero(words)
        mul = U(0x9E3779B97F4A7C15)
        two = np.flatnonzero(doc[1:] == doc[:-1])
        pair = h[two] * mul + h[two + 1]
        three = np.flatnonzero(doc[2:] == doc[:-2])
        size = np.array([len(t).bit_length() for t in self.text], U)
        ends = np.array([t[-1:] in ".!?…" for t in self.text], U)
        slot = np.array(self.slot, U)
        runs = [(i, zlib.crc32(r.encode())) for i, t in enumerate(self.text) for r in set(_RUN.findall(t))]
        title: dict[int, str] = {p: t for p, s, t in zip(self.page, self.slot, self.text) if s == TITLE}
        same = np.array([1 + (title.get(p) == t) if s == HEADLINE else 0 for p, s, t in zip(self.page, self.slot, self.text)], U)
        parts = [
            (doc, h, "one"), (doc[two], pair, "two"), (doc[three], (h[three] * mul + h[three + 1]) * mul + h[three + 2], "three"),
            (some, h[first[some]], "begin"), (some, h[first[some + 1] - 1], "end"), (some, words[some].astype(U) * U(0) + h[first[some]] * mul + slot[some], "begin"),
            (np.array([i for i, _ in runs], np.int64), np.array([r for _, r in runs], U), "run"),
            (at, (size * U(2) + ends) * U(4) + slot, "slot"), (at, same, "same"),
        ]
        rows = np.concatenate([r for r, _, _ in parts])
        idx = np.concatenate([(G.mix(v + _SALT[k]) & U(FEATURES - 1)).astype(np.int32) for _, v, k in parts])
        order = np.argsort(rows, kind="stable")
        return idx[order], np.searchsorted(rows[order], at)

    def phrases(self) -> np.ndarray:
        """Which blocks the phrases call residue."""
        return np.array([P.is_residue(t) for t in self.text], bool)

    def found(self, bad: np.ndarray, n_pages: int) -> np.ndarray:
        """Which pages are found, given the judgement of every block."""
        page, slot = np.array(self.page, np.int64), np.array(self.slot)
        size = np.array([len(t) for t in self.text], np.float64) * (slot == BODY) * (bad | ~np.array(self.beside, bool))
        out = np.zeros(n_pages, bool)
        out[page[bad & (slot != BODY)]] = True
        total, worst = np.bincount(page, size, n_pages), np.bincount(page, size * bad, n_pages)
        return out | ((total > 0) & (worst >= BODY_SHARE * total) & (worst > 0))


def _title(title: str, site: str) -> str:
    """The normalised title without the site's name at its end; '' if nothing else is left."""
    head = P.normal(title)
    parts = re.split(r" [|\-–—] ", head)
    if len(parts) > 1 and re.sub(r"\W|_", "", parts[-1]) and re.sub(r"\W|_", "", parts[-1]) in site:
        head = " ".join(parts[:-1])
    return head if re.sub(r"\W|_", "", head) not in site or not site else ""


def weak_labels(blocks: Blocks, status: list[int | None]) -> np.ndarray:
    """Labels of the blocks from phrases, and from an error status over a short headline and body."""
    if not blocks.text:
        return np.zeros(0, bool)
    page, own = np.array(blocks.page, np.int64), (np.array(blocks.slot) != TITLE) & ~np.array(blocks.beside, bool)
    size = np.bincount(page, np.array([len(t) for t in blocks.text]) * own, len(status))
    failed = np.array([s is not None and s >= 400 for s in status], bool) & (size < SHORT_BODY)
    return blocks.phrases() | (failed[page] & own)


def held_out(host: str) -> bool:
    """Whether a host belongs to the validation fold."""
    return zlib.crc32((host or "").encode()) % FOLDS == 0


def _pages(rows: DataFrame) -> DataFrame:
    host = source_of(F.col("domain"), F.col("url"))
    return rows.select(
        F.col("page_id").cast("long").alias("k"), F.col("html_content").alias("t"), F.col("title").alias("h"), M.site_name(host).alias("s"), host.alias("host"), F.col("status_code").cast("int").alias("status")
    ).filter(F.length("t") > 0)


def train(rows: DataFrame, bound: int = TRAIN_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(line classifier, weights) fitted on at most ``bound`` pages, the same ones on every run; the weights only on hosts outside the validation fold."""
    got = M.sample(_pages(rows), bound, SEED).toArrow().sort_by("k").to_pylist()  # `bound` pages of at most M.TRAIN_CHARS characters
    got = [r for r in got if not held_out(r["host"])]
    pages = [M.Page(r["k"], r["t"], r["h"], r["s"], True) for r in got]
    chrome = M.fit(pages[: M.TRAIN_PAGES], residue=False)
    if not pages:
        return chrome, LC.fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool), features=FEATURES)
    blocks = Blocks(pages, chrome)
    y = weak_labels(blocks, [r["status"] for r in got])
    idx, start = blocks.features()
    w = LC.fit(idx, start, y, features=FEATURES, rounds=60, balanced=True)
    return chrome, LC.fit(idx, start, y | (_scores(idx, start, w) > SURE), features=FEATURES, rounds=80, balanced=True)


def _scores(idx: np.ndarray, start: np.ndarray, w: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(start, len(idx)))
    return np.add.reduceat(w[idx], start) / np.sqrt(counts) + w[-1]


def judge(pages: list[M.Page], chrome: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, Blocks]:
    """Which pages are found."""
    blocks = Blocks(pages, chrome)
    if not blocks.text:
        return np.zeros(len(pages), bool), blocks
    return blocks.found(_scores(*blocks.features(), weights) > 0, len(pages)), blocks


def judged(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], with_weak: bool = False) -> DataFrame:
    """(page_id, host, found, weak): the classifier's verdict on every page with html, and if asked for the weak labels' verdict (else null)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chrome, weights = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got = batch.to_pylist()
                pages = [M.Page(r["k"], r["t"], r["h"], r["s"], True) for r in got]
                found, blocks = judge(pages, chrome, weights)
                weak = blocks.found(weak_labels(blocks, [r["status"] for r in got]), len(pages)) if with_weak and blocks.text else found if with_weak else [None] * len(pages)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(found, pa.bool_()), pa.array(weak, pa.bool_())], names=["page_id", "host", "found", "weak"])

    return _pages(rows).mapInArrow(run, "page_id long, host string, found boolean, weak boolean")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which residue, filler, a notice or a demand for scripts stands in place of a post."""
    rows = table(spark, sf_dir, "crawled_pages")
    return judged(rows, train(rows)).filter("found").select("page_id")


def p6_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifier and its weak labels agree, on trained and on unseen hosts: pages found by each and by both."""
    rows = table(spark, sf_dir, "crawled_pages")
    unseen = F.pmod(F.crc32(F.coalesce("host", F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
    out = judged(rows, train(rows), True).groupBy(unseen.alias("unseen_host"))
    return out.agg(F.count("*").alias("pages"), F.count_if("found").alias("found"), F.count_if("weak").alias("weak"), F.count_if(F.col("found") & F.col("weak")).alias("both"))


QUERIES = {"p6_found": p6_found, "p6_validation": p6_validation}
