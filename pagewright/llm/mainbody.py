"""Problem 1: the main body of a page, by tag-path ratios.

1. Every line of visible text belongs to a root-to-leaf tag path. Per page and path the operator
   adds up the length of text outside links and its punctuation; per container the sums of its
   paths are smoothed over the neighbouring containers of the page and fused into one score.
   Containers below a share of the best one are beside the post. Within the others a leaf path goes that
   consists of links, or whose mean length and punctuation are low while its tag sets it apart from the text.
2. The paths of all pages label lines for a linear classifier (see lineclass). Lines that come back in posts of
   many hosts, counted over all pages, and headings over lines that are beside the post, are labelled so too. The
   classifier is fitted on blocks of pages in tasks; a feature's weight is the mean over its occurrences in all blocks.
   It judges what the paths keep, and contents that came without markup, which are one path only.
3. A heading beside the post takes the rest of its container along; a block broken over lines is judged as a whole.

No list of phrases says what stands beside a post. Text that stands in place of a post (error notices, unfilled
templates) is labelled by the weak rules of problem 6 (pagelines.is_residue), and judged by the classifier.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import grams as G
from pagewright.llm import lineclass as LC
from pagewright.llm import pagelines as P
from pagewright.llm.source import source_of
from pagewright.plans.runtime import table

#: Share of the best container's score that a container needs, weight of a neighbour in the smoothing, and share of the best path's ratio that a set-apart leaf path needs.
KEEP, SMOOTH, LEAF = 0.34, 0.1, 0.2
#: Pages, and characters, of a block that the line classifier is fitted on at once (a longer page makes a larger block).
TRAIN_PAGES, BLOCK_CHARS = 2000, 32_000_000
#: Longest page in a sample in characters.
TRAIN_CHARS = 200_000
#: Hosts, and posts, in which a line must come back to count as recurring.
RECUR = 8
#: Share of the places of a recurring short line that lie beside the post by their paths, above which all do.
OFTEN = 0.2
SEED = 1
#: Weights are added up as whole multiples of this part, so that the sum does not depend on the order.
PARTS = 1 << 20
_APART = frozenset(["span", "small", "time", "button", "label", "address"])
_HEADINGS = frozenset(["h2", "h3", "h4", "h5", "h6"])
_CODE = frozenset(["code", "pre"])
_PUNCTUATION = str.maketrans("", "", ".,;:!?…。、！？؟—–“”\"'’«»„¿¡()")
_DIGITS = re.compile(r"\d+")
_LETTER = re.compile(r"[^\W\d_]")


def by_paths(lines: list[P.Line]) -> list[bool]:
    """Whether each line's path is beside the post; a page of one container has set-apart leaves only."""
    size: dict[str, float] = defaultdict(float)
    marks: dict[str, float] = defaultdict(float)
    count: dict[str, int] = defaultdict(int)
    for x in lines:
        size[x.path] += len(x.text) * (1 - x.linked)
        marks[x.path] += len(x.text) - len(x.text.translate(_PUNCTUATION)) if x.linked < 0.5 else 0
        count[x.path] += 1
    ratio = {p: (size[p] / n) * (1 + marks[p] / n) ** 0.5 for p, n in count.items()}
    boxes: dict[str, list[float]] = {}
    seen = set()
    for x in lines:
        at = boxes.setdefault(x.box, [0.0, 0.0])
        if x.path not in seen:
            seen.add(x.path)
            at[0] += size[x.path]
            at[1] += marks[x.path]
    v = list(boxes.values())
    ends = [0.0, 0.0]
    near = [(v[i - 1] if i else ends, v[i + 1] if i + 1 < len(v) else ends) for i in range(len(v))]
    fused = {b: (s[0] + SMOOTH * (a[0] + z[0])) * (1 + s[1] + SMOOTH * (a[1] + z[1])) ** 0.5 for b, s, (a, z) in zip(boxes, v, near)}
    best, top = max(fused.values(), default=0.0), max(ratio.values(), default=0.0)
    return [
        fused[x.box] < KEEP * best or x.linked > 0.9 or (ratio[x.path] < LEAF * top and not _APART.isdisjoint(x.path[len(x.box):].split("/")))
        for x in lines
    ]


class Page:
    """The lines of a page with what its paths say."""

    __slots__ = ("key", "lines", "title", "site", "out", "marked")

    def __init__(self, key: int, source: str, title: str | None, site: str | None, html_source: bool):
        self.key, self.title, self.site = key, title or "", site or ""
        self.lines = P.page_lines(source) if html_source else P.text_lines(source)
        self.marked = bool(self.lines) and self.lines[0].box != "text"
        self.out = by_paths(self.lines) if self.marked else [False] * len(self.lines)


def _features(pages: list[Page]) -> LC.Batch:
    lines = [x for p in pages for x in p.lines]
    return LC.Batch(
        [x.text for x in lines], np.repeat(np.arange(len(pages)), [len(p.lines) for p in pages]), [x.tag for x in lines], np.array([x.linked for x in lines]),
        [p.site for p in pages], [p.title for p in pages],
    )


def _whole(pages: list[Page], out: np.ndarray) -> np.ndarray:
    """Headings take the rest of their container along."""
    i = 0
    for p in pages:
        if p.marked:
            box = None
            for k, x in enumerate(p.lines):
                if box is not None and x.box != box:
                    box = None
                if box is not None:
                    out[i + k] = True
                elif x.tag in _HEADINGS and out[i + k]:
                    box = x.box
        i += len(p.lines)
    return out


def judge(pages: list[Page], weights: np.ndarray) -> np.ndarray:
    """Whether each line of the pages, in order, is beside the main body."""
    if not any(p.lines for p in pages):
        return np.zeros(0, bool)
    lines = [x for p in pages for x in p.lines]
    batch = _features(pages)
    paths = np.fromiter((o for p in pages for o in p.out), bool, len(lines))
    marked = np.repeat([p.marked for p in pages], [len(p.lines) for p in pages])
    score = np.where(marked, batch.scores(weights, True), batch.scores(weights, False))
    # a block broken over lines is judged as one
    block = np.array([x.block for x in lines], np.int64)
    head = np.concatenate(([True], (block[1:] != block[:-1]) | (batch.page[1:] != batch.page[:-1])))
    group = np.cumsum(head) - 1
    score = np.bincount(group, weights=score)[group]
    text = np.fromiter((x.tag not in _CODE and bool(_LETTER.search(x.text)) for x in lines), bool, len(lines))
    return _whole(pages, paths | ((score > 0) & text))


def _key(text: str) -> str:
    """A line as it is counted: normalised, digits aside."""
    return _DIGITS.sub("0", P.normal(text))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _places(pages: list[Page]) -> Iterator[tuple[int, int | None, int | None, int, int, bool]]:
    """(key, host, post, beside, n, whether it has three words), hashed: per line of the pages up to ``RECUR`` hosts and posts, one to a row, and in the
    first row how often its path is beside the post and how often it stands at all. Lines without a letter are left out."""
    hosts: dict[str, set[str]] = defaultdict(set)
    posts: dict[str, set[str]] = defaultdict(set)
    beside: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for p in pages:
        post = max((x.text for x in p.lines), key=len, default="")
        for x, o in zip(p.lines, p.out):
            k = _key(x.text)
            if len(hosts[k]) < RECUR:
                hosts[k].add(p.site)
            if len(posts[k]) < RECUR:
                posts[k].add(post)
            beside[k][0] += o
            beside[k][1] += 1
    site, post = lru_cache(None)(_hash), lru_cache(None)(_hash)
    for k, (out, n) in beside.items():
        if _LETTER.search(k):
            h = _hash(k)
            for i, (a, b) in enumerate(zip_longest(hosts[k], posts[k])):
                yield h, None if a is None else site(a), None if b is None else post(b), 0 if i else out, 0 if i else n, len(k.split()) >= 3


def recurring(ready: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the lines of all pages of ``prepared`` rows that come back in posts of several hosts, digits aside;
    and whether each is no part of the posts: it has three words or more, or stands beside the post by its path in a share ``OFTEN`` of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in G.slices(batch, "t"):
                rows = list(_places(_marked(part)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PLACE.types)], schema=_PLACE)

    at = ready.select("k", "t", "h", "s").mapInArrow(run, "key long, host long, post long, beside long, n long, long boolean")
    per = at.groupBy("key").agg(F.size(F.collect_set("host")).alias("hosts"), F.size(F.collect_set("post")).alias("posts"), F.sum("beside").alias("beside"), F.sum("n").alias("n"), F.max("long").alias("long"))
    often = per.filter((F.col("hosts") >= RECUR) & (F.col("posts") >= RECUR)).select("key", (F.col("long") | (F.col("beside") >= OFTEN * F.col("n"))).alias("apart"))
    got = often.toArrow().sort_by("key")  # 9 bytes a line that recurs
    return got["key"].to_numpy(), got["apart"].to_numpy()


_PLACE = pa.schema([("key", pa.int64()), ("host", pa.int64()), ("post", pa.int64()), ("beside", pa.int64()), ("n", pa.int64()), ("long", pa.bool_())])


def _marked(rows: pa.RecordBatch | pa.Table) -> list[Page]:
    """The pages with markup of ``prepared`` rows of HTML source."""
    return [p for r in rows.select(["k", "t", "h", "s"]).to_pylist() if (p := Page(*r.values(), True)).marked]


def _counted(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`recurring` gives, of pages at hand."""
    hosts: dict[int, set] = defaultdict(set)
    posts: dict[int, set] = defaultdict(set)
    sums: dict[int, list] = defaultdict(lambda: [0, 0, False])
    for k, host, post, out, n, long in _places(pages):
        hosts[k] |= {host} - {None}
        posts[k] |= {post} - {None}
        sums[k] = [sums[k][0] + out, sums[k][1] + n, long]
    keys = sorted(k for k in sums if len(hosts[k]) >= RECUR and len(posts[k]) >= RECUR)
    return np.array(keys, np.int64), np.array([sums[k][2] or sums[k][0] >= OFTEN * sums[k][1] for k in keys], bool)


def _recurring(pages: list[Page], often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line recurs and is no part of the posts; and whether it is a heading that recurs."""
    keys, apart = often
    if not len(keys):
        none = np.zeros(sum(len(p.lines) for p in pages), bool)
        return none, none
    lines = [x for p in pages for x in p.lines]
    h = np.array([_hash(_key(x.text)) for x in lines], np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    known = keys[at] == h
    return known & apart[at] & np.array([x.tag not in _CODE for x in lines], bool), known & np.array([x.tag in _HEADINGS for x in lines], bool)


def fit(pages: list[Page], residue: bool = True, rounds: int = 2, often: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights of the line classifier, from the paths of ``pages``; with ``residue`` it also learns what stands in place of a post.
    ``often`` holds the lines that recur, if they were counted over more than these pages."""
    return _fitted(pages, residue, rounds, often)[0]


def _fitted(pages: list[Page], residue: bool = True, rounds: int = 2, often: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The weights, and the occurrences of each feature; the last is that of the intercept, the lines."""
    pages = [p for p in pages if p.marked]
    if not pages:
        return LC.fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)), np.zeros(LC.FEATURES + 1, np.int64)
    lines = [x for p in pages for x in p.lines]
    batch = _features(pages)
    recurs, heading = _recurring(pages, often or _counted(pages))
    y = np.fromiter((o for p in pages for o in p.out), bool, len(lines)) | recurs
    bad = np.array([x.tag not in _CODE and P.is_residue(P.normal(x.text)) for x in lines], bool)
    y = y | bad if residue else y & ~bad
    (i1, s1), (i2, s2) = batch.plain, batch.full
    # a line's features with markup are those without it and then the rest
    line = np.repeat(np.arange(len(lines)), np.diff(np.append(s2, len(i2))))
    rest = np.arange(len(i2)) - s2[line] >= np.diff(np.append(s1, len(i1)))[line]
    more = i2[rest], line[rest]
    last = np.append(batch.page[1:] != batch.page[:-1], True)
    for k in range(rounds + 1):
        w = LC.fit(i1, s1, y, rounds=80, trust=0.6, more=more)
        if k < rounds:  # labels that the paths alone could not give
            sure = y | ((batch.scores(w, True) > 0) & (batch.scores(w, False) > 0))
            follows = np.append(sure[1:], False) & ~last
            y = _whole(pages, y | (heading & follows))
    return w, np.append(np.bincount(i1, minlength=LC.FEATURES) + np.bincount(i2, minlength=LC.FEATURES), 2 * len(lines))


def site_name(source: Column) -> Column:
    """The name a site goes by: the label before the last dot of its host."""
    parts = F.split(source, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(source)


def prepared(rows: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """(k, t, h, s): key, text, title and name of the site of the rows with a text."""
    site = site_name(source_of(F.col("domain"), F.col("url")))
    return rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(title).alias("h"), site.alias("s")).filter(F.length("t") > 0)


def sample(ready: DataFrame, bound: int, seed: int = SEED) -> DataFrame:
    """At most ``bound`` rows with the least hashes of (k, seed): the same ones on every run, however the table is split."""
    h = F.xxhash64("k", F.lit(seed))
    ready = ready.filter(F.length("t") <= TRAIN_CHARS)
    worst = ready.select(h.alias("h")).orderBy("h").limit(bound).agg(F.max("h").alias("m")).first().m
    return ready.filter(h <= worst) if worst is not None else ready.limit(0)


def train(ready: DataFrame, residue: bool = True) -> np.ndarray:
    """Weights fitted on all ``prepared`` rows of HTML source, block by block: a feature's is the mean over its occurrences.
    Blocks are made by the hash of k, so the weights don't depend on how the table is split; one block alone is fitted as it is."""
    size = ready.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // TRAIN_PAGES), -(-size.chars // BLOCK_CHARS))
    often = ready.sparkSession.sparkContext.broadcast(recurring(ready))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = list(batches)
        if block:
            rows = pa.Table.from_batches(block).sort_by([("k", "ascending"), ("t", "ascending")])
            w, n = _fitted(_marked(rows), residue, often=often.value)
            used = np.flatnonzero(n)
            whole = np.rint(w[used].astype(np.float64) * n[used] * PARTS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(whole), pa.array(n[used])], names=["f", "w", "n"])

    block = F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(blocks)).cast("int")
    per = ready.select("k", "t", "h", "s").repartitionById(blocks, block).mapInArrow(run, "f long, w long, n long")  # a block is a partition
    got = per.groupBy("f").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toArrow()  # as many rows as there are features
    out = fit([])
    if got.num_rows:
        out[:] = 0
        out[got["f"].to_numpy()] = got["w"].to_numpy() / PARTS / got["n"].to_numpy()
    return out


#: Pages that are judged together.
_TOGETHER = 500


def _judged(batches: Iterator[pa.RecordBatch], weights: np.ndarray, html_source: bool) -> Iterator[tuple[Page, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            pages = [Page(*r.values(), html_source) for r in batch.slice(at, _TOGETHER).select(["k", "t", "h", "s"]).to_pylist()]
            out, i = judge(pages, weights), 0
            for p in pages:
                yield p, out[i : i + len(p.lines)]
                i += len(p.lines)


def boilerplate(rows: DataFrame, weights: np.ndarray, key: str, text: str, title: str, origin: str) -> DataFrame:
    """(origin, rec_id, line_no): the lines of visible text that are not main body.

    Null and empty texts give no lines. ``rows`` needs domain and url too. ``origin`` search_index reads extracted content
    (lines with or without markup), anything else HTML source.
    """
    w, html_source = rows.sparkSession.sparkContext.broadcast(weights), origin != "search_index"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for p, out in _judged([batch], w.value, html_source):
                found = [x.no for x, o in zip(p.lines, out) if o]
                keys += [p.key] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32())], names=["rec_id", "line_no"])

    return prepared(rows, key, text, title).mapInArrow(run, "rec_id long, line_no int").select(F.lit(origin).alias("origin"), "rec_id", "line_no")


def main_text(rows: DataFrame, weights: np.ndarray, key: str, text: str, title: str, origin: str) -> DataFrame:
    """(origin, rec_id, main_text): the lines of the main body in order, joined by line breaks; rows with null or empty text are left out."""
    w, html_source = rows.sparkSession.sparkContext.broadcast(weights), origin != "search_index"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(p.key, "\n".join(x.text for x, o in zip(p.lines, out) if not o)) for p, out in _judged([batch], w.value, html_source)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string())], names=["rec_id", "main_text"])

    return prepared(rows, key, text, title).mapInArrow(run, "rec_id long, main_text string").select(F.lit(origin).alias("origin"), "rec_id", "main_text")


def _both(spark: SparkSession, sf_dir: str, operator) -> DataFrame:  # noqa: ANN001
    index, pages = table(spark, sf_dir, "search_index"), table(spark, sf_dir, "crawled_pages")
    weights = train(prepared(pages, "page_id", "html_content", "title"))
    a = operator(index, weights, "doc_idx", "content", "title", "search_index")
    return a.unionByName(operator(pages, weights, "page_id", "html_content", "title", "crawled_pages"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with visible text that is not main body, of both tables."""
    return _both(spark, sf_dir, boilerplate)


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every row of both tables."""
    return _both(spark, sf_dir, main_text)


QUERIES = {"p1_found": p1_found, "p1_main_text": p1_main_text}
