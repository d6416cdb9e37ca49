"""Problem 2: groups of near-duplicate records, by a forest of signature trees.

1. Rows with the same set of word n-grams collapse into a class; only its smallest row goes on.
2. Every class has a sketch string whose segments (see segments) are the roots of the forest: classes that have a segment in common
   meet in one tree. One tree over all records could not be split over executors; a pair at similarity 0.6 is in no common
   tree with a probability of 1.8e-7, however many copies its family has.
3. A tree's records carry a bitmap of their hashed n-grams and their size. They are ordered by size band and by a symbol that
   similar records share, and every ``FAN`` neighbours make a node, which holds the OR of the bitmaps and the range of sizes, level by level up to one node. The
   dual traversal goes down from pairs of nodes to pairs of records, dropping those whose sizes or largest possible overlap
   rule out the threshold.
4. What is left is verified on the whole n-gram sets.

A root of more than ``NODE`` records is cut into nodes of about ``NODE / 2`` by size band and by share; pairs of these nodes are joined where
the bound holds, and each pair is one traversal, so a root that a third of all rows have is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import grams as G
from pagewright.llm import segments as S
from pagewright.plans.joins import checked_join, salted_join
from pagewright.plans.runtime import materialize, table

#: Records of a root up to which it is one tree, and children of a node.
NODE, FAN = 1024, 4
#: Trees of up to so many records are a single node: all their pairs are looked at together.
FLAT = 16
U = np.uint64


def gram_sets(rows: DataFrame, key: str, text: str, n: int, shape: S.Shape) -> DataFrame:
    """(key, grams, symbols): the n-gram hashes of each row, folded to 32 bits to halve what the verification moves, and its sketch string.

    Two n-grams of a pair share a hash with a probability of about 1e-5, and shift its similarity by less than 1 / n then.
    """
    kept = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in G.slices(batch, "t"):
                g, doc, _ = G.word_grams(s.column(1), n)
                counts = np.bincount(doc, minlength=s.num_rows)
                off = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                symbols = np.zeros((s.num_rows, shape.symbols), np.uint8)
                if len(g):
                    symbols[np.unique(doc)] = S.draw(g, doc, shape)[1]
                grams = pa.ListArray.from_arrays(off, pa.array((g >> np.uint64(6)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([s.column(0), grams, S._binaries(symbols)], names=["key", "grams", "symbols"])

    return kept.mapInArrow(make, "key long, grams array<int>, symbols binary")


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1).astype(np.int64)


def _records_fit(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two records can reach the threshold: each bit only one bitmap has is an n-gram the other lacks."""
    n1, n2 = x["n"].astype(np.int64), y["n"].astype(np.int64)
    both = x["bits"] & y["bits"]
    most = np.minimum(n1 - _ones(x["bits"] ^ both), n2 - _ones(y["bits"] ^ both))
    return most >= (n1 + n2) * (threshold / (1 + threshold)) - 1e-6


class Level:
    """The nodes of one level of a tree: range of sizes, OR of bitmaps, and largest excess of a size over its bits."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, slack: np.ndarray, bits: np.ndarray):
        self.lo, self.hi, self.slack, self.bits = lo, hi, slack, bits

    def up(self) -> Level:
        start = np.arange(0, len(self.lo), FAN)
        return Level(np.minimum.reduceat(self.lo, start), np.maximum.reduceat(self.hi, start), np.maximum.reduceat(self.slack, start), np.bitwise_or.reduceat(self.bits, start, axis=0))

    def pairs_fit(self, other: Level, i: np.ndarray, j: np.ndarray, threshold: float, seen: np.ndarray) -> np.ndarray:
        """Whether nodes i of this and j of the other level may hold a similar pair. ``seen`` counts the pairs looked at, and those dropped by size and by overlap.

        A record's overlap with a record of the other node is at most its size less the bits it has outside the other's OR; so for the node
        the shared bits, plus the most n-grams that a record has beyond its bits, bound it.
        """
        small = (self.hi[i] >= other.lo[j] * threshold - 1e-6) & (other.hi[j] >= self.lo[i] * threshold - 1e-6)
        most = _ones(self.bits[i] & other.bits[j]) + np.minimum(self.slack[i], other.slack[j])
        most = np.minimum(most, np.minimum(self.hi[i], other.hi[j]))
        fit = most >= (self.lo[i] + other.lo[j]) * (threshold / (1 + threshold)) - 1e-6
        seen += (len(i), (~small).sum(), (small & ~fit).sum())
        return small & fit


def _tree(recs: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The records in tree order, and the levels from single records to the root."""
    band = np.floor(np.log(np.maximum(recs["n"], 1)) / np.log(1.15)).astype(np.int64)
    recs = recs[np.lexsort((recs["cid"], recs["near"], band))]
    n = recs["n"].astype(np.int64)
    levels = [Level(n, n, n - _ones(recs["bits"]), recs["bits"])]
    while len(levels[-1].lo) > 1:
        levels.append(levels[-1].up())
    return recs, levels


def traverse(a: np.ndarray, b: np.ndarray | None, threshold: float, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cid, cid) of the pairs of records of two trees, or of one with itself, that the bounds cannot rule out."""
    a, up = _tree(a)
    other, vp = (a, up) if b is None else _tree(b)
    high, low = len(up) - 1, len(vp) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i) and (high or low):
        # down on the taller side, or on both
        di, dj = high >= low, low >= high
        ci = (i[:, None] * FAN + np.arange(FAN)) if di else i[:, None]
        cj = (j[:, None] * FAN + np.arange(FAN)) if dj else j[:, None]
        i, j = np.repeat(ci, cj.shape[1], axis=1).reshape(-1), np.tile(cj, (1, ci.shape[1])).reshape(-1)
        high, low = high - di, low - dj
        ok = (i < len(up[high].lo)) & (j < len(vp[low].lo))
        if b is None:
            ok &= i <= j
        i, j = i[ok], j[ok]
        if high or low:
            fit = up[high].pairs_fit(vp[low], i, j, threshold, seen[:3])
            i, j = i[fit], j[fit]
    if b is None:
        i, j = i[i < j], j[i < j]
    fit = _records_fit(a[i], other[j], threshold)
    seen[3:] += (len(i), int(fit.sum()))
    return a["cid"][i[fit]], other["cid"][j[fit]]


def _flat_pairs(recs: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within groups of ``count`` records in a row."""
    start = np.cumsum(count) - count
    after = np.repeat(count, count) - 1 - (np.arange(len(recs)) - np.repeat(start, count))  # records behind each in its group
    i = np.repeat(np.arange(len(recs)), after)
    j = i + 1 + (np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after))
    return i, j


def _cross(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one of ``na`` and one of ``nb`` records, group by group."""
    each = np.repeat(nb, na)  # partners of every left record
    i = np.repeat(np.arange(len(each)), each)
    start = np.repeat(np.cumsum(nb) - nb, na)
    j = np.repeat(start, each) + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
    return i, j


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All records of a column of lists of packed texts, and the number of each list."""
    flat = S.matrix(column.flatten(), S.RECORD)
    return flat.reshape(-1), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


COUNTS = ("node_pairs", "by_size", "by_overlap", "record_pairs", "left")


def traversed(nodes: DataFrame, threshold: float, counts: bool = False, ordered: bool = True) -> DataFrame:
    """(cid_a, cid_b) of the pairs left by the trees of ``nodes`` (a, b): lists of packed texts, b null for one tree with itself; or the traversals' counts.

    With ``ordered`` cid_a is the smaller one, else the one of list a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(5, np.int64)
            a, na = _lists(batch.column(0))
            single = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            b, nb = _lists(batch.column(1))
            sa, sb = np.cumsum(na) - na, np.cumsum(np.where(single, 0, nb)) - np.where(single, 0, nb)
            flat = single & (na <= FLAT)
            some = a[np.repeat(flat, na)]
            i, j = _flat_pairs(some, na[flat])
            fit = _records_fit(some[i], some[j], threshold)
            seen[3:] += (len(i), int(fit.sum()))
            left, right = [some["cid"][i[fit]]], [some["cid"][j[fit]]]
            low = ~single & (na * nb <= FLAT * FLAT)
            x, y = a[np.repeat(low, na)], b[np.repeat(low, nb)]
            i, j = _cross(na[low], nb[low])
            fit = _records_fit(x[i], y[j], threshold)
            seen[3:] += (len(i), int(fit.sum()))
            left.append(x["cid"][i[fit]])
            right.append(y["cid"][j[fit]])
            for k in np.flatnonzero(~flat & ~low):
                x, y = traverse(a[sa[k] : sa[k] + na[k]], None if single[k] else b[sb[k] : sb[k] + nb[k]], threshold, seen)
                left.append(x)
                right.append(y)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(seen[k : k + 1]) for k in range(5)], names=list(COUNTS))
                continue
            x, y = np.concatenate(left), np.concatenate(right)
            if len(x):
                pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)] if ordered else [x, y]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["cid_a", "cid_b"])

    return nodes.select("a", "b").mapInArrow(run, ", ".join(f"{c} long" for c in COUNTS) if counts else "cid_a long, cid_b long")


def _opened(big: DataFrame) -> DataFrame:
    """(root, rec, n, bits): packed texts with their size and bitmap beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs = S.matrix(batch.column(1), S.RECORD).reshape(-1)
            off = pa.array(np.arange(len(recs) + 1, dtype=np.int32) * S.WORDS)
            bits = pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(recs["bits"]).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(recs["n"])), bits], names=["root", "rec", "n", "bits"])

    return big.select("root", "rec").mapInArrow(run, "root long, rec binary, n int, bits array<long>")


def _node_stats() -> list[Column]:
    ones = sum((F.bit_count(F.col("bits")[i]) for i in range(S.WORDS)), F.lit(0))
    return [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - ones).alias("slack"), F.array(*[F.bit_or(F.col("bits")[i]) for i in range(S.WORDS)]).alias("any")]


def _nodes_possible(a: str, b: str, threshold: float) -> Column:
    """The bound of :meth:`Level.pairs_fit` for nodes in a join."""
    both = sum((F.bit_count(F.col(f"{a}.any")[i].bitwiseAND(F.col(f"{b}.any")[i])) for i in range(S.WORDS)), F.lit(0))
    most = F.least(both + F.least(f"{a}.slack", f"{b}.slack"), F.col(f"{a}.hi"), F.col(f"{b}.hi"))
    sizes = (F.col(f"{a}.hi") >= F.col(f"{b}.lo") * threshold - 1e-6) & (F.col(f"{b}.hi") >= F.col(f"{a}.lo") * threshold - 1e-6)
    return sizes & (most >= (F.col(f"{a}.lo") + F.col(f"{b}.lo")) * (threshold / (1 + threshold)) - 1e-6)


def forest(sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the trees to traverse, as lists of packed texts; b null for a tree with itself. ``sigs``: (cid, segs, rec), written and of unique cid."""
    buckets = S.buckets_for(sigs.count(), S.SHAPE)
    met = S.shared(S.packed(sigs, buckets, S.SHAPE), buckets, NODE).join(sigs.select("cid", "rec"), "cid")
    met = materialize(met.select("root", "rec", "big"), "p2-met")
    small = met.filter("not big").groupBy("root").agg(F.collect_list("rec").alias("a")).select("a", F.lit(None).cast("array<binary>").alias("b"))
    big = met.filter("big").select("root", "rec")
    if big.isEmpty():
        return small
    # the top of a large tree: nodes by size band, then by share
    parts = _opened(big).withColumn("h", F.xxhash64("rec"))
    parts = parts.withColumn("band", F.floor(F.log("n") / float(np.log(1.15))).cast("int"))
    inner = materialize(parts.groupBy("root", "band").agg(F.count("*").alias("mb"), *_node_stats()), "p2-inner")
    x, y = inner.alias("x"), inner.alias("y")
    bands = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.band") <= F.col("y.band")) & _nodes_possible("x", "y", threshold))
    bands = bands.select(F.col("x.root").alias("root"), F.col("x.band").alias("band_x"), F.col("y.band").alias("band_y"))
    share = F.pmod(F.col("h"), F.greatest(F.ceil(F.col("mb") / (NODE // 2)), F.lit(1)))
    leaves = salted_join(parts, inner.select("root", "band", "mb"), ["root", "band"], "inner", "h").withColumn("share", share)
    leaves = materialize(leaves.groupBy("root", "band", "share").agg(F.collect_list("rec").alias("recs"), *_node_stats()), "p2-leaves")
    left, right = (leaves.select("root", F.col("band").alias(f"band_{n}"), F.struct("share", "lo", "hi", "slack", "any", "recs").alias(n)) for n in "xy")
    ordered = (F.col("band_x") < F.col("band_y")) | (F.col("x.share") <= F.col("y.share"))
    pairs = bands.join(left, ["root", "band_x"]).join(right, ["root", "band_y"]).filter(ordered & _nodes_possible("x", "y", threshold))
    same = (F.col("band_x") == F.col("band_y")) & (F.col("x.share") == F.col("y.share"))
    return small.unionByName(pairs.select(F.col("x.recs").alias("a"), F.when(~same, F.col("y.recs")).alias("b")))


def most_edits(threshold: float, shape: S.Shape = S.SHAPE) -> int:
    """Substitutions between the sketch strings of two texts at ``threshold`` that six standard deviations allow."""
    n = shape.symbols
    return min(n, ceil(n * (1 - threshold) + 6 * sqrt(n * threshold * (1 - threshold))))


#: Symbols of the sketch string that are compared before whole sets are.
CHECKED = S.Shape(S.SHAPE.segments // 2, S.SHAPE.length)


def verified(pairs: DataFrame, rows: DataFrame, key: str, text: str, n: int, threshold: float) -> DataFrame:
    """(cid_a, cid_b, similarity) of the candidate pairs that reach the threshold on whole n-gram sets.

    First sketch strings within ``most_edits`` substitutions (the strings have one length, so this bounds their edit distance), which are a quarter of the sets' size; a pair at the
    threshold exceeds them with a probability of 1e-9. Only the texts of candidates are read. The joins by record are inner ones, so the adaptive
    skew join splits a record with many partners.
    """
    pairs = materialize(pairs, "p2-pairs")
    ids = materialize(pairs.select(F.col("cid_a").alias(key)).union(pairs.select("cid_b")).distinct(), "p2-ids")
    sets = materialize(gram_sets(checked_join(rows, ids, [key], "left_semi", key), key, text, n, CHECKED), "p2-sets")

    def both(pairs: DataFrame, column: str) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(sets.select(F.col("key").alias(f"cid_{x}"), F.col(column).alias(x)), f"cid_{x}")
        return pairs

    most = most_edits(threshold, CHECKED)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(0, np.int64)
            if batch.num_rows:
                ok = np.flatnonzero((S.matrix(batch.column(2), np.uint8) != S.matrix(batch.column(3), np.uint8)).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(ok)) for i in range(2)], names=["cid_a", "cid_b"])

    left = both(pairs, "symbols").select("cid_a", "cid_b", "a", "b").mapInArrow(near, "cid_a long, cid_b long")
    whole = both(left, "grams")
    common = F.size(F.array_intersect("a", "b"))
    sim = common / (F.size("a") + F.size("b") - common)
    return whole.select("cid_a", "cid_b", sim.alias("similarity")).filter(F.col("similarity") >= threshold)


def classes(sigs: DataFrame, key: str) -> DataFrame:
    """(key, cid) of rows whose n-gram set occurs more than once: cid is the smallest key of the set."""
    multi = materialize(sigs.groupBy("sum", "n").agg(F.min(key).alias("cid"), F.count("*").alias("m")).filter("m > 1").drop("m"), "p2-classes")
    return checked_join(sigs.select(key, "sum", "n"), multi, ["sum", "n"], "inner", key).select(key, "cid")


def representatives(rows: DataFrame, key: str, text: str, n: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(cid, segs, rec) of one row of each class, and the members (key, cid) of classes of several rows."""
    sigs = materialize(S.sketches(rows.select(key, text), key, text, [], n, min_words, S.SHAPE), "p2-sigs")
    members = materialize(classes(sigs, key), "p2-members")
    copies = members.filter(F.col(key) != F.col("cid")).select(key)
    return checked_join(sigs, copies, [key], "left_anti", key).select(F.col(key).alias("cid"), "segs", "rec"), members


def similar(
    rows: DataFrame, key: str = "doc_idx", text: str = "content", n: int = 3, threshold: float = 0.6, min_words: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes: (cid_a, cid_b, similarity), and the members (key, cid) of classes of several rows.

    Similarity is the Jaccard coefficient of the distinct word n-grams; rows with fewer than
    ``min_words`` words (null and empty texts too) have no partners. Rows with equal sets form
    one class, named by its smallest key; ``key`` must be unique. Extra columns are ignored.
    """
    reps, members = representatives(rows, key, text, n, min_words)
    pairs = traversed(forest(reps, threshold), threshold).distinct()
    return verified(pairs, rows.select(key, text), key, text, n, threshold), members


def expanded(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """All row pairs (a < b): of similar classes, and within classes. A class of many rows is split into shares on one side."""
    left, right = members.select(F.col(key).alias("a"), F.col("cid").alias("cid_a")), members.select(F.col(key).alias("b"), F.col("cid").alias("cid_b"))
    one = checked_join(pairs.select("cid_a", "cid_b"), left, ["cid_a"], "left", "cid_b").select(F.coalesce("a", "cid_a").alias("a"), "cid_b")
    across = checked_join(one, right, ["cid_b"], "left", "a").select("a", F.coalesce("b", "cid_b").alias("b"))
    within = checked_join(left.withColumnRenamed("cid_a", "cid"), right.withColumnRenamed("cid_b", "cid"), ["cid"], "inner", "a").filter("a < b").select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, group): the smallest id that a chain of edges (a, b) reaches; ids without an edge are absent.

    Alternates large-star and small-star steps, each over a written table, until nothing moves.
    """
    state = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a center of many edges is split into shares
        large = checked_join(both.filter("v > u"), materialize(low, "cc-low"), ["u"], "inner", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = checked_join(large, materialize(low, "cc-low"), ["u"], "inner", "v").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialize(small.filter("u <> v").distinct(), "cc")
        if new.count() == state.count() and new.join(state, ["u", "v"], "left_anti").isEmpty():
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return state.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows whose contents are similar to at least 0.6."""
    pairs, members = similar(table(spark, sf_dir, "search_index"))
    return expanded(pairs, members, "doc_idx").select(F.col("a").alias("doc_idx_a"), F.col("b").alias("doc_idx_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its class of equal n-gram sets, its group of linked rows, and the links of its class to others."""
    rows = table(spark, sf_dir, "search_index")
    pairs, members = similar(rows)
    pairs = materialize(pairs, "p2-links")
    links = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    groups = components(pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))).withColumnRenamed("id", "cid")
    out = rows.select("doc_idx").join(members, "doc_idx", "left").withColumn("cid", F.coalesce("cid", "doc_idx"))
    return out.join(links, "cid", "left").join(groups, "cid", "left").select(
        "doc_idx", F.col("cid").alias("class_id"), F.coalesce("group", "cid").alias("group_id"), F.coalesce("links", F.lit(0)).alias("n_links")
    )


def p2_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the dual traversal of all trees looks at and drops: node pairs, those dropped by size and by overlap, record pairs, those left to verify."""
    reps, _ = representatives(table(spark, sf_dir, "search_index"), "doc_idx", "content", 3, 20)
    counts = traversed(forest(reps, 0.6), 0.6, counts=True)
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_trees": p2_trees}

GRAMS_SQL = r"""w AS (SELECT doc_idx, batch_no, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM search_index),
  g AS (SELECT DISTINCT doc_idx, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
  n AS (SELECT doc_idx, count(*) AS n FROM g GROUP BY 1),
  o AS (SELECT a.doc_idx AS a, b.doc_idx AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_idx < b.doc_idx GROUP BY ALL),
  pairs AS (SELECT a, b FROM o JOIN n x ON x.doc_idx = a JOIN n y ON y.doc_idx = b WHERE o >= 0.6 * (x.n + y.n - o))"""

ORACLE_SQL = {
    "p2_found": f"WITH {GRAMS_SQL} SELECT a AS doc_idx_a, b AS doc_idx_b FROM pairs",
    "p2_groups": f"""WITH RECURSIVE {GRAMS_SQL}, s AS (SELECT doc_idx, md5(string_agg(g, '|' ORDER BY g)) AS s FROM g GROUP BY 1), c AS (SELECT doc_idx, min(doc_idx) OVER (PARTITION BY s) AS c FROM s),
      e AS (SELECT DISTINCT x.c AS a, y.c AS b FROM pairs JOIN c x ON x.doc_idx = a JOIN c y ON y.doc_idx = b WHERE x.c <> y.c), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT a AS c, a AS d FROM both_ UNION SELECT r.c, b.b FROM r JOIN both_ b ON b.a = r.d), m AS (SELECT c, min(d) AS grp FROM r GROUP BY 1), k AS (SELECT a AS c, count(*) AS links FROM both_ GROUP BY 1)
      SELECT i.doc_idx, coalesce(c.c, i.doc_idx) AS class_id, coalesce(grp, c.c, i.doc_idx) AS group_id, coalesce(links, 0) AS n_links
      FROM search_index i LEFT JOIN c USING (doc_idx) LEFT JOIN m ON m.c = c.c LEFT JOIN k ON k.c = c.c""",
}
