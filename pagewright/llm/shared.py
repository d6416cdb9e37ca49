"""Problem 10: long spans that stand word for word in more than one record.

A sparse De Bruijn graph over code points: of every ``SPAN - K + 1`` consecutive k-mers the
one with the least hash is a node (so every stretch of ``SPAN`` characters holds a node, the
same one in every record that has the stretch), and two nodes in a row are joined by an edge
that carries the hash of the text from the first to the end of the second. Only nodes found
in several records stay. Non-branching paths compact through joins: a node that every record
enters by one edge, which is also the only edge out of the node before it, says nothing new
and goes; the head of the path stands for it. The remaining occurrences are verified
at their source coordinates: the texts left and right of the node decide exactly whether two
records agree over ``SPAN`` characters around it.

Records with equal texts are one class and are put back at the end. Nodes with many
occurrences are not compared pair by pair: the ``SPAN``-character windows around the node are
hashed, and equal windows meet by a join key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import grams as G
from pagewright.llm.keyfilter import bits_for, filter_of, may_hold
from pagewright.llm.sigtree import expanded
from pagewright.plans.joins import checked_join, salted_join, shuffled_join
from pagewright.plans.runtime import materialize, table

SPAN, K = 200, 64
#: Occurrences of a node up to which pairs are compared directly.
DIRECT = 64


def _window_minima(h: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some window of ``w`` valid values in a row."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    h = np.where(valid, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad = -n % w
    x = np.concatenate((h, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64))).reshape(-1, w)
    forward = np.minimum.accumulate(x, axis=1).reshape(-1)[:n]
    backward = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    least = np.minimum(backward[: n - w + 1], forward[w - 1 :])
    run = np.cumsum(np.concatenate(([0], valid.astype(np.int32))))
    whole = run[w:] - run[:-w] == w
    least = np.where(whole, least, np.uint64(0))  # a window across two texts selects nothing
    # a position is selected if its value equals the least of a window that covers it: the greatest of these minima decides
    m = len(least)
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    m = len(padded)
    pad = -m % w
    y = np.concatenate((padded, np.zeros(pad, np.uint64))).reshape(-1, w)
    forward = np.maximum.accumulate(y, axis=1).reshape(-1)[:m]
    backward = np.maximum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:m]
    most = np.maximum(backward[: m - w + 1], forward[w - 1 :])
    return np.flatnonzero((most == h) & valid)


def _nodes(texts: pa.Array, edges: bool, span: int, k: int, twins: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, text number, position) of the nodes of each text of at least ``span`` code points; with ``edges`` their edges in and out too (0: none).

    With ``twins`` (text number, position, position of the kept twin) of all occurrences, where those with the same surroundings are twins.
    """
    cp, off = G.code_points(texts)
    h, inside = G.rolling(cp, off, k)
    long_enough = np.diff(off) >= span
    doc_of = np.searchsorted(off, np.arange(0), side="right")
    at = _window_minima(h, inside, span - k + 1)
    doc_of = np.searchsorted(off, at, side="right") - 1
    ok = long_enough[doc_of]
    at, doc_of = at[ok], doc_of[ok]
    node = h[at]
    # the same node with the same surroundings twice in one text is one occurrence
    up, down = G.powers(len(cp))
    total = np.concatenate(([np.uint64(0)], np.cumsum(G._char_mix()[cp] * up[: len(cp)]))) if len(cp) else np.zeros(1, np.uint64)

    def hashed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return G.mix((total[e] - total[s]) * down[np.minimum(s, max(len(cp) - 1, 0))] + (e - s).astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)

    reach = span - k
    s, e = np.maximum(at - reach, off[doc_of]), np.minimum(at + k + reach, off[doc_of + 1])
    around = hashed(s, e) ^ G.mix(node) ^ G.mix((at - s).astype(np.uint64))
    if len(at):
        order = np.lexsort((at, around, doc_of))
        first = np.concatenate(([True], (around[order][1:] != around[order][:-1]) | (doc_of[order][1:] != doc_of[order][:-1])))
        if twins:
            kept = order[first][np.cumsum(first) - 1]
            return doc_of[order], (at[order] - off[doc_of[order]]).astype(np.int32), (at[kept] - off[doc_of[kept]]).astype(np.int32)
        keep = np.sort(order[first])
        at, doc_of, node, around = at[keep], doc_of[keep], node[keep], around[keep]
    pos = (at - off[doc_of]).astype(np.int32)
    if twins:
        return doc_of, pos, pos
    if not edges:
        return node, doc_of, pos
    link = np.zeros(len(at) + 1, np.uint64)
    if len(at) > 1:
        edge = hashed(at[:-1], at[1:] + k) | np.uint64(1)
        link[1:-1] = np.where(doc_of[1:] == doc_of[:-1], edge, np.uint64(0))
    return node, doc_of, pos, around, link[:-1], link[1:]


def nodes(rows: DataFrame, key: str, text: str, edges: bool, span: int = SPAN, k: int = K, held: object = None, bits: int = 0) -> DataFrame:
    """(node, key) or, with edges, (node, key, pos, around, edge_in, edge_out); with a broadcast filter only the nodes that it may hold."""
    kept = rows.select(F.col(key), F.col(text).alias("t"))
    kind = kept.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in G.slices(batch, "t"):
                node, doc, *rest = _nodes(s.column(1), edges, span, k)
                if held is not None:
                    ok = may_hold(held.value, node.view(np.int64), bits)
                    node, doc, rest = node[ok], doc[ok], [x[ok] for x in rest]
                cols = [pa.array(node.view(np.int64)), s.column(0).take(pa.array(doc))]
                if edges:
                    pos, around, e_in, e_out = rest
                    cols += [pa.array(pos), *(pa.array(x.view(np.int64)) for x in (around, np.ascontiguousarray(e_in), np.ascontiguousarray(e_out)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", key, "pos", "around", "edge_in", "edge_out"])
                else:
                    yield pa.RecordBatch.from_arrays(cols, names=["node", key])

    more = ", pos int, around long, edge_in long, edge_out long" if edges else ""
    return kept.mapInArrow(run, f"node long, `{key}` {kind}{more}")


def twins(rows: DataFrame, key: str, text: str, span: int = SPAN, k: int = K) -> DataFrame:
    """(key, at, pos): every other place ``at`` of a record whose node and surroundings are those of the occurrence at pos."""
    kept = rows.select(F.col(key), F.col(text).alias("t"))
    kind = kept.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in G.slices(batch, "t"):
                doc, at, pos = _nodes(s.column(1), False, span, k, True)
                ok = np.flatnonzero(at != pos)
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(doc[ok])), pa.array(at[ok]), pa.array(pos[ok])], names=[key, "at", "pos"])

    return kept.mapInArrow(run, f"`{key}` {kind}, at int, pos int")


def compacted(at: DataFrame) -> DataFrame:
    """The occurrences without those of nodes inside a non-branching path."""
    per = materialize(
        at.groupBy("node").agg(
            F.min("edge_in").alias("in1"), F.max("edge_in").alias("in2"), F.min("edge_out").alias("out1"), F.max("edge_out").alias("out2")
        ),
        "p10-nodes",
    )
    one_in = per.filter("in1 = in2 and in1 <> 0").select("node", F.col("in1").alias("edge"))
    one_out = per.filter("out1 = out2 and out1 <> 0").select(F.col("out1").alias("edge"))
    inner = materialize(shuffled_join(one_in, one_out, "edge", "left_semi").select("node"), "p10-inner")
    return checked_join(at, inner, ["node"], "left_anti", "pos")


def _cut(rows: DataFrame, at: DataFrame, key: str, text: str, span: int, k: int) -> DataFrame:
    """(node, key, pos, around, m, left, right): the text before the node, reversed, and after it, up to ``span - k`` characters."""
    per = materialize(at.groupBy(key).agg(F.collect_list(F.struct("node", "pos", "around", "m")).alias("at")), "p10-per")  # bounded by the record's length
    # only the texts concerned are moved
    joined = shuffled_join(checked_join(rows.select(key, F.col(text).alias("t")), per.select(key), [key], "left_semi", key), per, key)
    reach = span - k
    kind = joined.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in G.slices(batch, "t"):
                keys, out = [], ([], [], [], [], [], [])
                for key_, t, found in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).to_pylist()):
                    for o in found:
                        p = o["pos"]
                        keys.append(key_)
                        for x, v in zip(out, (o["node"], p, o["around"], o["m"], t[max(0, p - reach) : p][::-1], t[p + k : p + k + reach])):
                            x.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(keys, s.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())],
                    names=["node", key, "pos", "around", "m", "left", "right"],
                )

    return joined.mapInArrow(run, f"node long, `{key}` {kind}, pos int, around long, m long, left string, right string")


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _agree(pairs: DataFrame, span: int, k: int) -> DataFrame:
    """(a, b, pos_a, pos_b, before, after) of the pairs of occurrences that agree over ``span`` characters."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = pairs.select("a", "b", "pos_a", "pos_b", "left_a", "left_b", "right_a", "right_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lb, ra, rb = (batch.column(i).to_pylist() for i in range(4, 8))
            before = np.fromiter(map(common_prefix, la, lb), np.int32, len(la))
            after = np.fromiter(map(common_prefix, ra, rb), np.int32, len(la))
            ok = np.flatnonzero(before + after + k >= span)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(ok)) for i in range(4)), pa.array(before[ok]), pa.array(after[ok])], names=["a", "b", "pos_a", "pos_b", "before", "after"]
            )

    return pairs.mapInArrow(run, f"a {kind}, b {kind}, pos_a int, pos_b int, before int, after int")


def _windows(cut: DataFrame, span: int, k: int) -> DataFrame:
    """For nodes with many occurrences: (node, window, key, pos, before) for each ``span``-character window that holds the node."""
    text = F.concat(F.reverse("left"), F.substring(F.lit(" " * k), 1, k), F.col("right"))
    first = F.greatest(F.lit(0), F.lit(span - k) - F.length("right"))
    steps = F.sequence(first, F.length("left"))
    # `before` characters left of the node belong to the window, span - k - before right of it
    exploded = cut.filter(F.length("left") >= first).withColumn("text", text).withColumn("before", F.explode(steps))
    window = F.xxhash64("before", F.substring(F.col("text"), F.length("left") - F.col("before") + 1, F.lit(span)))
    return exploded.select("node", window.alias("window"), F.col("_key"), "pos", "before")


def classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cid) of rows whose text occurs more than once; cid is the smallest key."""
    hashed = rows.filter(F.col(text).isNotNull()).select(key, F.md5(text).alias("h"))
    multi = materialize(hashed.groupBy("h").agg(F.min(key).alias("cid"), F.count("*").alias("m")).filter("m > 1").drop("m"), "p10-classes")
    return checked_join(hashed, multi, ["h"], "inner", key).select(key, "cid")


def shared_spans(rows: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, compact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(a, b, pos_a, pos_b, before, after) between text classes, and the members (key, cid) of classes of several rows.

    Each row is a place where both texts agree from ``before`` characters ahead of pos to
    ``after`` characters behind the node of ``k`` characters at pos (0-based code points), at least
    ``span`` in all; the ends are clipped to ``span - k`` characters. Texts below
    ``span`` characters, null and empty ones share nothing. ``key`` must be unique. With
    ``compact=False`` all places come out but repeats within a text; with those of their ``twins`` their union covers every shared stretch.
    """
    rows = rows.select(key, text).filter(F.length(text) >= span)
    members = materialize(classes(rows, key, text), "p10-members")
    copies = members.filter(F.col(key) != F.col("cid")).select(key)
    reps = checked_join(rows, copies, [key], "left_anti", key)
    # first only which nodes several records have, then their occurrences
    seen = nodes(reps, key, text, False, span, k).groupBy("node").agg(F.min(key).alias("x"), F.max(key).alias("y"), F.count("*").alias("m"))
    several = materialize(seen.filter("x < y").select("node", "m"), "p10-several")
    bits = bits_for(several.count())
    held = rows.sparkSession.sparkContext.broadcast(filter_of(several, bits))  # of bounded size
    at = materialize(shuffled_join(nodes(reps, key, text, True, span, k, held, bits), several, "node"), "p10-at")
    if compact:
        at = compacted(at)
    cut = materialize(_cut(reps, at, key, text, span, k).withColumnRenamed(key, "_key"), "p10-cut")
    few = cut.filter(F.col("m") <= DIRECT)
    a = few.select("node", *(F.col(c).alias(n) for c, n in (("_key", "a"), ("pos", "pos_a"), ("left", "left_a"), ("right", "right_a"))))
    b = few.select("node", *(F.col(c).alias(n) for c, n in (("_key", "b"), ("pos", "pos_b"), ("left", "left_b"), ("right", "right_b"))))
    found = _agree(shuffled_join(a, b, "node").filter("a < b"), span, k)  # both sides hold texts
    many = cut.filter(F.col("m") > DIRECT)
    if not many.isEmpty():
        w = _windows(many, span, k)
        x, y = (w.select("node", "window", F.col("_key").alias(n), F.col("pos").alias(f"pos_{n}"), F.col("before").alias(f"before_{n}")) for n in "ab")
        met = salted_join(x, y, ["node", "window"], "inner", "a").filter("a < b")  # a window that many records have is split into shares
        found = found.unionByName(met.select("a", "b", "pos_a", "pos_b", F.col("before_a").alias("before"), (F.lit(span - k) - F.col("before_a")).cast("int").alias("after")))
    return found, members


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents with a common stretch of at least 200 characters."""
    found, members = shared_spans(table(spark, sf_dir, "documents"))
    pairs = found.select("a", "b").distinct()
    pairs = pairs.select(F.col("a").alias("cid_a"), F.col("b").alias("cid_b"))
    return expanded(pairs, members, "doc_id").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its length, the characters that lie in stretches shared with other documents, and their share."""
    return shares(table(spark, sf_dir, "documents"))


def shares(rows: DataFrame) -> DataFrame:
    """(doc_id, chars, shared_chars, share) of documents (doc_id, text)."""
    found, members = shared_spans(rows, compact=False)
    # all places at one occurrence hold its node, so their union is one stretch
    places = found.select(F.explode(F.array(*(F.struct(F.col(n).alias("cid"), F.col(f"pos_{n}").alias("pos"), "before", "after") for n in "ab"))).alias("p")).select("p.*")
    places = materialize(places.groupBy("cid", "pos").agg(F.max("before").alias("before"), F.max("after").alias("after")), "p10-places")
    concerned = shuffled_join(rows, places.select(F.col("cid").alias("doc_id")).distinct(), "doc_id", "left_semi")
    again = shuffled_join(twins(concerned, "doc_id", "text").withColumnRenamed("doc_id", "cid"), places, ["cid", "pos"]).select("cid", F.col("at").alias("pos"), "before", "after")
    places = places.select("cid", "pos", "before", "after").unionByName(again).select("cid", (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + K + F.col("after")).alias("e"))
    # places of one record, merged: bounded by its length
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "e"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["e"]).alias("upto")),
        lambda acc: acc["n"],
    )
    covered = places.groupBy("cid").agg(merged.alias("n"))
    n = F.coalesce(F.length("text"), F.lit(0))
    out = shuffled_join(rows.select("doc_id", n.alias("chars")), members, "doc_id", "left").withColumn("has_copy", F.col("cid").isNotNull())
    out = shuffled_join(out.withColumn("cid", F.coalesce("cid", "doc_id")), covered, "cid", "left")
    shared = F.when(F.col("has_copy"), F.col("chars")).otherwise(F.coalesce("n", F.lit(0)))
    return out.select("doc_id", "chars", shared.alias("shared_chars"), F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(0.0).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_share": p10_share}

ORACLE_SQL = {
    "p10_found": f"""WITH w AS (SELECT DISTINCT doc_id, hash(substr(text, i, {SPAN})) AS h
        FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN} + 2)) AS i FROM documents WHERE length(text) >= {SPAN})),
      r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), v AS (SELECT w.* FROM w SEMI JOIN r USING (h))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_share": f"""WITH w AS (SELECT doc_id, i, hash(substr(text, i, {SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN} + 2)) AS i FROM documents WHERE length(text) >= {SPAN})),
      r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), v AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM w SEMI JOIN r USING (h)),
      c AS (SELECT doc_id, sum(least({SPAN}, coalesce(j - i, {SPAN}))) AS n FROM v GROUP BY 1)
      SELECT doc_id, CAST(coalesce(length(text), 0) AS INT) AS chars, CAST(coalesce(n, 0) AS INT) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) * 1.0 / length(text) ELSE 0.0 END AS share
      FROM documents LEFT JOIN c USING (doc_id)""",
}
