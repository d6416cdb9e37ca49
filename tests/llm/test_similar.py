import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pagewright.llm import grams, history, segments, shared, sigtree

VOCAB = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(texts, threshold=0.6, least=20):
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t in texts.items() if len(w := words(t)) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= threshold}


def corpus(seed, n=60):
    random.seed(seed)
    out, k = {}, 0
    for _ in range(n):
        base = [random.choice(VOCAB) for _ in range(random.choice([10, 25, 60, 150]))]
        out[k] = " ".join(base)
        k += 1
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            v = list(base)
            for _ in range(random.randint(0, max(1, len(v) // 20))):
                v[random.randrange(len(v))] = random.choice(VOCAB).upper()
            out[k] = ", ".join(v) if random.random() < 0.3 else " ".join(v)
            k += 1
    out[k], out[k + 1], out[k + 2] = None, "", "é " * 30
    return out


def frame(spark, texts):
    rows = [(k, t, "clash", k % 4, None) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_idx long, content string, cid string, batch_no int, url string")


def everywhere(monkeypatch, **values):
    """Set constants of the modules; tasks see them because their functions are pickled with the values read inside the driver."""
    for name, v in values.items():
        for m in (sigtree, segments):
            if hasattr(m, name):
                monkeypatch.setattr(m, name, v)


@pytest.mark.parametrize("seed,node", [(1, 1024), (2, 2)])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, node):
    monkeypatch.setattr(sigtree, "NODE", node)  # 2: the top of the trees is cut into nodes that meet by a join
    texts = corpus(seed)
    pairs, members = sigtree.similar(frame(spark, texts))
    got = {(r.a, r.b) for r in sigtree.expanded(pairs, members, "doc_idx").collect()}
    assert got == brute(texts)


def test_third_of_rows_alike(spark):
    random.seed(9)
    base = [random.choice(VOCAB) for _ in range(80)]
    texts = {}
    for k in range(90):
        if k % 3 == 0:
            v = list(base)
            v[k % 80] = f"x{k}"
            texts[k] = " ".join(v)
        else:
            texts[k] = " ".join(random.choice(VOCAB) for _ in range(60))
    pairs, members = sigtree.similar(frame(spark, texts))
    got = {(r.a, r.b) for r in sigtree.expanded(pairs, members, "doc_idx").collect()}
    assert got == brute(texts) and len(got) == 30 * 29 // 2


def family(seed, size, edits, length=200):
    """Separately edited copies of one text, and the matrix of their similarities: every edit is a word of its own."""
    rng = np.random.default_rng(seed)
    texts, kept = {}, np.ones((size, length - 2), np.float32)
    for k in range(size):
        v = [f"b{i}" for i in range(length)]
        for i in rng.choice(length, edits, replace=False):
            v[i] = f"e{k}x{i}"
            kept[k, max(0, i - 2) : i + 1] = 0
        texts[k] = " ".join(v)
    both = kept @ kept.T
    return texts, both / (2 * (length - 2) - both)


def test_large_family_of_edited_copies(spark):
    texts, sim = family(1, 2500, 11)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sim >= 0.6)) if a < b}
    assert len(want) > 5000
    pairs, members = sigtree.similar(frame(spark, texts))
    assert {(r.a, r.b) for r in sigtree.expanded(pairs, members, "doc_idx").collect()} == want


def test_nothing_similar(spark):
    for texts in ({}, {1: None, 2: ""}, {1: "a b c"}):
        pairs, members = sigtree.similar(frame(spark, texts))
        assert pairs.count() == 0 == members.count()


def test_long_text(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    texts = {1: long, 2: long + " end", 3: "short " * 30}
    pairs, members = sigtree.similar(frame(spark, texts))
    assert {(r.a, r.b) for r in sigtree.expanded(pairs, members, "doc_idx").collect()} == {(1, 2)}


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (11, 12), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.group for r in sigtree.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, **{i: 10 for i in (10, 11, 12)}, **{100 + i: 100 for i in range(41)}}


def test_grams_of_odd_texts():
    import pyarrow as pa

    texts = ["", None, "one", "ÀB c_d\n1٣x", "İstanbul DERE ß", "日本語 テキスト です", "a\x00b c d", "🙂 x y z"]
    g, doc, n = grams.word_grams(pa.array(texts), 3)
    for i, t in enumerate(texts):
        w = words(t)
        if t != "İstanbul DERE ß":
            assert n[i] == len(w) and (doc == i).sum() == len(set(zip(w, w[1:], w[2:])))


def brute_known(rows):
    sets = {d: set(zip(w, w[1:], w[2:])) for d, _, t, _ in rows if len(w := words(t)) >= 20}
    out = set()
    for d, u, t, b in rows:
        for d2, u2, t2, b2 in rows:
            if b2 < b and ((u and u == u2) or (d in sets and d2 in sets and jaccard(sets[d], sets[d2]) >= 0.6)):
                out.add(d)
    return out


def batches(seed):
    random.seed(seed)
    texts = corpus(seed, 40)
    return [(k, random.choice([None, f"https://a.example/{k % 25}"]), t, random.randint(0, 3)) for k, t in texts.items()]


@pytest.mark.parametrize("seed", [4, 5])
def test_known_rows(spark, seed):
    rows = batches(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_idx long, url string, content string, batch_no int, first string")
    assert {r.doc_idx for r in history.known_rows(df).collect()} == brute_known(rows)


def test_index_is_reopened_for_every_batch(spark, tmp_path):
    rows = batches(6)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_idx long, url string, content string, batch_no int, cid string, n int")
    path, got = f"file://{tmp_path}/index", set()
    for b in range(4):
        index = history.SegmentIndex.open(spark, path)  # nothing but the folder is carried on
        got |= {r.doc_idx for r in index.accept(df.filter(f"batch_no = {b}"), b, df).collect()}
    assert got == brute_known(rows)
    assert history.SegmentIndex.open(spark, path).batches() == {b: sum(r[3] == b for r in rows) for b in range(4)}
    with pytest.raises(ValueError):
        history.SegmentIndex.open(spark, path).accept(df.limit(1), 3, df)
    # a batch that stopped before it was finished leaves files without a row in `batches`: they don't count
    segs = spark.read.parquet(f"{path}/segments")
    segs.withColumn("batch", segs.batch + 10).write.mode("append").partitionBy("batch").parquet(f"{path}/segments")
    assert history.SegmentIndex.open(spark, path).accept(df.limit(0), 9, df).count() == 0


def test_segments_packed_and_unpacked():
    import pyarrow as pa

    for ids in ([5], [1, 2, 300], [0, 2**40, 2**62], [7, 7, 7], list(range(0, 70000, 3))):
        assert segments.decode_ids(segments.encode_ids(np.array(ids, np.int64))).tolist() == ids
    m = np.arange(12, dtype=np.uint32).reshape(3, 4)
    assert (segments.matrix(segments._binaries(m), np.uint32) == m).all()
    assert segments.matrix(pa.array([], pa.binary()), np.uint8).shape[0] == 0


def test_edits_between_sketches():
    assert sigtree.most_edits(0.6) == 242 and sigtree.most_edits(0.0) == 448 and sigtree.most_edits(0.6, segments.Shape(64, 3)) == 118


def test_traversal_equals_all_pairs():
    rng = np.random.default_rng(3)
    recs = np.zeros(300, segments.RECORD)
    base = rng.integers(0, 2**63, (20, segments.WORDS), dtype=np.uint64) & rng.integers(0, 2**63, (20, segments.WORDS), dtype=np.uint64)
    recs["cid"] = rng.permutation(300)
    recs["bits"] = base[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 63, (300, segments.WORDS)).astype(np.uint64))
    recs["n"] = np.bitwise_count(recs["bits"]).sum(axis=1) + rng.integers(0, 9, 300)
    recs["near"] = rng.integers(0, 20, 300)
    i, j = np.triu_indices(300, 1)
    fit = sigtree._records_fit(recs[i], recs[j], 0.6)
    want = {frozenset(p) for p in zip(recs["cid"][i[fit]].tolist(), recs["cid"][j[fit]].tolist())}
    seen = np.zeros(5, np.int64)
    x, y = sigtree.traverse(recs, None, 0.6, seen)
    assert {frozenset(p) for p in zip(x.tolist(), y.tolist())} == want
    assert seen[1] + seen[2] > 0 and seen[3] < len(i)
    x, y = sigtree.traverse(recs[:130], recs[130:], 0.6, seen)
    assert {frozenset(p) for p in zip(x.tolist(), y.tolist())} == {p for p in want if len(p & set(recs["cid"][:130].tolist())) == 1}


@pytest.mark.parametrize("many", [512, 8])
def test_later_rows_of_a_large_family(spark, monkeypatch, many):
    monkeypatch.setattr(history, "MANY", many)  # 8: large segments meet share by share
    texts, sim = family(2, 2400, 12)
    old = 1200
    want = {int(k) for k in old + np.flatnonzero((sim[old:, :old] >= 0.6).any(1))}
    assert 300 < len(want) < 500
    df = spark.createDataFrame([(k, None, t, int(k >= old)) for k, t in texts.items()], "doc_idx long, url string, content string, batch_no int")
    assert {r.doc_idx for r in history.known_rows(df).collect()} == want


def test_addresses(spark):
    same = ["https://A.example/x/?b=1&a=2&utm_source=q", "https://www.a.example:443/x/index.html?a=2&b=1&REF=z#top", "https://a.example/x?a=2&b=1"]
    other = ["http://a.example/x?a=2&b=1", "https://a.example/X?a=2&b=1", "https://a.example/x?a=2", None, "", "  "]
    df = spark.createDataFrame([(u,) for u in same + other], "url string")
    keys = [r.k for r in df.select(history.address_key(df.url).alias("k")).collect()]
    assert len(set(keys[:3])) == 1 and keys[0] not in keys[3:] and keys[6:] == [None] * 3


def brute_shared(texts, span):
    sets = {k: {t[i : i + span] for i in range(len(t) - span + 1)} for k, t in texts.items() if t}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}


def spanned(seed, n=40, alphabet="abcdefghij é日\n"):
    random.seed(seed)
    pieces = ["".join(random.choice(alphabet) for _ in range(random.choice([190, 199, 200, 201, 230, 420]))) for _ in range(12)]
    out = {}
    for k in range(n):
        noise = lambda: "".join(random.choice(alphabet) for _ in range(random.randint(0, 120)))
        out[k] = noise() + "".join(random.choice(pieces) + noise() for _ in range(random.randint(0, 3)))
    out[n], out[n + 1], out[n + 2], out[n + 3] = None, "", "a" * 900, "b" + "a" * 350
    out[n + 4] = out[3]
    return out


@pytest.mark.parametrize("seed,direct,compact", [(1, 64, True), (2, 1, True), (3, 64, False)])
def test_shared_spans(spark, monkeypatch, seed, direct, compact):
    monkeypatch.setattr(shared, "DIRECT", direct)  # 1: all nodes by windows
    texts = spanned(seed)
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, node int")
    found, members = shared.shared_spans(df, compact=compact)
    m = {r.doc_id: r.cid for r in members.collect()}
    classes = {}
    for k in texts:
        classes.setdefault(m.get(k, k), []).append(k)
    got = set()
    for r in found.collect():
        assert texts[r.a][r.pos_a - r.before : r.pos_a + shared.K + r.after] == texts[r.b][r.pos_b - r.before : r.pos_b + shared.K + r.after]
        got |= {(min(x, y), max(x, y)) for x in classes[r.a] for y in classes[r.b]}
    for v in classes.values():
        if texts[v[0]] and len(texts[v[0]]) >= 200:
            got |= set(combinations(sorted(v), 2))
    assert got == brute_shared(texts, 200)


def test_share_counts_every_repeat(spark):
    texts = spanned(5, 25)
    random.seed(6)
    long = "".join(random.choice("abcdefgh ") for _ in range(3000))
    texts |= {100: long + "--" + long + long[:700], 101: "x" + long, 102: "ab" * 900, 103: "y" + "ab" * 400 + "zz" + "ab" * 300}
    windows = {k: {t[i : i + 200] for i in range(len(t) - 199)} for k, t in texts.items() if t}
    held = Counter(w for v in windows.values() for w in v)
    want = {}
    for k, t in texts.items():
        covered = {i + d for i in range(len(t or "") - 199) if held[t[i : i + 200]] > 1 for d in range(200)}
        want[k] = (len(t or ""), len(covered))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.chars, r.shared_chars) for r in shared.shares(df).collect()} == want


def test_shared_of_nothing(spark):
    for rows in ([], [(1, None), (2, "short")]):
        found, members = shared.shared_spans(spark.createDataFrame(rows, "doc_id long, text string"))
        assert found.count() == 0 == members.count()


def test_key_filter(spark):
    from pagewright.llm import keyfilter

    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    bits = keyfilter.bits_for(len(keys))
    held = keyfilter.filter_of(spark.createDataFrame([(int(k),) for k in keys], "root long"), bits)
    assert keyfilter.may_hold(held, keys, bits).all()
    assert keyfilter.may_hold(held, np.random.default_rng(2).integers(-(2**62), 2**62, 100_000), bits).mean() < 0.01
    assert not keyfilter.may_hold(keyfilter.filter_of(spark.createDataFrame([], "root long"), 16), keys, 16).any()


def test_growing_sides_are_not_broadcast(spark):
    """Spark takes a table for as large as its compressed files; the tables of p10 that grow must not end in the driver for that."""
    random.seed(3)
    same = " ".join(random.choice(VOCAB) for _ in range(90))
    texts = [" ".join(random.choice(VOCAB) for _ in range(9)) + same for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, _ = shared.shared_spans(df)
    assert found.count() >= len(texts) * (len(texts) - 1) // 2
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    big, small = spark.range(1000).selectExpr("id", "id * 7 AS x"), spark.range(500)
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = shared.salted_join(big, small, ["id"], how, "x")
        assert joined.count() == {"inner": 500, "left": 1000, "left_semi": 500, "left_anti": 500}[how]
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_draws_stay_in_small_blocks(monkeypatch):
    import tracemalloc

    r = np.random.default_rng(5)
    counts = r.integers(1, 4000, 1000)
    doc, g = np.repeat(np.arange(1000), counts), grams.mix(np.arange(counts.sum(), dtype=np.uint64)) >> np.uint64(20)
    shape = segments.Shape(4, 2)
    tracemalloc.start()
    got = segments.draw(g, doc, shape)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < g.nbytes, "no array of all n-grams is made for the draws"
    start = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for j in range(shape.symbols):
        least = grams.mix(np.minimum.reduceat(g * segments._SEEDS[j], start))
        assert np.array_equal(got[1][:, j], (least >> np.uint64(8)).astype(np.uint8))
    for block in (16, 1000, 1 << 30):
        monkeypatch.setattr(segments, "DRAWN", block)
        assert all(np.array_equal(a, b) for a, b in zip(got, segments.draw(g, doc, shape)))
    assert [len(x) for x in segments.draw(g[:0], doc[:0], shape)] == [0, 0, 0]
