import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    t.encode_special_tokens = True
    return bpe.encoder(bpe.tokenizer_path(), bpe.split_pattern()), t


CASES = ["", " ", "\n\n  \n", "Hello  world!", "<|endoftext|> x<|endoftext|>", "don't I'll 's", "naïve café — “q”", "Привет мир", "日本語のテキスト", "🙂🙂 ok", "aaaaaaaaaaaaaaa" * 9, "a b c", "x" * 3000, "1234567 89", "\x00\x01", "tab\tx\r\n"]


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab'sintheor \n", max_size=80))
def test_any_text(both, text):
    assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_null_empty_and_round_trip(spark, both):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (4, "naïve 日本", "x"), (4, "naïve 日本", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encoded(df).orderBy("doc_id").collect()]
    assert got[0] == (1, []) and got[1] == (2, []) and len(got) == 5
    assert both[1].decode(got[2][1]) == "Hello world" and got[3] == got[4]
    assert [r.tokens for r in bpe.token_counts(df).orderBy("doc_id").collect()] == [len(x) for _, x in got]
    assert bpe.encoded(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60), st.lists(st.integers(1, 60), max_size=50))
def test_plan_holds_all_items(capacity, items):
    items = [min(x, capacity) for x in items]
    plan = packing.plan(Counter(items), capacity)
    got = Counter()
    for sizes, n in plan:
        assert sum(sizes) <= capacity and n > 0
        for s in sizes:
            got[s] += n
    assert got == Counter(items)
    assert sum(n for _, n in plan) >= -(-sum(items) // capacity)


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 14), st.lists(st.integers(1, 14), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum(capacity, items):
    items = [min(x, capacity) for x in items]

    def optimum(rest):
        best = [len(rest)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(rest):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + rest[i] <= capacity and bins[j] not in bins[:j]:
                    go(i + 1, [*bins[:j], bins[j] + rest[i], *bins[j + 1 :]])
            go(i + 1, [*bins, rest[i]])

        go(0, [])
        return best[0]

    counts = dict(Counter(items))
    fixed = packing.reduce_dominated(counts, capacity)
    left = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + (optimum(left) if left else 0) == optimum(sorted(items, reverse=True))


def test_packed(spark):
    random.seed(2)
    sizes = [(i, random.choice([0, 1, 7, 7, 7, 30, 99, 100, 101, 250, 1003])) for i in range(400)] + [(1000, None), (7, 7)]
    df = spark.createDataFrame([(k, t, 1) for k, t in sizes], "doc_id long, tokens long, share int")
    rows = packed = packing.packed(df, 100).collect()
    load, seen = Counter(), Counter()
    for r in rows:
        load[r.container_id] += r.tokens
        seen[r.doc_id] += r.tokens
        assert r.start == r.piece_no * 100
    want = Counter()
    for k, t in sizes:
        want[k] += t or 0
    assert max(load.values()) <= 100 and seen == want
    assert {r.doc_id for r in packed if r.piece_no} == {k for k, t in sizes if (t or 0) > 100}
    assert set(range(1, max(load) + 1)) == set(load)
    assert packing.packed(df.limit(0), 100).count() == 0
