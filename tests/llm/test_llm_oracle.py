"""Queries with an SQL twin give the same rows as DuckDB on the smallest data; the others keep what their operators promise."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.llm import registry
from pagewright.plans.runtime import table

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, name):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = Q[name](spark, data)
    rel = c.sql(SQL[name])
    order = [rel.columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_others_are_known():
    assert set(Q) - set(SQL) == {"p1_found", "p1_main_text", "p2_trees", "p6_found", "p6_validation", "p7_found", "p7_restored", "p8_ids", "p9_pack", "p9_fill"}


def test_main_text_is_what_is_not_found(spark, data):
    """Lines that come out as beside the post are real lines, each once; the main texts hold the others."""
    found = Q["p1_found"](spark, data)
    assert found.count() == found.distinct().count() > 1000
    text = {"search_index": ("doc_idx", "content"), "crawled_pages": ("page_id", "html_content")}
    main = {(r.origin, r.rec_id): r.main_text for r in Q["p1_main_text"](spark, data).collect()}
    gone = Counter((r.origin, r.rec_id) for r in found.collect())
    for origin, (key, column) in text.items():
        rows = {r[key]: r[column] for r in table(spark, data, origin).collect()}
        assert {k for o, k in main if o == origin} == {k for k, v in rows.items() if v}
        for k, v in rows.items():
            n = len((v or "").split("\n"))
            assert gone[origin, k] <= n
            if v:
                assert len([x for x in main[origin, k].split("\n") if x]) + gone[origin, k] <= n
    assert all(1 <= r.line_no for r in found.collect())


def test_trees_account_for_every_pair(spark, data):
    r = Q["p2_trees"](spark, data).first()
    assert r.record_pairs >= r.left > 0 and r.node_pairs >= r.by_size + r.by_overlap


def test_residue_pages_exist_and_validation_adds_up(spark, data):
    pages = {r.page_id for r in table(spark, data, "crawled_pages").filter(F.length("html_content") > 0).select("page_id").collect()}
    found = {r.page_id for r in Q["p6_found"](spark, data).collect()}
    assert found and found < pages
    v = Q["p6_validation"](spark, data).collect()
    assert sum(r.pages for r in v) == len(pages) and sum(r.found for r in v) == len(found) and all(r.both <= min(r.found, r.weak) for r in v)


def test_found_values_are_those_restored(spark, data):
    found = {(r.doc_idx, r.field_name) for r in Q["p7_found"](spark, data).collect()}
    restored = {(r.doc_idx, r.field_name): r.restored for r in Q["p7_restored"](spark, data).collect()}
    assert found and found == set(restored)
    values = {r.doc_idx: r for r in table(spark, data, "search_index").select("doc_idx", "title", "content").collect()}
    changed = sum(restored[k] != values[k[0]][k[1]] for k in restored)
    assert changed >= 0.9 * len(restored)


def test_every_document_is_packed_whole(spark, data):
    ids = {r.doc_id: len(r.ids) for r in Q["p8_ids"](spark, data).collect()}
    assert set(ids) == {r.doc_id for r in table(spark, data, "documents").select("doc_id").collect()}
    budgets = {r.budget_id: (r.tokenizer, r.capacity) for r in table(spark, data, "token_budgets").collect()}
    rows = Q["p9_pack"](spark, data).collect()
    for b, (name, capacity) in budgets.items():
        mine = [r for r in rows if r.budget_id == b]
        load, whole, parts = Counter(), Counter(), Counter()
        for r in mine:
            load[r.container_id] += r.tokens
            whole[r.doc_id] += r.tokens
            parts[r.doc_id] += 1
        assert max(load.values()) <= capacity and set(whole) == set(ids)
        assert all(parts[d] == max(1, -(-n // capacity)) for d, n in whole.items())
        if name == "byte_bpe_50k":
            assert whole == Counter(ids)
    fill = {r.budget_id: r for r in Q["p9_fill"](spark, data).collect()}
    assert all(fill[b].containers == max(r.container_id for r in rows if r.budget_id == b) >= fill[b].lower_bound for b in budgets)
