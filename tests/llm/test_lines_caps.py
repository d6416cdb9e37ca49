import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.llm import caps, lines

SCHEMA = "doc_idx long, url string, domain string, content string, confidence double, batch_no int, src string, line_no int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (8 - len(r))) for r in rows], SCHEMA)


def normal(line):
    return " ".join(re.sub(r"\d+", "0", re.sub("<[^>]*>", "", line).lower()).split())


def brute_lines(rows, least):
    seen = defaultdict(set)
    places = []
    for doc, url, domain, content, *_ in rows:
        src = re.sub(r"^www\.", "", re.sub(r":\d*$", "", (domain or "").strip().lower())) or re.sub(r"^www\.", "", re.sub(r":\d*$", "", re.sub(r"^[a-z]+://", "", (url or "").lower()).split("/")[0]))
        for i, x in enumerate((content or "").split("\n"), 1):
            n = normal(x)
            if any(c.isalpha() for c in n):
                seen[src, n].add(doc)
                places.append((doc, i, (src, n)))
    return {(d, i) for d, i, k in places if len(seen[k]) >= least}


def rows_of(n, seed=1):
    random.seed(seed)
    out = []
    for i in range(n):
        # one domain holds a third of the rows
        domain = random.choice(["Hot.example", "www.hot.example:80", "hot.example", f"d{i % 7}.example", None, ""])
        body = [random.choice(["Share  this 12", "<b>share</b> this 9", "© 2024", "---", "", "word " + str(i), "Ünïque\r", "12 34"]) for _ in range(random.randint(0, 6))]
        content = None if i % 29 == 0 else "\n".join(body)
        out.append((i, f"http://www.u{i % 3}.example:8080/x", domain, content, random.choice([None, float("nan"), 1.2, 1.0, 0.5, 0.5, 0.1]), i % 8))
    return out


@pytest.mark.parametrize("least", [2, 8])
def test_repeated_lines(spark, least):
    rows = rows_of(300)
    got = {(r.doc_idx, r.line_no) for r in lines.repeated_lines(frame(spark, rows), least).collect()}
    assert got == brute_lines(rows, least)


def test_lines_of_nothing(spark):
    assert lines.repeated_lines(frame(spark, [])).count() == 0
    assert lines.repeated_lines(frame(spark, [(1, None, None, None), (2, None, None, ""), (3, "", "", "\n\n")]), 1).count() == 0


def test_clean_puts_lines_together(spark):
    rows = frame(spark, [(1, None, "a", "x\nshare\ny"), (2, None, "a", "share"), (3, None, "a", None), (4, None, "b", "share\n")])
    found = lines.repeated_lines(rows, 2).select("doc_idx", "line_no")
    got = {r.doc_idx: r.content for r in lines.without_lines(rows, found).collect()}
    assert got == {1: "x\ny", 2: "", 3: None, 4: "share\n"}


def test_significance(spark):
    rows = [(i, None, "a.example", "only here\neverywhere") for i in range(40)] + [(100 + i, None, f"s{i}.example", "everywhere\nother " + "abcdefgh"[i % 8]) for i in range(200)]
    got = lines.repeated_lines(frame(spark, rows)).groupBy("line_no", "significant").count().collect()
    assert {(r.line_no, r.significant) for r in got} == {(1, True), (2, False)}


def test_tail_probability(spark):
    import math

    for g in (0.0, 0.1, 1.0, 3.84, 20.0, 200.0):
        p = spark.range(1).select(lines.erfc_sqrt_half(F.lit(g))).first()[0]
        assert math.isclose(p, math.erfc(math.sqrt(g / 2)), rel_tol=1e-6)


def brute_cap(rows, limit):
    by = defaultdict(list)
    for doc, url, domain, _, conf, *_ in rows:
        src = re.sub(r"^www\.", "", re.sub(r":\d*$", "", (domain or "").lower())) or re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", url or "").split("/")[0].split(":")[0])
        score = -1.0 if conf is None or conf != conf else min(conf, 1.0)
        by[src].append((-score, doc))
    return {d for v in by.values() for _, d in sorted(v)[limit:]}


@pytest.mark.parametrize("limit", [1, 5])
def test_cap_equals_one_pass(spark, limit):
    rows = rows_of(260, 5)
    state, log = caps.capped(frame(spark, rows), limit)
    got = [r.doc_idx for r in log.collect()]
    assert Counter(got) == Counter(brute_cap(rows, limit))
    assert state.count() + len(got) == len(rows)


def test_cap_log_names_the_batch(spark):
    rows = [(1, None, "a", None, 0.5, 0), (2, None, "a", None, 0.9, 1), (3, None, "a", None, 0.1, 2), (4, None, None, None, None, None)]
    _, log = caps.capped(frame(spark, rows), 1)
    assert {(r.doc_idx, r.batch_no, r.reason) for r in log.collect()} == {(1, 1, "displaced"), (3, 2, "below_cutoff")}


def test_cap_of_nothing(spark):
    state, log = caps.capped(frame(spark, []))
    assert state.count() == 0 == log.count()


def test_state_is_reopened_for_every_batch(spark, tmp_path):
    rows = rows_of(200, 5)
    all_ = caps.ready(frame(spark, rows))
    path = f"file://{tmp_path}/caps"
    for b in range(8):
        caps.CapState.open(spark, path, 3).accept(all_.filter(F.col("batch_no") == b), b)  # nothing but the folder is carried on
    again = caps.CapState.open(spark, path, 3)
    kept = {r.doc_idx for r in again.kept().collect()}
    ranked = defaultdict(list)
    for r in all_.collect():
        ranked[r.source].append((-r.score, r.doc_idx))
    assert kept == {d for v in ranked.values() for _, d in sorted(v)[:3]}
    assert Counter(r.doc_idx for r in again.log().collect()) == Counter(r[0] for r in rows if r[0] not in kept)
    with pytest.raises(ValueError):
        again.accept(all_.limit(1), 7)
    assert caps.CapState.open(spark, f"{path}-new").kept().count() == 0


@pytest.mark.parametrize("share", [0.001, 0.1, 1.0])
def test_shares(spark, share):
    rows = rows_of(200, 6)
    ranked = defaultdict(list)
    for r in caps.ready(frame(spark, rows)).collect():
        ranked[r.source].append((-r.score, r.doc_idx))
    most = max(int(200 * share), 1)
    assert {r.doc_idx for r in caps.over_share(frame(spark, rows), share).collect()} == {d for v in ranked.values() for _, d in sorted(v)[most:]}


def test_shares_of_nothing(spark):
    assert caps.over_share(frame(spark, []), 0.5).count() == 0
    with pytest.raises(ValueError):
        caps.over_share(frame(spark, []), 0)
