import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import encoding

SAMPLES = ["L’été à Noyon était doux — “très” doux…", "Año 12 en señor café naïve", "Über Größe möchte für", "Привет, это проверка связи", "Manhãs não são lições", "don’t isn’t wasn’t"]


def quantised(total):
    return np.round(8 * np.log2(np.maximum(total, 1) + (total > 0) * 0.1)).astype(np.uint8)


@pytest.fixture(scope="module")
def restorer():
    total, tokens = np.zeros(encoding.SKETCH, np.uint32), Counter()
    for s in [*SAMPLES, "« Çà et là » ¿Quién? · © à là"] * 50:
        tokens.update(encoding._tokens(s))
    encoding.count_into(total, tokens)
    return encoding.Restorer(quantised(total))


def misread(text, name):
    """UTF-8 read as ``name``; bytes without a character come as control characters."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in text.encode("utf-8"))


@pytest.mark.parametrize("name", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850"])
@pytest.mark.parametrize("text", SAMPLES)
def test_round_trip(restorer, name, text):
    bad = misread(text, name)
    assert restorer.damaged(bad)
    assert restorer.restore(bad) == text


def test_twice_misread_and_lost(restorer):
    for t in SAMPLES[:3] + SAMPLES[4:]:
        assert restorer.restore(misread(misread(t, "cp1252"), "cp1252")) == t
    assert restorer.restore("na�ve caf� don�t") == "naïve café don’t"
    assert restorer.damaged("��������") and restorer.restore("��������") == "��������"
    assert restorer.restore("Ïðèâåò ñâÿçè") == "Привет связи"
    assert restorer.restore("cafй naпve") == "café naïve"


@pytest.mark.parametrize("text", SAMPLES + ["CANÇÃO MANHÃS L’ÂGE", "plain ASCII &amp; more", "", None, "ÜBER GRÖSSE", "«Ça» ¿Qué? · © 2020"])
def test_undamaged(restorer, text):
    assert not restorer.damaged(text) and restorer.restore(text) == text


def test_examined(spark):
    rows = [(1, "cafÃ©", "fine", "x"), (2, None, "", "x"), (3, "ok", "â€œYouâ€\x9d said", "x"), (3, "ok", "â€œYouâ€\x9d said", "x")]
    df = spark.createDataFrame(rows, "doc_idx long, title string, content string, field_name string")
    got = sorted((r.doc_idx, r.field_name, r.restored) for r in encoding.examined(df, "doc_idx", ["title", "content"], True).collect())
    assert got == [(1, "title", "café")] + [(3, "content", "“You” said")] * 2
    assert encoding.examined(df.limit(0), "doc_idx", ["title", "content"], True).count() == 0


def values(path, n):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{path}/search_index.parquet", columns=["title", "content"])
    return [v for c in t.column_names for v in t.column(c).to_pylist() if v and not v.isascii()][:n]


def test_planted_damage_is_undone():
    """Damage of every kind planted into undamaged values of the tables: found, and given back."""
    all_values = values("/root/testdata/sf0.01", 100_000)
    total, tokens = np.zeros(encoding.SKETCH, np.uint32), Counter()
    for v in all_values:
        tokens.update(encoding._tokens(v))
    encoding.count_into(total, tokens)
    r = encoding.Restorer(quantised(total))
    clean = [v for v in all_values if not r.damaged(v)]
    rng = random.Random(5)
    rng.shuffle(clean)
    kinds = {
        "cp1252": lambda v: misread(v, "cp1252"), "mac": lambda v: misread(v, "mac_roman"), "cp437": lambda v: misread(v, "cp437"), "twice": lambda v: misread(misread(v, "cp1252"), "cp1252"),
        "dropped": lambda v: "".join(bytes([b]).decode("cp1252", "ignore") for b in v.encode()), "lost": lambda v: v.encode("cp1252").decode("utf-8", "replace"),
    }
    rates = {}
    for name, damage in kinds.items():
        tried = found = back = 0
        for v in clean:
            try:
                bad = damage(v)
            except UnicodeError:
                continue  # not a text of this encoding
            if bad != v and (tried := tried + 1):
                found += r.damaged(bad)
                back += r.restore(bad) == v
            if tried == 150:
                break
        rates[name] = (tried, found / tried, back / tried)
    print({k: (n, round(f, 3), round(b, 3)) for k, (n, f, b) in rates.items()})
    assert all(f >= 0.99 for _, f, _ in rates.values())
    assert all(rates[k][2] >= 0.95 for k in ("cp1252", "mac", "cp437", "twice"))
    assert rates["dropped"][2] >= 0.8 and rates["lost"][2] >= 0.4


def test_letters_and_signs_the_corpus_lacks(restorer):
    for text in ("Południe słońce", "fine 😀 day", "Dzień dobry — źle"):
        bad = misread(text, "cp1252")
        assert restorer.damaged(bad) and restorer.restore(bad) == text
