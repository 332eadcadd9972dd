"""Benchmark windows: hits, documents and spans."""

import re

import pytest

from riskloom.llm import decontaminate as d

ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Short item"),
    (3, None),
    (4, " ... "),
    (None, "no id but nine words are in this one"),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
]


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(text):
    words, hit, items = plain(text), set(), set()
    for item, body in ITEMS:
        w = plain(body)
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if grams else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items |= {item} - {None}
    return len(words), sorted(hit), sorted(items)


TEXTS = [
    (1, "Intro. ALPHA, beta; gamma-delta epsilon zeta eta theta iota kappa lambda mu and more"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota nothing"),
    (3, "a short ITEM, again short item"),
    (4, None), (5, ""), (6, "?!"), (7, "short"), (None, "short item"), (8, "no id but nine words are in this one."),
    (9, "été short item"), (10, "x " * 5000 + "short item " + "y " * 5000), (11, "short item"), (11, "short item"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "h") for i, t in TEXTS], "doc_id long, text string, hit string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_hits(tables):
    got = {(r.doc_id, r.key): r for r in d.find_hits(*tables).collect()}
    assert sum(r.copies for r in got.values()) == len(TEXTS)
    want = {}
    for i, t in TEXTS:
        want.setdefault(i, []).append(expected(t))
    for (i, _), r in got.items():
        assert (r.n_words, sorted(r.hit), sorted(r["items"])) in want[i]


def test_join_without_broadcast_gives_the_same(tables, monkeypatch):
    key = lambda r: (str(r.doc_id), r.key, r.n_words, sorted(r.hit), sorted(r["items"]))
    want = sorted(key(r) for r in d.find_hits(*tables).collect())
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert sorted(key(r) for r in d.find_hits(*tables).collect()) == want


def test_documents_and_spans(spark, tables):
    kept = {r.doc_id for r in d.decontaminate(*tables).collect()}
    assert kept == {2, 4, 5, 6, 7, 9}
    spans = {r.doc_id: r.text for r in d.decontaminate(*tables, mode="spans").collect()}
    assert spans[1] == "Intro and more" and spans[3] == "a, again" and spans[2] == TEXTS[1][1] and spans[4] is None
    assert spans[10] == "x " * 4999 + "x " + "y " * 4999 + "y " or spans[10].split() == ["x"] * 5000 + ["y"] * 5000
    assert d.decontaminate(*tables).columns == tables[0].columns
    with pytest.raises(ValueError):
        d.decontaminate(*tables, mode="all")


def test_empty_tables(tables):
    docs, items = tables
    assert d.find_hits(docs.limit(0), items).count() == 0
    assert d.decontaminate(docs, items.limit(0)).count() == len(TEXTS)
