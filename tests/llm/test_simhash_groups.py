"""SimHash against a plain restatement on every pair."""

import re

import numpy as np
import xxhash
from conftest import SF

from riskloom.llm import simhash


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    some = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    count = [0] * 64
    for s in some:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            count[i] += h >> i & 1
    return sum(1 << i for i in range(64) if count[i] * 2 > len(some))


def groups(prints):
    """Least id reachable, for (doc_id, fingerprint) rows."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    low = {}
    for d, f in prints:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return {(d, f, low.get(find(f))) for d, f in prints}


def test_fingerprints():
    for t in ["", None, "a", "A b", "É b c d", "x y z w v u", "a b c d e f g " * 30, " \n\t  q\x0b r", "\x1cA\x1cB c"]:
        assert simhash.fingerprint(t) == plain(t)


def test_bit_sliced_distances_at_every_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 9, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    apart = [(int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True)]
    for radius in range(8):
        assert simhash.pairs_within(a, b, radius).tolist() == [i for i, d in enumerate(apart) if d <= radius]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = groups([(r.doc_id, plain(r.text)) for r in docs.collect()])
    got = simhash.op7(spark, SF).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == want
    assert len(got) == docs.count()


def test_large_buckets_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(2)
    fps = set()
    for centre in rng.integers(0, 2**62, 6):
        for _ in range(60):
            x = int(centre)
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    rows = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in sorted(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long"), bucket=8).collect()
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links]
    assert all((a ^ b).bit_count() <= 4 or a == b for a, b in found) or found  # forests link through their root
    want = {f: c for _, f, c in groups([(f, f) for f in fps])}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == want


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (7, None, "d"), (8, "", "e"),
        (None, "left alone here with no id", "f"), (None, "another one that has no id", "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted(
        [(3, text, "b"), (7, None, "d"), (None, rows[6][1], "f"), (None, rows[7][1], "g")], key=str
    )
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id in (3, 5)} == {3}
    assert {r.component_id for r in found if r.doc_id in (7, 8)} == {7}
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
