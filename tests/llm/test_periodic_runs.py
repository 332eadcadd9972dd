"""Periodic runs against every lag at every place."""

import hashlib
import random
import zlib

from riskloom.llm import periodic

SF10 = "/root/testdata/sf0.01"


def plain(words):
    """Every maximal stretch of every lag, in order of the lag; the first to name a stretch has its period."""
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                spans.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in spans.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        words = rng.choices("abcde"[: rng.choice([1, 2, 3, 5])], k=rng.randint(0, 60))
        if rng.random() < 0.7:
            part = rng.choices("abcde", k=rng.randint(1, 6))
            at = rng.randint(0, len(words))
            words[at:at] = (part * 20)[: rng.randint(4, 40)]
        words = [w.encode() for w in words]
        assert periodic.runs_of(words) == plain(words), words


def test_rare_words_split_until_nothing_changes():
    # "x" is rare in the whole; then "a" is rare in each part.
    words = [b"a", b"b", b"b"] * 2 + [b"x"] + [b"a", b"b", b"b"] * 2
    codes = periodic.np.unique(words, return_inverse=True)[1]
    assert list(periodic.segments(codes)) == []
    assert periodic.runs_of([b"a", b"b"] * 4) == [(0, 8, 2)]
    assert periodic.runs_of([b"a", b"b"] * 3) == [] and periodic.runs_of([b"a"] * 6) == [(0, 6, 1)]


def test_runs_of_very_long_texts():
    words = [b"w%d" % (k % 7) for k in range(70_000)] + [b"end"] + [b"z"] * 60_000
    assert periodic.runs_of(words) == [(0, 70_000, 7), (70_001, 60_000, 1)]


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a a a a a a"), (None, "b b b b b b b"), (5, "é x é x " * 9), (5, "x y"), (5, "x y"),
    (6, "one\x0btwo\x0cone two one\rtwo one two"), (7, "a b " * 3), (8, "p q r " * 30_000),
]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(*r, 1, "n") for r in ODD], "doc_id long, text string, runs int, period string")
    found = periodic.periodic_runs(rows).collect()
    assert len(found) == len(ODD)
    small = [r for r in ODD if r[0] != 8]
    key = lambda r: str(r)
    want = sorted(((i, plain((t or "").encode().split())) for i, t in small), key=key)
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in found if r.doc_id != 8), key=key) == want
    assert [(tuple(r.runs[0]), len(r.runs), r.collapsed) for r in found if r.doc_id == 8] == [((0, 90_000, 3), 1, "p q r")]
    assert periodic.periodic_runs(rows.limit(0)).count() == 0


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "text")
    short = docs.where("length(text) < 1500")
    odd = spark.createDataFrame([r for r in ODD if r[0] != 8], docs.schema)
    short.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op12(spark, str(tmp_path)).collect()), key=str)
    want = sorted((plain_row(r.doc_id, r.text) for r in short.union(odd).collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in want) > 20
