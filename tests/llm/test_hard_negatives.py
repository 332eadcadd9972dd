"""Hard negatives against all pairs in whole numbers."""

import math
import random

import numpy as np

from riskloom.llm import negatives
from riskloom.llm.negatives import LONG, Best, Lists, hard_negatives


def plain(rows, anchors, most=(5, 3), low=50, high=95):
    """Result rows by comparing every two, with Python's own numbers."""
    sound = [
        (k, i, label, [max(-(2**52), min(2**52, math.floor(256 * np.float64(v)))) for v in x])
        for k, (i, x, label) in enumerate(rows)
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, label, x in sound:
        if i not in anchors:
            continue
        scored = [
            (max(-LONG, min(LONG, sum(a * b for a, b in zip(x, y, strict=True)))), j, other)
            for m, j, other, y in sound
            if m != k and len(x) == len(y)
        ]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for p, j, _ in [r for r in scored if r[2] == label][: most[0]]:
            near = [r for r in scored if r[2] != label and low * p <= 100 * r[0] <= high * p][: most[1]]
            out += [(i, j, n + 1, m, p, s) for n, (s, m, _) in enumerate(near)]
    return sorted(out, key=str)


def mined(spark, rows, anchors, **given):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, score string")
    return sorted(map(tuple, hard_negatives(table, negatives.F.col("vec_id").isin(anchors), **given).collect()), key=str)


def clusters(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.6
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(k, [float(np.float32(v)) for v in x[k]], int(rng.integers(0, 4))) for k in range(n)]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LIST_ROWS", 40)
    rng = random.Random(5)
    rows = clusters(1, 150, 8)
    # Ties, copies, another length, empty vectors, numbers that leave no room in a double or a long.
    rows += [(1000 + k, [0.5, 0.25], k % 2) for k in range(9)] + [(1000, [0.5, 0.25], 0)] * 2
    rows += [(1100 + k, [], k % 2) for k in range(3)]
    rows += [(1200 + k, [rng.choice([3e37, -2.5e30, 7e18, 1.0]) for _ in range(3)], k % 2) for k in range(12)]
    rows += [(1400 + k, [float(rng.randint(1, 10**6)) for _ in range(4)], k % 2) for k in range(20)]
    rows += [(None, [0.5, 0.5], 0), (None, [0.5, 0.3], 1), (1300, None, 1), (1301, [1.0, 2.0], None), (1302, [1.0, None], 1)]
    rows += [(1303, [float("nan"), 1.0], 0), (1304, [float("inf"), 1.0], 0), (1305, [0.0, 0.0], 0), (1306, [0.0, 0.0], 0)]
    anchors = [0, 7, 50, 100, 1000, 1003, 1100, 1200, 1201, 1202, 1301, 1305, 1400, 1401]
    want = plain(rows, anchors)
    assert len(want) > 60 and {0, 1000, 1100, 1305, 1400} <= {r[0] for r in want}
    assert mined(spark, rows, anchors) == want
    assert mined(spark, [], anchors) == []


def test_other_windows(spark):
    rows = clusters(2, 120, 5)
    want = plain(rows, [3, 9, 27], (2, 7), 10, 120)
    assert want and mined(spark, rows, [3, 9, 27], positives=2, negatives=7, low=10, high=120) == want
    assert mined(spark, rows, [999]) == []


def test_sorted_access_stops_early():
    """The scan of skewed values ends long before it has met every row, with the same best ones."""
    rng = np.random.default_rng(4)
    values = np.floor(rng.exponential(30, size=(4000, 3)) ** 1.5)
    lists = Lists(values, np.zeros(4000, np.int64), True)
    for anchor in np.array([[5.0, 9.0, 2.0], [7.0, 1.0, 0.0], [-1.0, 3.0, 2.0]]):
        best, met = Best(5), 0
        bounds = lists.thresholds(anchor[None])[0]
        for k, new in lists.scan(anchor[None]):
            met += len(new)
            best.offer(new, values[new] @ anchor)
            if best.settled(bounds[k]):
                break
        order = sorted(range(4000), key=lambda i: (-(values[i] @ anchor), i))[:5]
        assert best.at.tolist() == order and met < 2500
