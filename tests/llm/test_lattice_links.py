"""Embedding near-duplicates against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import lattice
from riskloom.llm.components import connected_components


def plain(rows, threshold=lattice.THRESHOLD):
    """(vec_id, n_links, component_id) of (vec_id, embedding, label) rows, by comparing every two."""

    def sound(r):
        i, x, label = r
        return (
            i is not None and label is not None and x is not None
            and all(v is not None and math.isfinite(v) for v in x) and any(v != 0 for v in x)
        )

    at = [k for k, r in enumerate(rows) if sound(r)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(at):
        for j in at[n + 1 :]:
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if p != q or len(x) != len(y):
                continue
            x, y = np.array(x) / np.linalg.norm(x), np.array(y) / np.linalg.norm(y)
            if x @ y >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return sorted(((r[0], links[k], find(r[0])) for k, r in enumerate(rows)), key=str)


def clusters(seed, dim=64, n=12, size=14, noise=0.015):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for c in range(n):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            x = centre + noise * rng.normal(size=dim)
            rows.append((at, [float(np.float32(v)) for v in x], c % 3))
            at += 1
    return rows


@pytest.mark.parametrize("cell", [lattice.CELL, 8])
def test_all_links_are_found_once(spark, cell):
    rows = clusters(1)
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, 60, 7)]  # equal vectors
    rows += [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [1.0, None], 0), (2003, [float("nan")] * 64, 0),
             (2004, [float("inf")] * 64, 0), (2005, rows[0][1], None), (2006, [], 0), (None, rows[0][1], 0),
             (2007, [1e30] * 64, 0), (2008, [3e30] * 64, 0), (2009, [1.0, 2.0], 0), (2010, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = [(r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(frame, cell=cell).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in lattice.near_vectors(frame).collect())


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.near_vectors(frame).count() == 0


def test_decoding_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 3
    point = lattice.decode_e8(x)
    twice = 2 * point
    assert np.allclose(twice, np.rint(twice)) and (point.sum(axis=1) % 2 == 0).all()
    assert ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all()
    nearest = ((x - point) ** 2).sum(axis=1)
    for v in lattice.neighbours():
        assert (((x - point - v) ** 2).sum(axis=1) >= nearest - 1e-9).all()


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    links += [(300, 300), (None, 1), (7, None), (5, 4), (5, 4)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys(range(200, 203), 200)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
