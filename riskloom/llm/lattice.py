"""Embedding near-duplicates: random projections decoded to E8 lattice points, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed, query, table
from .components import connected_components

THRESHOLD = 0.98
# Tables, E8 points to a cell, lattice points per unit of length, neighbours probed per table. At
# cosine 0.98 a table finds about nine of ten links, so eight miss about one in 10^8.
TABLES, BLOCKS, SCALE, PROBES = 8, 2, 1.4, 4
# Vectors of one cell compared in one task; a larger cell is cut into pairs of parts.
CELL = 4096
_ROWS = 512


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    at = np.arange(len(x))
    worst = np.abs(off).argmax(axis=1)
    odd = near.sum(axis=1) % 2 != 0
    near[at[odd], worst[odd]] += np.where(off[at[odd], worst[odd]] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the even whole points and those moved by one half in every coordinate."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out.extend(np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0)
    return np.array(out)


@lru_cache
def _projection(dim: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, at])
    width = 8 * BLOCKS
    if dim >= width:
        axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :width] * np.sqrt(dim / 8)
    else:
        axes = rng.normal(size=(dim, width)) / np.sqrt(8)
    mix = rng.integers(1, 2**62, width, dtype=np.int64) | 1
    return axes * SCALE, rng.uniform(-1, 1, width), mix


def cells(unit: np.ndarray) -> np.ndarray:
    """(n, TABLES, 1 + PROBES) cell names of unit vectors: the home cell of each table, then its probes."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    each = PROBES // BLOCKS
    for t in range(TABLES):
        axes, shift, mix = _projection(unit.shape[1], t)
        x = unit @ axes + shift
        points = np.concatenate([decode_e8(x[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
        name = ((2 * points).astype(np.int64) * mix).sum(axis=1)
        out[:, t, 0] = name
        for b in range(BLOCKS):
            part = slice(8 * b, 8 * b + 8)
            # The neighbours nearest to x are those along the rest of x.
            toward = (x[:, part] - points[:, part]) @ neighbours().T
            best = np.argsort(-toward, axis=1, kind="stable")[:, :each]
            steps = ((2 * neighbours()).astype(np.int64) * mix[part]).sum(axis=1)
            out[:, t, 1 + b * each : 1 + (b + 1) * each] = name[:, None] + steps[best]
    return out


def _units(vectors: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors, without overflow."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _met(home: np.ndarray, probes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In one table: same home; j looks into i's home; i looks into j's home."""
    return home[i] == home[j], (probes[j] == home[i][:, None]).any(axis=1), (probes[i] == home[j][:, None]).any(axis=1)


def _first_meeting(names: np.ndarray, t: int, cell: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this cell is the first in which the pairs meet; every pair has just one such cell."""
    new = np.ones(len(i), bool)
    for before in range(t):
        at = np.flatnonzero(new)
        same, a, b = _met(names[:, before, 0], names[:, before, 1:], i[at], j[at])
        new[at[same | a | b]] = False
    same, a, b = _met(names[:, t, 0], names[:, t, 1:], i, j)
    other = np.where(names[i, t, 0] == cell, names[j, t, 0], names[i, t, 0])
    return new & (same | ~(a & b) | (cell < other))


def cell_links(unit, names, weight, part, home, t: int, cell: int, lo: int, hi: int, threshold: float):
    """Of the vectors of one cell: the weight of those each links with and meets here first, and links that join them.

    At most one link per vector is given out; the pairs themselves are never listed.
    """
    n = len(unit)
    count, near = np.zeros(n, np.int64), np.zeros((n, n), bool)
    for at in range(0, n, _ROWS):
        rows = slice(at, min(at + _ROWS, n))
        hit = unit[rows] @ unit.T >= threshold
        hit &= home[rows, None] | home[None, :]
        if lo != hi:
            hit &= part[rows, None] != part[None, :]
        hit &= np.arange(rows.start, rows.stop)[:, None] != np.arange(n)[None, :]
        near[rows] = hit
        i, j = np.nonzero(hit)
        for some in range(0, len(i), 1 << 20):
            a, b = i[some : some + (1 << 20)] + at, j[some : some + (1 << 20)]
            first = _first_meeting(names, t, cell, a, b)
            count += np.bincount(a[first], weight[b[first]], n).astype(np.int64)
    near |= near.T  # a product may round differently from its mirror image
    links, rest = [], np.ones(n, bool)
    for root in range(n):
        if not rest[root]:
            continue
        rest[root], frontier = False, np.array([root])
        while len(frontier):
            reached = np.flatnonzero(near[frontier].any(axis=0) & rest)
            rest[reached] = False
            links.extend((root, int(k)) for k in reached)
            frontier = reached
    return count, links


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the name of their class, and one row per class of equal vectors under one label."""
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("x", lambda v: v != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long"), "label", x.alias("x"))
    rows = rows.select("*", F.coalesce(sound, F.lit(False)).alias("sound"))
    # Two hashes name a class of equal vectors; the vector itself is part of the grouping key.
    named = rows.select("vec_id", "label", "sound", "x", F.xxhash64("x").alias("k1"), F.xxhash64(F.reverse("x")).alias("k2"))
    classes = named.where("sound").groupBy("label", "k1", "k2", "x").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight")
    )
    return named.drop("x"), classes.withColumn("dim", F.size("x"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors(vec_id, embedding, label)``.

    Links join rows of one label (not null) and one length with cosine >= threshold in double
    precision; every link given is verified. Rows whose id or label is null, or whose vector is
    null, empty, zero, or holds null or non-finite numbers, link with nothing (a null id is its
    own, null, component and kept). Equal vectors are one class, counted, never paired. Repeated
    rows are vectors of their own, linked with each other; an id with several vectors is one node
    of the components. An empty table gives an empty result; other columns are ignored.

    Tuned for thresholds of 0.98 and above; lower ones need a smaller SCALE.
    """
    named, classes = _classes(vectors)
    classes = landed(classes, "vector-classes")
    key = ["label", "dim", "t", "cell"]
    name = ["low", "k1", "k2"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                n, width = rows.num_rows, 1 + PROBES
                names = cells(_units(rows.column("x")))
                back = pa.array(np.repeat(np.arange(n), TABLES * width))
                kept = [rows.column(c).take(back) for c in ("label", "dim", *name)]
                t = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), width), n)
                home = np.tile(np.arange(width) == 0, n * TABLES)
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(t), pa.array(names.reshape(-1)), pa.array(home)],
                    ["label", "dim", *name, "t", "cell", "home"],
                )

    kind = dict(classes.dtypes)["label"]
    schema = f"label {kind}, dim int, low long, k1 long, k2 long, t int, cell long, home boolean"
    placed = landed(classes.select("label", "dim", *name, "x").mapInArrow(place, schema), "lattice-cells")
    alive = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any"))
    alive = alive.where("n > 1 AND any").select(*key, F.ceil(F.col("n") / (cell // 2)).cast("int").alias("k"))
    parts = F.when(F.col("k") <= 2, 1).otherwise(F.col("k"))
    rows = placed.join(alive.select(*key, parts.alias("parts")), key)
    part = F.pmod(F.xxhash64(*name), F.col("parts")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda d: F.struct(F.least(part, d).alias("lo"), F.greatest(part, d).alias("hi")),
    )
    rows = rows.select(*key, *name, "home", part.alias("part"), F.inline(pair))
    rows = rows.join(classes.select("label", *name, "x", "weight"), ["label", *name])
    group = [*key, "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last cell of a batch may go on in the next
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            whole = (whole if held is None else pa.concat_tables([held, whole])).combine_chunks()
            change = np.zeros(max(whole.num_rows - 1, 0), bool)
            for c in group:
                values = whole[c].to_numpy()
                change |= values[1:] != values[:-1]
            starts = np.append(0, np.flatnonzero(change) + 1)
            if len(starts) > 1:
                yield cells_of(whole.slice(0, starts[-1]), starts)
            held = whole.slice(starts[-1]) if whole.num_rows else held
        if held is not None and held.num_rows:
            yield cells_of(held, np.array([0, held.num_rows]))

    def cells_of(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        """All links of whole cells; their vectors are decoded together, by length."""
        column = {c: rows[c].to_numpy(zero_copy_only=False) for c in (*group, "weight", "part", "home", *name)}
        home, units, named = column["home"].astype(bool), {}, {}
        for dim in np.unique(column["dim"]):
            at = np.flatnonzero(column["dim"] == dim)
            units[dim] = _units(rows["x"].combine_chunks().take(pa.array(at)))
            named[dim] = (cells(units[dim]), np.searchsorted(at, np.arange(rows.num_rows)))
        some, counts, firsts, others = [], [], [], []
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            if end - start < 2:
                continue
            names, place = named[column["dim"][start]]
            part = slice(place[start], place[start] + end - start)
            count, links = cell_links(
                units[column["dim"][start]][part], names[part], column["weight"][start:end], column["part"][start:end],
                home[start:end], *(int(column[c][start]) for c in ("t", "cell", "lo", "hi")), threshold,
            )
            found = np.flatnonzero(count)
            some.append(found + start)
            counts.append(count[found])
            firsts.extend(start + x for x, _ in links)
            others.extend(start + y for _, y in links)
        a = np.concatenate([*some, np.array(firsts, np.int64)]).astype(np.int64)
        b = np.concatenate([np.full(len(a) - len(others), -1), np.array(others, np.int64)]).astype(np.int64)
        n = np.concatenate([*counts, np.zeros(len(others), np.int64)]).astype(np.int64)
        other = pa.array(column["low"][b], pa.int64(), mask=b < 0)
        label = rows["label"].combine_chunks().take(pa.array(a))
        return pa.RecordBatch.from_arrays(
            [label, *[pa.array(column[c][a]) for c in name], other, pa.array(n)], ["label", *name, "other", "n"]
        )

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    schema = f"label {kind}, low long, k1 long, k2 long, other long, n long"
    found = landed(dealt.mapInArrow(verify, schema), "vector-links")
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("low").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("label", "k1", "k2").agg(F.sum("n").alias("n"))
    result = (
        classes.select("label", "k1", "k2", "low", "weight")
        .join(counts, ["label", "k1", "k2"], "left")
        .join(roots.withColumnRenamed("node", "low"), "low", "left")
        .select(
            "label", "k1", "k2",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "low").alias("root"),
        )
    )
    whole = named.where("sound").join(result, ["label", "k1", "k2"])
    whole = whole.select("vec_id", "n_links", F.col("root").alias("component_id"))
    none = named.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL
        AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(i, j) AS (SELECT i, j FROM links UNION SELECT reach.i, links.j FROM reach JOIN links ON reach.j = links.i),
low AS (SELECT i, min(j) AS j FROM reach GROUP BY i),
n AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.j, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.j, vec_id)) AS kept
FROM v LEFT JOIN n ON n.i = vec_id LEFT JOIN low ON low.i = vec_id
"""


@query("op1_embedding_near_dedup", SQL)
def op1(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
