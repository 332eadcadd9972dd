"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, landed, query, table

# Components become whole numbers of this scale.
SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
# Percent of the positive's score that a negative's score lies between.
LOW, HIGH = 50, 95
# Rows that the sorted lists of one task hold, and anchors that search them: memory bounds only.
LIST_ROWS = 4096
ANCHOR_ROWS = 1024
# Depth of the first look into the lists; each further one goes four times as deep.
FIRST_DEPTH = 64
# Anchors that look into the lists together.
TOGETHER = 128
# Whole numbers that a double holds exactly; larger sums are computed on Python's own.
EXACT = 2**53
LARGEST, LONG = 2.0**52, 2**63 - 1


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """One row of scaled and floored components per vector of ``dim`` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).reshape(len(vectors), dim)


class Lists:
    """The rows of one task in order of id, and for every dimension the order of their values."""

    def __init__(self, values: np.ndarray, labels: np.ndarray, exact: bool):
        self.labels = labels
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        ranked = np.take_along_axis(values, self.order, axis=0)
        self.values, self.ranked = (values, ranked) if exact else (_python(values), _python(ranked))
        n, self.depths = len(values), []
        while not self.depths or self.depths[-1] < n:
            self.depths.append(min(n, FIRST_DEPTH * 4 ** len(self.depths)))

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """Per anchor and depth: no row that all its lists hold below that depth has a higher score.

        Where the anchor's component is positive its list is read from the largest value down, where
        it is negative from the smallest up.
        """
        up, down = np.where(anchors > 0, anchors, 0), np.where(anchors < 0, anchors, 0)
        n = len(self.values)
        return np.stack([up @ self.ranked[n - t] + down @ self.ranked[t - 1] for t in self.depths], axis=1)

    def scan(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sorted access for some anchors, one depth after another: its number and the rows met for the first time.

        A list is read from the top if any of the anchors asks for that, and from the bottom if any does.
        """
        n, seen = len(self.values), np.zeros(len(self.values), bool)
        plus, minus = (np.flatnonzero((side > 0).any(axis=0)) for side in (anchors, -anchors))
        for k, t in enumerate(self.depths):
            met = np.zeros(n, bool)
            met[self.order[n - t :, plus]] = True
            met[self.order[:t, minus]] = True
            if t == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            yield k, new


def _python(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


class Best:
    """The ``most`` highest scores of a window of scores; of equal scores the earlier row is better."""

    def __init__(self, most: int, low=None, high=None):
        self.most, self.low, self.high = most, low, high
        self.empty = low is not None and low > high
        self.at, self.scores = np.zeros(0, np.int64), np.zeros(0)

    @property
    def least(self):
        """No lower score can enter."""
        full = self.scores[-1] if len(self.at) == self.most else -float("inf")
        return full if self.low is None else max(full, self.low)

    def offer(self, at: np.ndarray, scores: np.ndarray) -> None:
        inside = scores >= self.least
        if self.high is not None:
            inside &= scores <= self.high
        if not inside.any():
            return
        at, scores = np.concatenate((self.at, at[inside])), np.concatenate((self.scores, scores[inside]))
        order = np.argsort(at, kind="stable")
        at, scores = at[order], scores[order]
        if len(at) > self.most:
            edge = np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            above = np.flatnonzero(scores > edge)
            order = np.concatenate((above, np.flatnonzero(scores == edge)[: self.most - len(above)]))
            at, scores = at[order], scores[order]
        order = sorted(range(len(at)), key=lambda k: (-scores[k], at[k]))
        self.at, self.scores = at[order], scores[order]

    def settled(self, threshold) -> bool:
        """No row that has not been met can enter the window."""
        if self.low is not None and threshold < self.low:
            return True
        return len(self.at) == self.most and threshold < self.scores[-1]


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest score of a negative next to this positive; empty where the least is greater."""
    return -(-low * positive // 100), high * positive // 100


def _sorted_lists(rows: pa.Table, dim: int, exact: bool, values: np.ndarray) -> tuple[Lists, pa.Table]:
    """The lists of ``rows`` by id (null last) and row, and the rows in that order."""
    order = pa.compute.sort_indices(rows.select(["id", "row"]), [("id", "ascending"), ("row", "ascending")], null_placement="at_end")
    order = order.to_numpy()
    return Lists(values[order], rows["label"].to_numpy()[order], exact), rows.take(order)


def search(anchors: pa.Table, rows: pa.Table, most: int, low: int, high: int) -> Iterator[tuple]:
    """``anchor, positive (or None), found id, found row, score`` of one group of anchors and one of rows.

    Anchors without ``positives`` look for the ``most`` best other rows of their label. Anchors with them look for the
    ``most`` best rows of other labels in the window of each. Vectors of another length never meet.
    """
    negatives = "positives" in anchors.column_names
    dims = [t["vector"].combine_chunks().value_lengths().to_numpy() for t in (anchors, rows)]
    for dim in np.intersect1d(*map(np.unique, dims)).tolist():
        some = [t.filter(pa.array(d == dim)) for t, d in zip((anchors, rows), dims, strict=True)]
        q, v = (whole_numbers(t["vector"].combine_chunks(), dim) for t in some)
        top = np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * max(dim, 1)
        lists, ordered = _sorted_lists(some[1], dim, top < EXACT, v)
        q = q if top < EXACT else _python(q)
        ids, numbers = ordered["id"].to_pylist(), ordered["row"].to_numpy()
        thresholds = lists.thresholds(q)
        labels, own = some[0]["label"].to_numpy(), some[0]["row"].to_numpy()
        wanted = some[0]["positives"].to_pylist() if negatives else [[None]] * len(q)
        for first in range(0, len(q), TOGETHER):
            asking = {
                a: [(p, Best(most, *(window(p["score"], low, high) if p else ()))) for p in wanted[a]]
                for a in range(first, min(first + TOGETHER, len(q)))
            }
            still = {a: [b for _, b in some_ if not b.empty] for a, some_ in asking.items()}
            still = {a: bests for a, bests in still.items() if bests}
            for k, new in lists.scan(q[first : first + TOGETHER]):
                if not still:
                    break
                # Random access: the scores of the rows met, for all anchors that still ask.
                scores = lists.values[new] @ q[list(still)].T
                if scores.dtype == object:
                    scores = np.clip(scores, -LONG, LONG)
                near = lists.labels[new]
                for column, (a, bests) in enumerate(list(still.items())):
                    mine, least = scores[:, column], min(b.least for b in bests)
                    at = np.flatnonzero(mine >= least)
                    match = near[at] == labels[a]
                    at = at[~match] if negatives else at[match & (numbers[new[at]] != own[a])]
                    for best in bests:
                        best.offer(new[at], mine[at])
                    still[a] = [b for b in bests if not b.settled(thresholds[a, k])]
                    if not still[a]:
                        del still[a]
            for a, some_ in asking.items():
                for p, best in some_:
                    for i, score in zip(best.at.tolist(), best.scores.tolist(), strict=True):
                        yield a, some[0], p, ids[i], int(numbers[i]), int(score)


_FOUND = "anchor long, anchor_id long, positive_rank int, positive_id long, positive_score long, id long, row long, score long"


def _searched(anchors: DataFrame, rows: DataFrame, cells: tuple[int, int], most: int, low: int, high: int) -> DataFrame:
    """Every cell of anchors against every cell of rows, one task group each."""
    i, j = cells
    parts = max(1, min(2 * i * j, 20_000))
    number = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", number(i).alias("i"), every(j).alias("j")).repartition(parts, "i", "j")
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own next to those of the anchors
    right = rows.select("*", number(j).alias("j"), every(i).alias("i")).repartition(parts, "i", "j")

    def run(some: pa.Table, lists: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and lists.num_rows:
            for a, table_, p, found, row, score in search(some, lists, most, low, high):
                p = p or {"rank": None, "id": None, "score": None}
                out.append((table_["row"][a].as_py(), table_["id"][a].as_py(), p["rank"], p["id"], p["score"], found, row, score))
        names = [f.split()[0] for f in _FOUND.split(", ")]
        kinds = [pa.int32() if n == "positive_rank" else pa.int64() for n in names]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, _FOUND)


def _first(found: DataFrame, group: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of a table of ``vec_id, embedding, label``.

    Scores are inner products of components scaled by 256 and floored, higher first, then by vec_id (null last). Anchors are
    the rows where ``anchor`` holds. Each anchor's first ``positives`` other rows of its label are its positives;
    for each, the first ``negatives`` rows of other labels with low % to high % of the positive's score are returned.

    Rows with a null label, a null vector or a null or non-finite component take no part. Repeated rows are rows of
    their own. Vectors of another length never meet; empty ones score 0. Components saturate at 2^52 after scaling
    and scores at the bounds of a long. Further columns are ignored; an empty table gives an empty result.

    Rows are dealt to cells by a hash, so no label is ever gathered. Anchors are a stated share of the rows; every cell
    of theirs meets every cell of rows as one group of bounded size, which runs the threshold algorithm:
    only the best of a group leave it.
    """
    spark = bounded(vectors.sparkSession)
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("vector"),
        F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = landed(rows, "vectors")  # fixes the row numbers
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    j = max(1, ceil(n / LIST_ROWS))
    spread = ceil(3 * spark.sparkContext.defaultParallelism / j)  # small tables keep all cores busy too
    cells = (max(1, ceil(m / ANCHOR_ROWS), min(ceil(m / 128), spread)), j)
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    found = _searched(anchors, rows, cells, positives, low, high)
    best = landed(_first(found, ["anchor"], positives), "positives")
    own = best.groupBy("anchor").agg(F.collect_list(F.struct("rank", "id", "score")).alias("positives"))
    asking = anchors.join(own, F.col("row") == F.col("anchor")).drop("anchor")
    found = _searched(asking, rows, cells, negatives, low, high)
    return _first(found, ["anchor", "positive_rank"], negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positive AS (SELECT * FROM pairs WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", SQL)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)
