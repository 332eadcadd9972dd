"""Exact order statistics and exact global ranks without sorting a table in one place.

``exact_quantiles`` narrows a bracket around each wanted rank. Every pass is one
aggregation with bounded state (counts and quantile sketches), whatever the number of
rows, and each pass shrinks a bracket by the sketch's accuracy. Brackets are checked
with exact counts, so a bad sketch costs a further pass, never a wrong value.

``with_global_rank`` numbers rows over the whole table: rows are dealt to ordered buckets,
ranked inside their bucket, and shifted by the sizes of the buckets before. A value held
by very many rows gets a bucket of its own, split by row key.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted

SMALL = 200_000  # rows in a bracket that one aggregation buffer may hold by value; never changes an answer
ACCURACY = 2_000  # rank error of a sketch is about rows / ACCURACY
BUCKETS = 256
SPLITS = 64  # parts of a bucket that holds one very frequent value


def _lit(x: float) -> str:
    return f"double('{x!r}')"


def _disc(rank: int, rows: int) -> str:
    """SQL share whose discrete percentile is exactly the value at ``rank`` (from 0)."""
    return repr((rank + 0.5) / rows)


def order_statistics(
    df: DataFrame, wanted: dict[str, list[int]], rows: dict[str, int], small: int = SMALL, accuracy: int = ACCURACY
) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank among the non-null values of each column, in ascending order."""
    found: dict[tuple[str, int], float] = {}
    # (column, rank) -> bracket [low, high], rows below it, rows inside it
    state = {(c, r): (None, None, 0, rows[c]) for c, ranks in wanted.items() for r in ranks if rows[c]}
    while state:
        # Ranks that still share a bracket are answered by one aggregate.
        shared: dict[tuple, list[int]] = {}
        for (c, rank), bracket in state.items():
            shared.setdefault((c, bracket), []).append(rank)
        aggs = []
        for i, ((c, (low, high, below, inside)), ranks) in enumerate(shared.items()):
            where = "" if low is None else f" FILTER (WHERE {quoted(c)} BETWEEN {_lit(low)} AND {_lit(high)})"
            value = f"double({quoted(c)})"
            if inside <= small:
                shares = ", ".join(f"{_disc(rank - below, inside)}D" for rank in ranks)
                aggs.append(f"percentile_disc(array({shares})) WITHIN GROUP (ORDER BY {value}){where} AS v{i}")
            else:
                near, margin = [], 2.0 / accuracy
                for rank in ranks:
                    share = (rank - below + 0.5) / inside
                    near += [f"{max(share - margin, 0.0)!r}D", f"{min(share + margin, 1.0)!r}D"]
                aggs.append(f"percentile_approx({value}, array({', '.join(near)}), {accuracy}){where} AS v{i}")
        answer = df.selectExpr(*aggs).first()
        open_brackets = {}
        for i, ((c, (*_, inside)), ranks) in enumerate(shared.items()):
            for j, rank in enumerate(ranks):
                if inside <= small:
                    found[c, rank] = float(answer[f"v{i}"][j])
                else:
                    open_brackets[c, rank] = answer[f"v{i}"][2 * j : 2 * j + 2]
        state = _confirm(df, open_brackets, state, found)
    return found


def _confirm(df: DataFrame, brackets: dict, state: dict, found: dict) -> dict:
    """Counts rows below, inside and on the ends of each proposed bracket, and keeps what is proven.

    The ends are always settled or left out, so a very frequent value cannot hold a bracket open.
    """
    if not brackets:
        return {}
    aggs = []
    for i, ((c, _), (low, high)) in enumerate(brackets.items()):
        value = quoted(c)
        aggs.append(f"count_if({value} < {_lit(low)}) AS below{i}")
        aggs.append(f"count_if({value} BETWEEN {_lit(low)} AND {_lit(high)}) AS inside{i}")
        aggs.append(f"count_if({value} = {_lit(low)}) AS low{i}")
        aggs.append(f"count_if({value} = {_lit(high)}) AS high{i}")
    counts = df.selectExpr(*aggs).first()
    still = {}
    for i, (key, (low, high)) in enumerate(brackets.items()):
        below, inside, at_low, at_high = (counts[f"{name}{i}"] for name in ("below", "inside", "low", "high"))
        old_low, old_high, old_below, old_inside = state[key]
        rank, after_low, before_high = key[1], math.nextafter(low, math.inf), math.nextafter(high, -math.inf)
        if rank < below:  # the sketch overshot: everything from the old start up to just below
            start = -math.inf if old_low is None else old_low
            still[key] = (start, math.nextafter(low, -math.inf), old_below, below - old_below)
        elif rank >= below + inside:  # undershot
            end = math.inf if old_high is None else old_high
            still[key] = (math.nextafter(high, math.inf), end, below + inside, old_below + old_inside - below - inside)
        elif rank < below + at_low:
            found[key] = float(low)
        elif rank >= below + inside - at_high:
            found[key] = float(high)
        else:
            still[key] = (after_low, before_high, below + at_low, inside - at_low - at_high)
    return still


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], small: int = SMALL, accuracy: int = ACCURACY,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, exact at any size by one path. Columns without values give nulls.

    ``counts`` are the non-null counts, if the caller has them already.
    """
    if not columns:
        return {}
    data = df.select(*[F.expr(f"nanvl(double({quoted(c)}), NULL)").alias(c) for c in columns])
    if counts is None:
        counts = data.selectExpr(*[f"count({quoted(c)}) AS {quoted(c)}" for c in columns]).first().asDict()
    counts = {c: counts[c] for c in columns}
    places = {c: [p * (n - 1) for p in probabilities] for c, n in counts.items() if n}
    wanted = {
        c: sorted({r for place in where for r in (math.floor(place), math.ceil(place))}) for c, where in places.items()
    }
    values = order_statistics(data, wanted, counts, small, accuracy)

    def at(c: str, place: float) -> float:
        low, high, part = values[c, math.floor(place)], values[c, math.ceil(place)], place - math.floor(place)
        if not part or low == high:
            return low
        if math.isinf(low) or math.isinf(high):
            return (1 - part) * low + part * high  # between the two infinities there is no value: NaN
        return low + (high - low) * part

    return {c: [at(c, p) for p in places[c]] if c in places else [None] * len(probabilities) for c in columns}


def ordered_edges(df: DataFrame, columns: list[str], buckets: int = BUCKETS) -> dict[str, list[float]]:
    """Bucket edges per column, from one pass of quantile sketches. Every split value is alone
    in its bucket, so a frequent value never shares one."""
    marks = df.approxQuantile(columns, [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    out = {}
    for c, found in zip(columns, marks):
        splits = sorted({s for m in found for s in (m, math.nextafter(m, math.inf)) if math.isfinite(m)})
        # Without any value there is nothing to split; the edge then only keeps the form.
        out[c] = [-math.inf, *(splits or [0.0]), math.inf]
    return out


def ordered_buckets(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bucket``, increasing with ``value``, and ``alone`` where it holds a single value."""
    edges = ordered_edges(df, [value], buckets)[value]
    alone = [i for i in range(len(edges) - 1) if math.nextafter(edges[i], math.inf) == edges[i + 1]]
    dealt = Bucketizer(splits=edges, inputCol=value, outputCol="bucket").transform(df)
    return dealt.withColumn("bucket", F.col("bucket").cast("int")).withColumn("alone", F.col("bucket").isin(alone))


def _bucket_offsets(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Running total before each bucket. At most 2 x buckets x splits rows."""
    totals = df.groupBy(*keys).agg(amount.alias("held"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))


def with_global_rank(df: DataFrame, value: str, key: str, rank: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """Numbers rows 1..n by ``value``; rows with equal values are numbered in some fixed order."""
    held = df.withColumn(value, F.expr(f"nanvl(double({quoted(value)}), NULL)")).dropna(subset=[value])
    dealt = ordered_buckets(held, value, buckets)
    # Ties may be numbered in any order, so a bucket of one value can be split by row key.
    dealt = dealt.withColumn("part", F.when(F.col("alone"), F.pmod(F.xxhash64(key), F.lit(SPLITS))).otherwise(0))
    offsets = _bucket_offsets(dealt, ["bucket", "part"], F.count(F.lit(1)))
    inside = Window.partitionBy("bucket", "part").orderBy(value, key)
    return (
        dealt.withColumn("inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["bucket", "part"])
        .withColumn(rank, F.col("offset") + F.col("inside"))
        .drop("bucket", "alone", "part", "offset", "inside")
    )
