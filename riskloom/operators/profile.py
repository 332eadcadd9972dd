"""Column profiles: summaries, shares, associations, histograms, outliers, duplicates."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .columns import literal, long_table, numeric_columns, quoted
from .quantiles import BUCKETS, ordered_buckets, ordered_edges, exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def _numbers(df: DataFrame, columns: list[str] | None) -> list[str]:
    return numeric_columns(df) if columns is None else columns


def doubles(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """The columns as doubles, NaN taken as missing."""
    return df.select(*keep, *[F.expr(f"nanvl(double({quoted(c)}), NULL)").alias(c) for c in columns])


STATS_AT_ONCE = 48  # aggregates per pass; generated code grows with them


def _collect_stats(df: DataFrame, columns: list[str], stats: dict[str, str]) -> dict[str, dict[str, float]]:
    """All statistics of all columns: columns x stats values.

    Some columns per aggregation; each pass reads only its own columns, so none is read twice.
    """
    out, step = {}, max(1, STATS_AT_ONCE // len(stats))
    for start in range(0, len(columns), step):
        part = columns[start : start + step]
        row = df.selectExpr(
            *[f"{sql.format(quoted(c))} AS {quoted(f'{i} {name}')}" for i, c in enumerate(part) for name, sql in stats.items()]
        ).first()
        out |= {c: {name: row[f"{i} {name}"] for name in stats} for i, c in enumerate(part)}
    return out


def _stats_table(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """One row per column; counts stay whole, everything else is a double."""
    names = list(next(iter(stats.values())))
    whole = [n for n in names if any(isinstance(s[n], int) and not isinstance(s[n], bool) for s in stats.values())]
    flags = [n for n in names if any(isinstance(s[n], bool) for s in stats.values())]
    kinds = {n: "bigint" if n in whole else "boolean" if n in flags else "double" for n in names}
    schema = "column_name string, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return df.sparkSession.createDataFrame([(c, *s.values()) for c, s in stats.items()], schema)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of numeric columns."""
    names = _numbers(df, columns)
    data = doubles(df, names)
    stats = _collect_stats(
        data, names, {"count": "count({0})", "mean": "avg({0})", "std": "stddev_samp({0})", "min": "min({0})", "max": "max({0})"}
    )
    quartiles = exact_quantiles(data, names, QUARTILES, counts={c: s["count"] for c, s in stats.items()})
    for c in names:
        stats[c] |= dict(zip(("p25", "p50", "p75"), quartiles[c]))
    return _stats_table(df, stats)


def describe_by(df: DataFrame, by: str, values: list[str], column: str) -> DataFrame:
    """``describe`` of one column for a few known groups, such as train and test."""
    wide = df.select(*[F.when(F.col(by) == v, F.col(quoted(column))).alias(v) for v in values])
    return describe(wide, values).withColumnRenamed("column_name", by)


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Rows per non-null value, or their shares."""
    counts = df.select(F.col(quoted(column)).cast("string").alias("value")).dropna().groupBy("value").agg(
        F.count(F.lit(1)).alias("count")
    )
    if not normalize:
        return counts
    total = counts.agg(F.sum("count").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("value", (F.col("count") / F.col("total")).alias("share"))


def target_correlation(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric column with the target, in one aggregation."""
    names = [c for c in _numbers(df, columns) if c != target]
    totals = doubles(df, [*names, target]).agg(*[F.corr(quoted(c), quoted(target)).alias(c) for c in names])
    return long_table(totals, [{"column_name": literal(c), "correlation": quoted(c)} for c in names])


PAIRS_AT_ONCE = 40  # pairs per aggregation; generated code grows with them


def pearson_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every pair (each pair once), rows with a missing side left out.

    Columns without missing values share one matrix computation. Pairs with a gappy side
    are aggregated some at a time. The result holds one row per pair of columns.
    """
    names = _numbers(df, columns)
    data = doubles(df, names)
    gaps = _collect_stats(data, names, {"missing": "count_if({0} IS NULL)", "count": "count({0})"})
    whole = [c for c in names if not gaps[c]["missing"] and gaps[c]["count"] > 1]
    found = {}
    if len(whole) > 1:
        vectors = VectorAssembler(inputCols=whole, outputCol="all columns").transform(data.select(*map(quoted, whole)))
        matrix = Correlation.corr(vectors.select("all columns"), "all columns").first()[0].toArray()  # columns x columns
        found = {(a, b): float(matrix[whole.index(a), whole.index(b)]) for a, b in combinations(whole, 2)}
    rest = [p for p in combinations(names, 2) if p not in found]
    for start in range(0, len(rest), PAIRS_AT_ONCE):
        part = rest[start : start + PAIRS_AT_ONCE]
        row = data.selectExpr(*[f"corr({quoted(a)}, {quoted(b)}) AS c{i}" for i, (a, b) in enumerate(part)]).first()
        found |= {pair: row[i] for i, pair in enumerate(part)}
    rows = [(a, b, None if v is None or math.isnan(v) else v) for (a, b), v in found.items()]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def _stacked(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep..., column_name, value) of the non-null cells, values as doubles."""
    return doubles(df, columns, *keep).unpivot(list(keep), columns, "column_name", "value").dropna(subset=["value"])


def column_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, rank, n): average rank of every distinct value of every column, and the rows that hold it.

    Cells are folded to distinct values before anything is ordered; ordered buckets are
    ranked in parallel and shifted by the bucket totals, at most 2 x BUCKETS per column.
    """
    data = doubles(df, columns)
    edges = ordered_edges(data, columns)
    found = Bucketizer(
        splitsArray=[edges[c] for c in columns], inputCols=columns, outputCols=[f"{c} bucket" for c in columns],
        handleInvalid="keep",
    ).transform(data)
    cells = ", ".join(
        f"named_struct('column_name', {literal(c)}, 'bucket', int({quoted(c + ' bucket')}), 'value', {quoted(c)})" for c in columns
    )
    counts = (
        found.selectExpr(f"inline(array({cells}))")
        .dropna(subset=["value"])
        .groupBy("column_name", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    before = Window.partitionBy("column_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("column_name", "bucket")
        .agg(F.sum("n").alias("held"))
        .select("column_name", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("column_name", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["column_name", "bucket"])
        .select("column_name", "value", (F.col("offset") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"), "n")
    )


FEW = 10_000  # distinct values whose ranks every task may hold


def _ranked(data: DataFrame, column: str, ranks: DataFrame, distinct: int, rows: int) -> DataFrame:
    """``data`` with the values of a column replaced by their ranks.

    The ranks of few values are broadcast. Of many, those held by more than a BUCKETS-th of all rows are, and rows
    with such a value are dealt by a hash of the row: no task gets all rows of a frequent value.
    """
    found, often, spread = "rank of value", "rank of frequent value", "spread"
    known = ranks.where(F.col("column_name") == column).select(F.col("value").alias("known value"), F.col("rank").alias(found), "n")
    value, others = F.col(quoted(column)), [quoted(c) for c in data.columns if c != column]
    if distinct <= FEW:
        looked_up = data.join(F.broadcast(known.drop("n")), value == F.col("known value"), "left")
        return looked_up.select(*others, F.col(found).alias(column))
    top = known.where(F.col("n") > rows / BUCKETS).select(F.col("known value").alias("top value"), F.col(found).alias(often))
    marked = data.join(F.broadcast(top), value == F.col("top value"), "left").drop("top value")  # at most BUCKETS values
    elsewhere = F.xxhash64(*[quoted(c) for c in data.columns]).bitwiseOR(F.lit(1))
    marked = marked.withColumn(spread, F.when(F.col(often).isNotNull(), elsewhere).otherwise(F.lit(0).cast("long")))
    at = (value == F.col("known value")) & (F.col(spread) == F.col("no spread"))
    looked_up = marked.join(known.drop("n").withColumn("no spread", F.lit(0).cast("long")), at, "left")
    return looked_up.select(*others, F.coalesce(often, found).alias(column))


def _whole_spearman(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rank correlations over rows that hold all the columns; rows of one key count once."""
    whole = df.select(key, *[quoted(c) for c in columns]).dropna(subset=[quoted(c) for c in columns])
    ranks = settle(column_ranks(whole, columns), "ranks")
    held = {r["column_name"]: r for r in ranks.groupBy("column_name").agg(F.count("n").alias("distinct"), F.sum("n").alias("rows")).collect()}
    data = doubles(whole, columns, key)
    for c in columns:
        data = _ranked(data, c, ranks, held[c]["distinct"] if c in held else 0, held[c]["rows"] if c in held else 0)
    once = data.groupBy(key).agg(*[F.first(quoted(c)).alias(c) for c in columns])
    return pearson_matrix(settle(once.select(*[quoted(c) for c in columns]), "ranks"), columns)


def spearman_matrix(df: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """Rank correlation of every pair over the rows that hold both sides.

    Columns without missing values are ranked once and share one matrix. A pair with a gappy side is
    ranked among its own rows. Ranks are looked up column by column and written once, as the matrix passes over them.
    """
    gaps = _collect_stats(doubles(df, columns), columns, {"missing": "count_if({0} IS NULL)"})
    whole = [c for c in columns if not gaps[c]["missing"]]
    parts = [_whole_spearman(df, whole, key)] if len(whole) > 1 else []
    for a, b in combinations(columns, 2):
        if a not in whole or b not in whole:
            parts.append(_whole_spearman(df, [a, b], key))
    if not parts:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    return reduce(DataFrame.unionByName, parts)


def bin_expr(column: str, low: float, high: float, bins: int) -> str:
    """Equal-width bin from 1; the upper edge belongs to the last bin."""
    if low == high:
        return f"IF({quoted(column)} IS NULL, NULL, 1L)"
    return f"least(width_bucket({quoted(column)}, double('{low!r}'), double('{high!r}'), {bins}), {bins})"


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    stats = _collect_stats(df, columns, {"low": "min({0})", "high": "max({0})"})
    return {c: (s["low"], s["high"]) for c, s in stats.items()}


def cramers_v(df: DataFrame, categorical: list[str], numeric: list[str] = (), bins: int = 10) -> DataFrame:
    """Bias-corrected Cramer's V of every pair with a categorical side; numbers are binned.

    Cells of all pairs are counted in one grouping. The tables that follow hold one row per
    pair of levels, whatever the number of rows.
    """
    numeric = list(numeric)
    data = df
    if numeric:
        ranges = column_ranges(doubles(df, numeric), numeric)
        data = df.withColumns({c: F.expr(bin_expr(c, *ranges[c], bins)) for c in numeric})
    pairs = [(a, b) for a, b in combinations([*categorical, *numeric], 2) if a in categorical]
    cells = ", ".join(
        f"named_struct('column_a', {literal(a)}, 'column_b', {literal(b)}, 'la', string({quoted(a)}), 'lb', string({quoted(b)}))"
        for a, b in pairs
    )
    names = ["column_a", "column_b"]
    table = (
        data.selectExpr(f"inline(array({cells}))")
        .filter("la IS NOT NULL AND lb IS NOT NULL")
        .groupBy(*names, "la", "lb")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    side_a = table.groupBy(*names, "la").agg(F.sum("o").alias("ra"))
    side_b = table.groupBy(*names, "lb").agg(F.sum("o").alias("cb"))
    totals = (
        table.join(side_a, [*names, "la"])
        .join(side_b, [*names, "lb"])
        .groupBy(*names)
        .agg(
            F.sum("o").alias("n"),
            F.expr("sum(double(o) * o / (double(ra) * cb))").alias("s"),
            F.countDistinct("la").alias("r"),
            F.countDistinct("lb").alias("k"),
        )
    )
    return (
        totals.withColumn("phi", F.expr("greatest(0D, s - 1 - (k - 1) * (r - 1) / (n - 1))"))
        .withColumn("short_side", F.expr("least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1"))
        .selectExpr(*names, "sqrt(try_divide(phi, short_side)) AS association")
    )


def association_matrix(df: DataFrame, numeric: list[str], categorical: list[str], key: str = "row_id") -> DataFrame:
    """Mixed-type association: rank correlation between numbers, Cramer's V elsewhere."""
    ranks = spearman_matrix(df, numeric, key).selectExpr(
        "column_a", "column_b", "'spearman' AS method", "correlation AS association"
    )
    levels = cramers_v(df, categorical, numeric).selectExpr("column_a", "column_b", "'cramers_v' AS method", "association")
    return ranks.unionByName(levels)


def target_interactions(df: DataFrame, target: str, columns: list[str], bins: int = 10) -> DataFrame:
    """Rows and mean target per (feature bin, target bin) of each feature: the data of a
    scatter plot, at a size that does not grow with the rows."""
    data = doubles(df, [*columns, target])
    ranges = column_ranges(data, [*columns, target])
    cells = ", ".join(
        f"named_struct('column_name', {literal(c)}, 'feature_bin', {bin_expr(c, *ranges[c], bins)})" for c in columns
    )
    return (
        data.select(
            F.col(quoted(target)).alias("t"),
            F.expr(bin_expr(target, *ranges[target], bins)).alias("target_bin"),
            F.expr(f"inline(array({cells}))"),
        )
        .groupBy("column_name", "feature_bin", "target_bin")
        .agg(F.count(F.lit(1)).alias("row_count"), F.avg("t").alias("mean_target"))
    )


PROFILE_STATS = {
    "count": "count({0})",
    "missing": "count_if({0} IS NULL)",
    "zeros": "count_if({0} = 0)",
    "negatives": "count_if({0} < 0)",
    "mean": "avg({0})",
    "std": "stddev_samp({0})",
    "variance": "var_samp({0})",
    "min": "min({0})",
    "max": "max({0})",
    "sum": "sum({0})",
    "g1": "skewness({0})",
    "g2": "kurtosis({0})",
}


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text, n) of all distinct non-null values, combined before the shuffle."""
    text = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], columns, "column_name", "value").dropna(subset=["value"])
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, and values that occur once, per column."""
    return cell_counts(df, columns).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("n") == 1).alias("unique_values")
    )


def monotonic_profile(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Does each column only rise, or only fall, when rows are read in key order. A column
    with a missing value does neither.

    Neighbours are compared inside ordered buckets; the buckets' first and last rows
    (at most 2 x BUCKETS of them) are then compared with each other.
    """
    # Doubles only choose the bucket; rows are ordered by the key itself, so long keys stay apart.
    data = doubles(df, columns, F.col(quoted(key)).cast("double").alias("near key"), F.col(quoted(key)).alias("order key"))
    dealt = ordered_buckets(data, "near key", BUCKETS).drop("alone")
    inside = Window.partitionBy("bucket").orderBy("order key")
    steps = dealt.withColumns({f"{c} before": F.lag(quoted(c)).over(inside) for c in columns})
    step = "{0} - {1}"
    aggs = []
    for c in columns:
        change = step.format(quoted(c), quoted(c + " before"))
        for name, sql in {
            "up": f"coalesce(max({change}), 0D)", "down": f"coalesce(min({change}), 0D)",
            "gaps": f"count_if({quoted(c)} IS NULL)", "first": f"min_by({quoted(c)}, `order key`)", "last": f"max_by({quoted(c)}, `order key`)",
        }.items():
            aggs.append(F.expr(sql).alias(f"{c} {name}"))
    edges = steps.groupBy("bucket").agg(*aggs)
    seams = edges.withColumns({f"{c} seam": F.expr(f"coalesce({quoted(c + ' first')} - lag({quoted(c + ' last')}) OVER (ORDER BY bucket), 0D)") for c in columns})
    totals = seams.agg(
        *[F.expr(f"max(greatest({quoted(c + ' up')}, {quoted(c + ' seam')}))").alias(f"{c} rise") for c in columns],
        *[F.expr(f"min(least({quoted(c + ' down')}, {quoted(c + ' seam')}))").alias(f"{c} fall") for c in columns],
        *[F.sum(quoted(f"{c} gaps")).alias(f"{c} gaps") for c in columns],
    )
    return long_table(
        totals,
        [
            {
                "column_name": literal(c),
                "rising": f"{quoted(c + ' gaps')} = 0 AND {quoted(c + ' fall')} >= 0",
                "falling": f"{quoted(c + ' gaps')} = 0 AND {quoted(c + ' rise')} <= 0",
            }
            for c in columns
        ],
    )


def variable_profile(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Full numeric profile, one row per column: counts, moments, exact quantiles, deviation
    from the median, adjusted skewness and excess kurtosis, distinct values, monotonicity."""
    names = [c for c in _numbers(df, columns) if c != key]
    data = doubles(df, names)
    stats = _collect_stats(data, names, PROFILE_STATS)
    counts = {c: s["count"] for c, s in stats.items()}
    quantiles = exact_quantiles(data, names, [0.05, *QUARTILES, 0.95], counts=counts)
    spread = data.select(
        *[F.expr(f"abs({quoted(c)} - double('{quantiles[c][2]!r}'))").alias(c) for c in names if counts[c]]
    )
    mad = exact_quantiles(spread, [c for c in names if counts[c]], [0.5], counts=counts)
    for c in names:
        s, n = stats[c], counts[c]
        g1, g2 = s.pop("g1"), s.pop("g2")
        varied = g1 is not None and g2 is not None and n > 3
        s["range"] = s["max"] - s["min"] if n else None
        s["cv"] = s["std"] / s["mean"] if n > 1 and s["mean"] else None
        s["skewness"] = g1 * (n * (n - 1)) ** 0.5 / (n - 2) if varied else None
        s["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if varied else None
        s |= dict(zip(("p5", "p25", "p50", "p75", "p95"), quantiles[c]))
        s["iqr"] = s["p75"] - s["p25"] if n else None
        s["mad"] = mad[c][0] if c in mad else None
    return (
        _stats_table(df, stats)
        .join(distinct_profile(df, names), "column_name", "left")
        .join(monotonic_profile(df, names, key), "column_name", "left")
        .na.fill(0, ["distinct_values", "unique_values"])
    )


def frequent_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column, smaller values first on ties.

    Every task keeps k candidates per column before the shuffle (a rank filter), so a column
    of unique values does not end up in one task.
    """
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return cell_counts(df, columns).withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= k)


def extreme_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k smallest and k largest distinct values per column, with their counts."""
    counts = _stacked(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))

    def end(name: str, order) -> DataFrame:
        ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("column_name").orderBy(order)))
        return ranked.filter(F.col("place") <= k).withColumn("side", F.lit(name))

    return end("lowest", F.asc("value")).unionByName(end("highest", F.desc("value")))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of equal rows with their size.

    Rows are first told apart by a 64-bit fingerprint, so the wide comparison, which decides,
    only sees rows whose fingerprint occurs more than once.
    """
    names = columns or df.columns
    marked = df.select(*names).withColumn("fingerprint", F.xxhash64(*names))
    repeated = marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    return (
        marked.join(repeated, "fingerprint", "left_semi")
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one: number and percentage of all rows."""
    groups = duplicate_rows(df, columns).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("groups")
    )
    total = df.agg(F.count(F.lit(1)).alias("row_count"))
    return total.join(F.broadcast(groups)).selectExpr(
        "row_count", "duplicates", "groups", "coalesce(try_divide(100D * duplicates, row_count), 0D) AS duplicate_percent"
    )


# The score histogram's axis and bin choices.
SCORE_AXIS = (0.0, 100.0)
FEWEST_BINS, MOST_BINS, DEFAULT_BINS = 10, 100, 30


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS, low: float = SCORE_AXIS[0], high: float = SCORE_AXIS[1]) -> DataFrame:
    """Rows per equal-width bin, empty bins included.

    Bin 0 holds the values below the axis and bin ``bins + 1`` those above it, each with one open end,
    so the bins count every row that has a value.
    """
    if not FEWEST_BINS <= bins <= MOST_BINS:
        raise ValueError(f"bins must be between {FEWEST_BINS} and {MOST_BINS}")
    value = doubles(df, [column])
    counts = (
        value.filter(F.col(quoted(column)).isNotNull())
        .select(
            F.when(F.col(quoted(column)) < low, 0)
            .when(F.col(quoted(column)) > high, bins + 1)
            .otherwise(F.expr(bin_expr(column, low, high, bins)))
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (high - low) / bins
    frame = df.sparkSession.range(0, bins + 2).selectExpr(
        "id AS bin",
        f"IF(id > 0, {low}D + (id - 1) * {width!r}D, NULL) AS bin_start",
        f"IF(id <= {bins}, {low}D + id * {width!r}D, NULL) AS bin_end",
    )
    return frame.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])


def _fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, 1.5-IQR fences, whiskers (the furthest values inside them), outlier count.

    A column without values has nulls and no outliers.
    """
    q1, q2, q3 = exact_quantiles(df, [column], QUARTILES)[column]
    low, high = _fences(q1, q3)
    c = F.col(quoted(column))
    number = lambda v: F.lit(v).cast("double")
    return doubles(df, [column]).agg(
        number(q1).alias("q1"), number(q2).alias("median"), number(q3).alias("q3"),
        number(low).alias("lower_fence"), number(high).alias("upper_fence"),
        F.min(F.when(c >= low, c)).alias("lower_whisker"),
        F.max(F.when(c <= high, c)).alias("upper_whisker"),
        F.count_if((c < low) | (c > high)).alias("outliers"),
    )


def box_outliers(df: DataFrame, column: str) -> DataFrame:
    """The rows beyond the fences; none without any value."""
    q1, _, q3 = exact_quantiles(df, [column], QUARTILES)[column]
    low, high = _fences(q1, q3)
    c = F.col(quoted(column))
    return df.filter(F.lit(False) if low is None else (c < low) | (c > high))


def flag_outliers(df: DataFrame, columns: list[str], z_limit: float = 3.0, domain: dict[str, tuple] | None = None) -> DataFrame:
    """Adds per column: beyond the IQR fences, beyond ``z_limit`` deviations, out of its domain."""
    data = doubles(df, columns)
    stats = _collect_stats(data, columns, {"count": "count({0})", "mean": "avg({0})", "std": "stddev_samp({0})"})
    quartiles = exact_quantiles(data, columns, [0.25, 0.75], counts={c: s["count"] for c, s in stats.items()})
    flags = {}
    for c in columns:
        if not stats[c]["count"]:
            continue
        v, (q1, q3), s = F.col(quoted(c)), quartiles[c], stats[c]
        flags[f"{c}_iqr_outlier"] = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
        if s["std"]:
            flags[f"{c}_z_outlier"] = F.abs((v - s["mean"]) / s["std"]) > z_limit
        if domain and c in domain:
            low, high = domain[c]
            flags[f"{c}_domain_outlier"] = (v < low) | (v > high)
    return df.withColumns(flags)


def quick_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, exact median and population deviation of a score."""
    median = exact_quantiles(df, [column], [0.5])[column][0]
    return doubles(df, [column]).agg(
        F.avg(quoted(column)).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_pop(quoted(column)).alias("std"),
    )


def result_summary(df: DataFrame, category: str, amount: str, high: str = "High") -> DataFrame:
    """Applicants, those of the high-risk category, and the money asked for."""
    return df.agg(
        F.count(F.lit(1)).alias("applicants"),
        F.count_if(F.col(category) == high).alias("high_risk"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"),
    )
