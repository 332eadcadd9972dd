"""Data-quality operators: null and zero audits, imputation, consistency, sanity checks."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import profile
from .columns import literal, long_table, numeric_columns, quoted
from .quantiles import exact_quantiles

ZERO_ALARM_PERCENT = 10  # fixed value: share of zeros that raises a flag


def column_audit(df: DataFrame, step: str | None = None) -> DataFrame:
    """Nulls and zeros of every column, from one aggregation.

    ``missing_flag`` and ``zero_flag`` are independent of each other.
    """
    numbers = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("n rows")]
    for c in df.columns:
        aggs.append(F.expr(f"count_if({quoted(c)} IS NULL) AS {quoted('null ' + c)}"))
        if c in numbers:
            aggs.append(F.expr(f"count_if({quoted(c)} = 0) AS {quoted('zero ' + c)}"))
    entries = []
    for c in df.columns:
        nulls, zeros = quoted("null " + c), quoted("zero " + c) if c in numbers else "0L"
        percent = f"IF(`n rows` = 0, 0D, 100D * {zeros} / `n rows`)"
        entry = {"step": literal(step)} if step else {}
        entries.append(
            entry
            | {
                "column_name": literal(c),
                "missing": nulls,
                "zeros": zeros,
                "zero_percent": percent,
                "missing_flag": f"{nulls} > 0",
                "zero_flag": f"{percent} > {ZERO_ALARM_PERCENT}",
            }
        )
    return long_table(df.agg(*aggs), entries)


def null_counts(df: DataFrame, only_present: bool = True) -> DataFrame:
    out = column_audit(df).select("column_name", "missing")
    return out.filter("missing > 0") if only_present else out


def step_name(stage: Transformer) -> str:
    return type(stage).__name__.removesuffix("Model")


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties.

    Counts are combined before the shuffle, so a value held by a third of the rows is one
    row per task; the winner is a second partial aggregation.
    """
    out = {}
    for c in columns:
        counts = df.select(F.col(quoted(c)).alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        out[c] = counts.agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).first()["v"]
    return out


def impute_values(df: DataFrame, exclude: tuple[str, ...] = ("row_id",)) -> dict[str, object]:
    """Median of every numeric column holding nulls, mode of every other one."""
    held = {r["column_name"] for r in null_counts(df).collect()} - set(exclude)  # at most one row per column
    numbers = [c for c in numeric_columns(df) if c in held]
    medians = {c: q[0] for c, q in exact_quantiles(df, numbers, [0.5]).items()}
    return medians | modes(df, [c for c in df.columns if c in held and c not in numbers])


def impute(df: DataFrame, values: dict[str, object] | None = None, exclude: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Fills nulls in place; learned values can be passed in so that they come from training data."""
    learned = impute_values(df, exclude) if values is None else values
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def fill(c: str) -> Column:
        # A median of whole numbers may lie between two of them.
        real = isinstance(kinds[c], T.IntegralType) and isinstance(learned[c], float)
        held = F.col(quoted(c)).cast("double") if real else F.col(quoted(c))
        return F.coalesce(held, F.lit(learned[c])).alias(c)

    return df.select(*[fill(c) if learned.get(c) is not None else F.col(quoted(c)) for c in df.columns])


def label_consistency(features: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Counts of both sides and of keys that lack a partner, from one full join of the keys."""
    left = features.groupBy(key).agg(F.count(F.lit(1)).alias("feature_rows"))
    right = labels.groupBy(key).agg(F.count(F.lit(1)).alias("label_rows"))
    return (
        left.join(right, key, "full")
        .na.fill(0)
        .agg(
            F.sum("feature_rows").alias("feature_rows"),
            F.sum("label_rows").alias("label_rows"),
            F.count_if(F.col("label_rows") == 0).alias("features_without_label"),
            F.count_if(F.col("feature_rows") == 0).alias("labels_without_features"),
        )
        .withColumn("consistent", F.expr("features_without_label = 0 AND labels_without_features = 0"))
    )


def check_bundle(features: DataFrame, labels: DataFrame, key: str = "row_id") -> None:
    found = label_consistency(features, labels, key).first()
    if found["feature_rows"] != found["label_rows"] or not found["consistent"]:
        raise ValueError(f"features and labels do not match: {found.asDict()}")


def prediction_sanity(df: DataFrame, column: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Are there predictions, are they not all alike, and do they stay in range."""
    p = F.col(quoted(column))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(p).alias("scored"),
        F.min(p).alias("lowest"),
        F.max(p).alias("highest"),
        F.count_if((p < low) | (p > high)).alias("out_of_range"),
    ).selectExpr("*", f"scored = row_count AND lowest < highest AND out_of_range = 0 AS sane")


def target_check(df: DataFrame, target: str) -> DataFrame:
    """Describes a numeric target, or gives the shares of its values."""

    if target not in df.columns:
        raise ValueError(f"target {target} is not among {df.columns}")
    if target in numeric_columns(df):
        return profile.describe(df, [target])
    return profile.value_counts(df, target, normalize=True)
