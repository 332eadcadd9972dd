"""Quality gates and behaviour checks of a scored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted

# Thresholds of the accuracy gate and the order in which a status wins.
R2_MIN = 0.85
RMSE_MAX = 3.0
STATUS_ORDER = ["fail", "warn", "error", "skip", "pass"]
QUICK_STATUS_ORDER = ["error", "warn", "skip", "pass"]
STABLE_DELTA = 1e-4
EPSILON = 1e-6


def accuracy_gate(metrics: DataFrame, r2_min: float = R2_MIN, rmse_max: float = RMSE_MAX) -> DataFrame:
    """pass, fail or (without any scored row) skip, with a message, per row of a metrics table."""
    held = F.expr(f"r2 >= {r2_min} AND rmse <= {rmse_max}")
    status = F.when(F.col("r2").isNull() | F.col("rmse").isNull(), "skip").when(held, "pass").otherwise("fail")
    numbers = F.format_string(f"R2=%.3f (min {r2_min}), RMSE=%.3f (max {rmse_max})", "r2", "rmse")
    message = (
        F.when(F.col("status") == "skip", "no scored rows")
        .when(F.col("status") == "fail", F.concat(F.lit("Model accuracy below threshold: "), numbers))
        .otherwise(numbers)
    )
    return metrics.withColumn("status", status).withColumn("message", message)


def gate_or_error(df: DataFrame, metrics: Callable[[DataFrame], DataFrame], needed: list[str]) -> DataFrame:
    """The gate of ``metrics(df)``; a table without the needed columns gives an error status."""
    absent = [c for c in needed if c not in df.columns]
    if absent:
        return df.sparkSession.createDataFrame([("error", f"missing columns: {absent}")], "status string, message string")
    return accuracy_gate(metrics(df)).select("status", "message")


def overall_status(checks: DataFrame, order: list[str] = STATUS_ORDER, *by: str) -> DataFrame:
    """The status that wins over all checks; skip only stands if nothing but passes is beside it."""
    seen = [F.count_if(F.col("status") == s).alias(s) for s in order]
    others = F.count_if(~F.col("status").isin("skip", "pass")).alias("others")
    found = F.lit("pass")
    for s in reversed(order[:-1]):
        hit = F.col(s) > 0
        found = F.when(hit & (F.col("others") == 0) if s == "skip" else hit, s).otherwise(found)
    return checks.groupBy(*by).agg(*seen, others).select(*by, found.alias("overall_status"))


def sweep(df: DataFrame, field: str, values: list[float], score: Callable[[DataFrame], DataFrame], column: str, key: str = "row_id") -> DataFrame:
    """Scores every row once per value of one field, everything else equal: (key, step, value, column)."""
    kind = dict(df.dtypes)[field]
    cases = F.array(*[F.lit(v).cast(kind) for v in values])
    varied = df.select(*[quoted(c) for c in df.columns if c != field], F.posexplode(cases).alias("step", field))
    return score(varied).select(key, "step", F.col(quoted(field)).alias("value"), column)


def sweep_violations(swept: DataFrame, column: str, rising: bool = True, key: str = "row_id") -> DataFrame:
    """Rows and steps where the score moves against the expected direction.

    The window holds one row's few steps, so its partitions are as even as the key.
    """
    change = F.col(column) - F.lag(column).over(Window.partitionBy(key).orderBy("step"))
    against = change < 0 if rising else change > 0
    return (
        swept.withColumn("against", F.coalesce(against, F.lit(False)))
        .agg(
            F.count(F.lit(1)).alias("scored"),
            F.count_if("against").alias("violations"),
            F.countDistinct("step").alias("steps"),
        )
        .withColumn("monotone", F.col("violations") == 0)
    )


def perturbation(df: DataFrame, fields: list[str], score: Callable[[DataFrame], DataFrame], column: str, epsilon: float = EPSILON, limit: float = STABLE_DELTA) -> DataFrame:
    """Largest change of the score when one field at a time is nudged by ``epsilon``."""
    base = score(df).withColumnRenamed(column, "base score")
    names = F.explode(F.array(*[F.lit(c) for c in fields])).alias("field")
    nudged = base.select("*", names).withColumns(
        {c: F.when(F.col("field") == c, F.col(quoted(c)) + epsilon).otherwise(F.col(quoted(c))) for c in fields}
    )
    change = F.abs(F.col(column) - F.col("base score"))
    return (
        score(nudged)
        .groupBy("field")
        .agg(F.max(change).alias("max_change"), F.count_if(change >= limit).alias("unstable_rows"))
        .withColumn("stable", F.col("unstable_rows") == 0)
    )
