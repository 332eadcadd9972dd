"""Evaluation of predictions: error metrics, residuals, rankings, importance, trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import normal_quantile
from .profile import bin_expr, column_ranges, doubles
from .quantiles import with_global_rank

# Metrics where less is better, and the listing of a good candidate.
LOWER_IS_BETTER = {"rmse": True, "mae": True, "mape": True, "r2": False}
WINS_NEEDED = 2
TOP_FEATURES = 15


def regression_metrics(df: DataFrame, *by: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, MSE, MAE, R2 and MAPE in one aggregation, overall or per group.

    MAPE is a percentage and leaves out zero targets.
    """
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = a - p
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg(error * error).alias("mse"),
            F.avg(F.abs(error)).alias("mae"),
            F.var_pop(a).alias("spread"),
            F.avg(F.when(a != 0, F.abs(error / F.nullif(a, F.lit(0.0))))).alias("relative"),
        )
        .selectExpr(
            *by, "row_count", "sqrt(mse) AS rmse", "mse", "mae", "1 - try_divide(mse, spread) AS r2",
            "100 * relative AS mape",
        )
    )


def fold_summary(df: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation over folds of the metrics of each fold."""
    folds = regression_metrics(df, *by, "fold")
    stats = [
        f(m).alias(f"cv_{kind}_{m}") for m in ("rmse", "mae", "r2") for kind, f in (("mean", F.avg), ("std", F.stddev_pop))
    ]
    return folds.groupBy(*by).agg(*stats)


def with_residual(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def binned_pairs(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Rows and means per (x bin, y bin): the data of a residual or prediction plot."""
    data = doubles(df, [x, y])
    ranges = column_ranges(data, [x, y])
    return (
        data.withColumn("x_bin", F.expr(bin_expr(x, *ranges[x], bins)))
        .withColumn("y_bin", F.expr(bin_expr(y, *ranges[y], bins)))
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("row_count"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    )


def qq_points(df: DataFrame, value: str, key: str = "row_id") -> DataFrame:
    """Every ordered value with its normal quantile (Filliben's positions): (rank, sample, theoretical).

    Ranks are global but found in parallel; no task sees more than its bucket.
    """
    n = df.select(F.count(F.expr(f"nanvl(double(`{value}`), NULL)"))).first()[0]
    ranked = with_global_rank(df.select(key, value), value, key)
    top = 0.5 ** (1.0 / n) if n else 1.0
    position = (
        F.when(F.col("rank") == 1, 1.0 - top)
        .when(F.col("rank") == n, top)
        .otherwise((F.col("rank") - 0.3175) / (n + 0.365))
    )
    return ranked.select("rank", F.col(value).alias("sample"), normal_quantile(position).alias("theoretical"))


def qq_line(points: DataFrame) -> DataFrame:
    """Least-squares line through the points, and their correlation."""
    return points.agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.corr("sample", "theoretical").alias("r"),
    )


# -- comparing models; these tables hold one row per model --


def long_metrics(metrics: DataFrame, model: str = "model") -> DataFrame:
    return metrics.unpivot([model], list(LOWER_IS_BETTER), "metric", "value")


def rank_models(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Rank of every model by every metric, 1 the best, ties sharing the lower rank."""
    smaller = [m for m, low in LOWER_IS_BETTER.items() if low]
    merit = F.when(F.col("metric").isin(smaller), F.col("value")).otherwise(-F.col("value"))
    by_metric = Window.partitionBy("metric").orderBy("merit")
    return long_metrics(metrics, model).withColumn("merit", merit).withColumn("rank", F.rank().over(by_metric)).drop("merit")


def best_models(metrics: DataFrame, model: str = "model") -> DataFrame:
    """The best model per metric, the first name on ties."""
    first = rank_models(metrics, model).filter("rank = 1")
    return first.groupBy("metric").agg(F.min(model).alias("best_model"), F.min("value").alias("value"))


def recommendation(metrics: DataFrame, candidate: str, model: str = "model") -> DataFrame:
    """Is the candidate best by enough metrics to be recommended."""
    wins = best_models(metrics, model).agg(F.count_if(F.col("best_model") == candidate).alias("wins"))
    verdict = F.when(F.col("wins") >= WINS_NEEDED, F.lit(candidate)).otherwise("mixed results")
    return wins.select(F.lit(candidate).alias("candidate"), "wins", verdict.alias("recommendation"))


# -- feature importance; one row per feature --


def top_features(importance: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def importance_checks(importance: DataFrame, critical: list[str], removed: list[str], top: int = 5, slack: float = 1e-3) -> DataFrame:
    """Are importances sound: none negative, sum near 1, critical ones on top, removed ones gone."""
    best = top_features(importance, top).agg(F.collect_set("feature").alias("best"))  # at most ``top`` names
    sums = importance.agg(
        F.min("importance").alias("lowest"),
        F.sum("importance").alias("total"),
        F.count_if(F.col("feature").isin(removed)).alias("removed_present"),
    )
    wanted = F.array(*[F.lit(c) for c in critical])
    return sums.join(F.broadcast(best)).select(
        (F.col("lowest") >= 0).alias("none_negative"),
        (F.abs(F.col("total") - 1) < slack).alias("sums_to_one"),
        (F.size(F.array_except(wanted, "best")) == 0).alias("critical_on_top"),
        (F.col("removed_present") == 0).alias("removed_absent"),
    )


def importance_by_prefix(importance: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean importance of the features that carry one of a group's names, alone or as a prefix."""
    labelled = []
    for group, names in groups.items():
        hit = F.lit(False)
        for name in names:
            hit = hit | (F.col("feature") == name) | F.startswith(F.col("feature"), F.lit(f"{name}_"))
        labelled.append(F.avg(F.when(hit, F.col("importance"))).alias(group))
    wide = importance.agg(*labelled)
    return wide.unpivot([], list(groups), "feature_group", "mean_importance").na.fill(0.0, ["mean_importance"])


# -- trials; one row per fit --


def leaderboard(trials: DataFrame) -> DataFrame:
    """Completed trials per study with the best value and its parameters."""
    done = F.col("state") == "COMPLETE"
    best = F.struct("rmse", "trial_no")
    return trials.groupBy("study").agg(
        F.count_if(done).alias("completed"),
        F.min(F.when(done, F.col("rmse"))).alias("best_rmse"),
        F.min_by("trial_no", F.when(done, best)).alias("best_trial"),
        F.min_by("params", F.when(done, best)).alias("best_params"),
    )


def known_params(params: dict, known: list[str]) -> dict:
    return {k: v for k, v in params.items() if k in known}


def changed_params(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parameters (param, value) that are new or differ; as long as a parameter list."""
    old = before.withColumnRenamed("value", "old_value")
    return (
        after.join(old, "param", "left")
        .filter("NOT (value <=> old_value)")
        .select("param", "old_value", F.col("value").alias("new_value"))
    )
