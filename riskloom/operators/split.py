"""Splits, folds and samples keyed by row: the same row is always on the same side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import keyed_bucket, keyed_hash
from .columns import quoted
from .profile import describe_by
from .quantiles import order_statistics

# Seed and shares of the reproducible splits.
SEED = 42
TEST_PERCENT = 20
FOLDS = 5


def with_split(df: DataFrame, key: str = "row_id", percent: int = TEST_PERCENT, seed: int = SEED, names=("train", "test"), column: str = "split") -> DataFrame:
    """Marks each row; a projection, with no shuffle and no dependence on partitions."""
    held_out = keyed_bucket(F.col(quoted(key)), seed, 100) < percent
    return df.withColumn(column, F.when(held_out, names[1]).otherwise(names[0]))


def train_test(df: DataFrame, key: str = "row_id", percent: int = TEST_PERCENT, seed: int = SEED):
    marked = with_split(df, key, percent, seed)
    return tuple(marked.filter(F.col("split") == side).drop("split") for side in ("train", "test"))


def with_nested_split(df: DataFrame, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """train, validation and test; the validation rows are drawn from train with a second salt."""
    outer = with_split(df, key, seed=seed)
    inner = keyed_bucket(F.col(quoted(key)), f"{seed}-validation", 100) < TEST_PERCENT
    return outer.withColumn("split", F.when((F.col("split") == "train") & inner, "validation").otherwise(F.col("split")))


def with_folds(df: DataFrame, key: str = "row_id", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", keyed_bucket(F.col(quoted(key)), f"{seed}-fold", folds).cast("int"))


def sample_rows(df: DataFrame, n: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all of a smaller table.

    Keeps the rows up to the n-th smallest key hash. That limit is found by counting, so no
    row is sorted or moved however large ``n`` is.
    """
    marked = df.withColumn("draw", keyed_hash(F.col(quoted(key)), f"{seed}-sample", 13).cast("double"))
    rows = marked.count()
    if n >= rows:
        return df
    limit = order_statistics(marked, {"draw": [n - 1]}, {"draw": rows})["draw", n - 1]
    below = marked.filter(F.col("draw") < limit).count()
    # Hashes below 2^52 are exact as doubles; rows that share the last one are taken in key order.
    last = marked.filter(F.col("draw") == limit).orderBy(key).limit(n - below)
    return marked.filter(F.col("draw") < limit).unionByName(last).drop("draw")


def sample_share(df: DataFrame, percent: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    return df.filter(keyed_bucket(F.col(quoted(key)), f"{seed}-share", 100) < percent)


def concat_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def concat_columns(features: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Puts labels next to their features by key, never by position."""
    return features.join(labels, key)


def split_stats(df: DataFrame, target: str, values=("train", "test"), by: str = "split") -> DataFrame:
    """Describes the target in each split, from one scan."""
    return describe_by(df, by, list(values), target)
