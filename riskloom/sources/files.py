"""CSV, JSON and Parquet sources and sinks. Every path must be one all executors can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import check_bundle
from ..schema import text_schema

CORRUPT = "_corrupt_record"
# A quote inside a value is doubled, and white space at its ends belongs to it.
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(
    spark: SparkSession, path: str, columns: list[str], target: str | None = None, multiline: bool = False
) -> DataFrame:
    """All-text scan with a declared schema, so the file is read once and never inferred.

    Values are typed later by a contract; empty fields are nulls. A line with too few or too many
    fields stops the scan: ``read_csv_checked`` sorts such lines out instead. Values with line
    breaks need ``multiline``, and then a file is one task; without it files are split.
    """
    if target and target not in columns:
        raise ValueError(f"target {target} is not among {columns}")
    return (
        spark.read.schema(text_schema(columns))
        .options(**QUOTING)
        .option("header", True)
        .option("enforceSchema", False)  # the header must hold these names in this order
        .option("columnPruning", False)  # a line is judged by all its fields
        .option("multiLine", multiline)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_csv_checked(
    spark: SparkSession, path: str, columns: list[str], multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, malformed lines as they stand in the file); together the whole input."""
    lines = (
        spark.read.schema(text_schema([*columns, CORRUPT]))
        .options(**QUOTING)
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    good = lines.filter(F.col(CORRUPT).isNull()).select(*[f"`{c}`" for c in columns])
    # The scan refuses to give the marker alone, so the fields are looked at too.
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in columns])) >= 0
    bad = lines.filter(F.col(CORRUPT).isNotNull() & read).select(CORRUPT, F.lit("malformed").alias("code"))
    return good, bad


def scan_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows, columns and missing cells of a scan, in one aggregation."""
    if target and target not in df.columns:
        raise ValueError(f"target {target} is not among {df.columns}")
    missing = " + ".join(f"int(`{c}` IS NULL)" for c in df.columns)
    return df.selectExpr(f"bigint({missing}) AS missing").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
    )


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the dataset is empty")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted so that every text comes back byte for byte, line breaks with ``multiline`` only."""
    df.write.mode("overwrite").options(**QUOTING).option("header", True).csv(path)


def write_bundle(df: DataFrame, path: str, split: str = "split") -> None:
    """Features and label of all splits as one table, a folder per split: reading one split
    touches only its files. Splits are few and large, so files follow the input partitions."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_bundle(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def read_checked_bundle(spark: SparkSession, path: str, key: str, target: str, split: str | None = None):
    """(features, labels) of a bundle; refuses a bundle with rows on one side only."""
    df = read_bundle(spark, path, split)
    features, labels = df.drop(target), df.select(key, target).dropna(subset=[target])
    check_bundle(features.select(key), labels, key)
    return features, labels


def write_report(report: DataFrame, path: str) -> None:
    """A long report (section, key, value) as JSON lines. Reports are small by nature."""
    report.repartition(1).write.mode("overwrite").json(path)


# A number or a text per line; lines without text leave it out.
REPORT_SCHEMA = "section string, key string, value double, text string"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def metrics_report(metrics: DataFrame, section: str) -> DataFrame:
    """A metrics table as report lines: one per numeric column, keyed by the section column."""
    values = [c for c in metrics.columns if c != section]
    return metrics.select(F.col(section).alias("section"), *[F.col(c).cast("double") for c in values]).unpivot(
        "section", values, "key", "value"
    )
