"""Audit of a whole feature run: every step and every split, in one job.

Each step is one grouped aggregation over all of its columns, and the steps are branches of one plan: a row per task,
split and step is all that is shuffled, and Spark prunes each branch to what the step's columns need.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import literal, long_table, numeric_columns, quoted
from .quality import ZERO_ALARM_PERCENT, step_name

WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8,
    "timestamp": 8, "timestamp_ntz": 8,
}


def _audit(df: DataFrame, by: str, aside: set[str], step_no: int, step: str) -> DataFrame:
    numbers, kinds = set(numeric_columns(df)), dict(df.dtypes)
    aggs, entries = [F.count(F.lit(1)).alias("n rows")], []
    for k, c in enumerate(c for c in df.columns if c not in aside):
        x, null, zero, size = quoted(c), *(quoted(f"{what} {c}") for what in ("null", "zero", "size"))
        measured = f"count(1) * {WIDTHS[kinds[c]]}" if kinds[c] in WIDTHS else f"coalesce(sum(octet_length(string({x}))), 0)"
        aggs += [F.expr(f"count_if({x} IS NULL) AS {null}"), F.expr(f"bigint({measured}) AS {size}")]
        aggs.append(F.expr(f"{f'count_if({x} = 0)' if c in numbers else '0L'} AS {zero}"))
        entries.append(
            {
                "data": "`split of row`", "step_no": str(step_no), "step": literal(step), "column_no": str(k),
                "column_name": literal(c), "row_count": "`n rows`", "missing": null, "zeros": zero, "bytes": size,
                "zero_percent": f"100D * {zero} / `n rows`", "missing_flag": f"{null} > 0",
                "zero_flag": f"100D * {zero} / `n rows` > {ZERO_ALARM_PERCENT}",
            }
        )
    return long_table(df.groupBy(F.col(quoted(by)).alias("split of row")).agg(*aggs), entries)


def audit_run(df: DataFrame, model: PipelineModel, by: str = "split", carried: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Every column as given and after every step of a fitted pipeline, per split.

    ``data, step_no, step, column_no, column_name, row_count, missing, zeros, bytes, zero_percent, missing_flag,
    zero_flag``. ``by`` names the split of a row (null is a split too); ``carried`` columns go along untouched and are
    not audited. Bytes are logical: fixed by type, measured for text. A table without rows gives no row.
    """
    aside, current = {by, *carried}, df
    out = _audit(df, by, aside, 0, "input")
    for i, stage in enumerate(model.stages):
        current = stage.transform(current)
        out = out.unionByName(_audit(current, by, aside, i + 1, f"{i + 1} {step_name(stage)}"))
    return out


def run_summary(df: DataFrame, model: PipelineModel, target: str, by: str = "split", carried: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """One row per split: rows, columns and bytes as given and as processed, what was removed, the steps in order.

    ``raw_rows`` and ``raw_columns`` are of the whole table, target included; the target travels with the rows
    and is no feature. One job of two branches.
    """
    aside = {by, target, *carried}
    audit = _audit(df, by, aside, 0, "given").unionByName(_audit(model.transform(df), by, aside, 1, "processed"))
    last = 1
    first_step, last_step = F.col("step_no") == 0, F.col("step_no") == last
    per = audit.groupBy("data").agg(
        F.max(F.when(first_step, F.col("row_count"))).alias("split_rows"),
        F.sum(F.when(first_step, F.col("bytes"))).alias("split_bytes"),
        F.max(F.when(last_step, F.col("row_count"))).alias("processed_rows"),
        F.count(F.when(last_step, F.lit(1))).alias("processed_columns"),
        F.sum(F.when(last_step, F.col("bytes"))).alias("processed_bytes"),
    )
    dropped = model.stages[0].values["columns"] if model.stages and step_name(model.stages[0]) == "ColumnDropper" else []
    removed = [c for c in dropped if c in df.columns and c not in (by, target, *carried)]
    return per.select(
        F.col("data").alias(by),
        F.lit(target).alias("target"),
        F.lit(len(df.columns) - len({by, *carried} & set(df.columns))).alias("raw_columns"),
        "split_rows", "split_bytes", "processed_rows", "processed_columns", "processed_bytes",
        F.lit(",".join(removed)).alias("removed"),
        F.lit(",".join(map(step_name, model.stages))).alias("steps"),
    )
