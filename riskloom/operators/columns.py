"""Column-set operators: dropping, aligning, classifying and listing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How columns are sorted into classes.
FEW_VALUES = 10  # numeric columns with fewer distinct values are categories
RARE_SHARE = 0.05  # text columns with fewer distinct values than this share of rows are categories

# Estimates (5 % standard error) decide alone only outside this factor around a limit, twenty
# standard errors away; nearer to it the exact count does.
DOUBT = 2.0


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """SQL text of a string, whatever it holds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long_table(totals: DataFrame, entries: list[dict[str, str]]) -> DataFrame:
    """Turns a one-row table into one row per entry; values are SQL over its columns."""
    rows = ", ".join(
        "named_struct(" + ", ".join(f"{literal(name)}, {sql}" for name, sql in entry.items()) + ")" for entry in entries
    )
    return totals.selectExpr(f"inline(array({rows}))")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def keep_expected(df: DataFrame, expected: list[str]) -> DataFrame:
    """Drops columns that are not expected; the order of ``expected`` wins."""
    return df.select(*[quoted(c) for c in expected if c in df.columns])


def align_columns(df: DataFrame, expected: dict[str, object]) -> DataFrame:
    """Exactly the columns of ``expected``, absent ones filled with the given default."""
    return df.select(*[F.col(quoted(c)) if c in df.columns else F.lit(d).alias(c) for c, d in expected.items()])


def prefill_columns(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Adds absent raw columns: numbers as 0.0, categories as empty text."""
    present = set(df.columns)
    absent = {c: F.lit(0.0) for c in numeric if c not in present}
    absent |= {c: F.lit("") for c in categorical if c not in present}
    return df.withColumns(absent) if absent else df


def contract_diff(actual: list[str], expected: list[str]) -> list[tuple[str, str]]:
    """(problem, column) pairs; empty when both hold the same names, in any order."""
    missing = [("missing", c) for c in expected if c not in actual]
    return missing + [("extra", c) for c in actual if c not in expected]


def enforce_contract(df: DataFrame, expected: list[str]) -> DataFrame:
    problems = contract_diff(df.columns, expected)
    if problems:
        raise ValueError(f"{len(df.columns)} columns, expected {len(expected)}: {problems}")
    return df.select(*[quoted(c) for c in expected])


def diff_table(df: DataFrame, expected: list[str]) -> DataFrame:
    """``contract_diff`` as a table (at most as long as the two column lists)."""
    schema = "problem string, column_name string"
    return df.sparkSession.createDataFrame(contract_diff(df.columns, expected), schema)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def columns_of_type(df: DataFrame, *types: type) -> DataFrame:
    return df.select(*[quoted(f.name) for f in df.schema.fields if isinstance(f.dataType, types)])


def schema_table(df: DataFrame) -> DataFrame:
    """Name, position and type of every column: the model-input record."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position bigint, column_name string, column_type string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows by key: each task keeps only its own ``n``."""
    return df.orderBy(key).limit(n)


def split_target(df: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(key, target)


def distinct_counts(df: DataFrame, limits: dict[str, float]) -> dict[str, int]:
    """Distinct non-null values per column, exact wherever the count is near its limit.

    One pass of sketches settles most columns; only doubtful ones are counted exactly,
    one shuffle of distinct values each, instead of expanding every row once per column.
    """
    if not limits:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(quoted(c), 0.05).alias(c) for c in limits]).first().asDict()
    for c, limit in limits.items():
        if limit / DOUBT <= sketch[c] <= limit * DOUBT:
            sketch[c] = df.select(F.col(quoted(c)).alias("v")).dropna().distinct().count()
    return sketch


def classify_columns(df: DataFrame) -> dict[str, str]:
    """Class of every column: ``date``, ``numerical``, ``categorical`` or ``other``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    dated = {
        c
        for c, t in kinds.items()
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
        or (isinstance(t, T.StringType) and "date" in c.lower())
    }
    open_columns = [c for c in kinds if c not in dated]
    numbers = {c for c in open_columns if isinstance(kinds[c], T.NumericType)}
    rows = df.count() if len(numbers) < len(open_columns) else 0
    limits = {c: FEW_VALUES if c in numbers else rows * RARE_SHARE for c in open_columns}
    distinct = distinct_counts(df, limits)

    def decide(c: str) -> str:
        if c in dated:
            return "date"
        if distinct[c] < limits[c]:
            return "categorical"
        return "numerical" if c in numbers else "other"

    return {c: decide(c) for c in df.columns}


def class_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(classify_columns(df).items()), "column_name string, column_class string"
    )


def resolve_score_column(df: DataFrame, candidates=("prediction", "risk_score", "RiskScore")) -> str:
    """The first score column present."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no score column among {df.columns}")


def guard_input(df: DataFrame, expected: list[str]) -> DataFrame:
    """Refuses input that has no row or no expected column, before any heavy work."""
    if not set(df.columns) & set(expected):
        raise ValueError("none of the input columns is expected")
    if df.isEmpty():
        raise ValueError("the input has no rows")
    return df
