"""Queries of the column-set operators (B)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import columns as ops
from ..schema import RAW_COLUMNS
from ..sources.tables import loans, table
from .catalog import on_loans, query, tidy
from .predictions import MODELS


@query(
    "b1_drop_columns",
    """SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders""",
)
def drop_columns(spark, sf_dir):
    return tidy(ops.drop_columns(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate", "no_such_column"]))


@query(
    "b2_keep_expected",
    on_loans("SELECT Age, CreditScore, count(*) AS loans FROM loans GROUP BY Age, CreditScore"),
)
def keep_expected(spark, sf_dir):
    kept = ops.keep_expected(loans(spark, sf_dir), ["CreditScore", "Age", "not_there"])
    return tidy(kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("loans")))


@query(
    "b3_align_columns",
    """SELECT CAST(0 AS BIGINT) AS bonus, c_nationkey::BIGINT AS c_nationkey, c_custkey, 'none' AS remark FROM customer""",
)
def align_columns(spark, sf_dir):
    expected = {"bonus": 0, "c_nationkey": 0, "c_custkey": 0, "remark": "none"}
    return tidy(ops.align_columns(table(spark, sf_dir, "customer"), expected))


@query(
    "b4_prefill_columns",
    """SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, 0E0 AS income, '' AS region FROM customer""",
)
def prefill_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return tidy(ops.prefill_columns(df, ["c_acctbal", "income"], ["region"]))


_MISSING = ["CreditScore", "Age"]


@query(
    "b5_contract_diff",
    on_loans(
        """SELECT 'missing' AS problem, name AS column_name, n AS input_rows
        FROM (SELECT unnest(['CreditScore', 'Age']) AS name) , (SELECT count(*) AS n FROM loans)
        UNION ALL SELECT 'extra', name, n
        FROM (SELECT unnest(['row_id', 'MaritalStatus', 'LoanApproved', 'RiskScore']) AS name),
             (SELECT count(*) AS n FROM loans)"""
    ),
)
def contract_diff(spark, sf_dir):
    df = loans(spark, sf_dir).drop(*_MISSING)
    size = df.agg(F.count(F.lit(1)).alias("input_rows"))  # one row
    return ops.diff_table(df, RAW_COLUMNS).join(F.broadcast(size))


@query(
    "b5_enforce_contract",
    """SELECT l_linenumber::BIGINT AS l_linenumber, l_orderkey, round(l_tax, 6) AS l_tax FROM lineitem""",
)
def enforce_contract(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_linenumber")
    return tidy(ops.enforce_contract(df, ["l_linenumber", "l_orderkey", "l_tax"]))


def _classes_sql(name: str, columns: dict[str, str]) -> str:
    """``columns``: name to "date", "number" or "text"."""

    def one(column, kind):
        if kind == "date":
            return f"SELECT '{column}' AS column_name, 'date' AS column_class"
        few = "count(DISTINCT {0}) < 10" if kind == "number" else "count(DISTINCT {0}) < count(*) * 5E-2"
        other = "numerical" if kind == "number" else "other"
        test = few.format(column)
        return (
            f"SELECT '{column}' AS column_name, CASE WHEN {test} THEN 'categorical' ELSE '{other}' END AS column_class "
            f"FROM {name}"
        )

    return " UNION ALL ".join(one(*item) for item in columns.items())


@query(
    "b6_classify_lineitem",
    _classes_sql(
        "lineitem",
        dict(
            l_orderkey="number", l_partkey="number", l_suppkey="number", l_linenumber="number", l_quantity="number",
            l_extendedprice="number", l_discount="number", l_tax="number", l_returnflag="text", l_linestatus="text",
            l_shipdate="date",
        ),
    ),
)
def classify_lineitem(spark, sf_dir):
    return ops.class_table(table(spark, sf_dir, "lineitem"))


@query(
    "b6_classify_customer",
    _classes_sql(
        "customer",
        dict(c_custkey="number", c_name="text", c_nationkey="number", c_acctbal="number", c_mktsegment="text"),
    ),
)
def classify_customer(spark, sf_dir):
    return ops.class_table(table(spark, sf_dir, "customer"))


_TEXT = {"EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"}


@query(
    "b6_classify_loans",
    on_loans(
        _classes_sql(
            "loans",
            {c: "date" if c == "ApplicationDate" else "text" if c in _TEXT else "number" for c in RAW_COLUMNS},
        )
    ),
)
def classify_loans(spark, sf_dir):
    return ops.class_table(loans(spark, sf_dir).select(*RAW_COLUMNS))


@query(
    "b7_columns_of_type",
    """SELECT round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
    round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem""",
)
def columns_of_type(spark, sf_dir):
    return tidy(ops.columns_of_type(table(spark, sf_dir, "lineitem"), T.FloatType, T.DoubleType))


@query(
    "b8_preview",
    on_loans(
        """SELECT row_id, Age, CreditScore, round(RiskScore, 6) AS RiskScore FROM loans ORDER BY row_id LIMIT 10"""
    ),
)
def preview(spark, sf_dir):
    return tidy(ops.preview(loans(spark, sf_dir).select("row_id", "Age", "CreditScore", "RiskScore"), "row_id", 10))


@query(
    "b9_schema_and_shape",
    """SELECT t.*, s.n AS row_count, CAST(5 AS BIGINT) AS column_count FROM (VALUES
      (CAST(0 AS BIGINT), 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'),
      (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) t(position, column_name, column_type),
      (SELECT count(*) AS n FROM customer) s""",
)
def schema_and_shape(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return tidy(ops.schema_table(df).join(F.broadcast(ops.shape(df))))


@query(
    "b10_split_target",
    on_loans(
        """SELECT row_id, round(RiskScore, 6) AS RiskScore, CAST(36 AS BIGINT) AS feature_columns FROM loans"""
    ),
)
def split_target(spark, sf_dir):
    features, target = ops.split_target(loans(spark, sf_dir), "row_id", "RiskScore")
    return tidy(target.withColumn("feature_columns", F.lit(len(features.columns))))


@query(
    "b11_attach_predictions",
    on_loans(
        """SELECT row_id, LoanPurpose, round(LoanAmount, 6) AS LoanAmount,
        round(80 - 6E-2 * CreditScore + 12 * DebtToIncomeRatio + 10 * BankruptcyHistory, 6) AS prediction FROM loans"""
    ),
)
def attach_predictions(spark, sf_dir):
    """The prediction is one more expression over the same row; nothing is matched by position."""
    scored = loans(spark, sf_dir).withColumn("prediction", F.expr(MODELS["three_factor"]))
    return tidy(scored.select("row_id", "LoanPurpose", "LoanAmount", "prediction"))
