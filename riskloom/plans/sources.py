"""Queries of the sources and sinks (A): every one writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..operators import features, metrics, split
from ..operators.columns import schema_table
from ..schema import RAW_COLUMNS
from ..session import fresh_path
from ..sources import artifacts, files
from ..sources.tables import loans, loans_dirty, table
from .catalog import on_dirty, on_loans, query, tidy
from .predictions import PREDICTIONS_SQL, predictions
from .splits import hash_sql

_TEST = f"{hash_sql('row_id', 42)} % 100 < 20"


@query(
    "a1_csv_scan",
    on_dirty(
        """SELECT count(*) AS row_count, CAST(35 AS BIGINT) AS column_count,
        (count(*) FILTER (EmploymentStatus IS NULL) + count(*) FILTER (LoanAmount IS NULL)) AS missing_cells FROM dirty"""
    ),
)
def csv_scan(spark, sf_dir):
    df, path = loans_dirty(spark, sf_dir), fresh_path(spark, "csv")
    files.write_csv(df, path)
    return files.scan_report(files.require_rows(files.read_csv(spark, path, df.columns, target="Age")), "Age")


@query(
    "a1_csv_malformed",
    """SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'malformed' ELSE 'good' END AS sink,
      count(*) AS row_count, CAST(sum(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 0 ELSE o_custkey END) AS BIGINT) AS keys
    FROM orders GROUP BY 1""",
)
def csv_malformed(spark, sf_dir):
    """Lines with a field too many or too few are sorted out, none is lost."""
    path = fresh_path(spark, "csv")
    line = """concat_ws(',', o_orderkey, IF(o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0, NULL, o_custkey),
      IF(o_orderkey % 7 = 0, 'one more', NULL)) AS `order,customer`"""
    raw = table(spark, sf_dir, "orders").selectExpr(line).write.option("header", True)
    raw.option("quote", "\u0000").option("sep", "\u0001").csv(path)
    good, bad = files.read_csv_checked(spark, path, ["order", "customer"])
    count = F.count(F.lit(1)).alias("row_count")
    kept = good.agg(F.lit("good").alias("sink"), count, F.sum(F.col("customer").cast("bigint")).alias("keys"))
    return tidy(kept.unionByName(bad.agg(F.lit("malformed").alias("sink"), count, F.lit(0).alias("keys"))))


_BUNDLE_SQL = f"""SELECT CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS split, count(*) AS row_count,
    sum(CreditScore)::BIGINT AS credit, round(avg(RiskScore), 6) AS mean_target FROM loans GROUP BY 1"""


def _bundle(spark, sf_dir):
    path = fresh_path(spark, "bundle")
    files.write_bundle(split.with_split(loans(spark, sf_dir)), path)
    return path


@query("a2_bundle_round_trip", on_loans(_BUNDLE_SQL))
def bundle_round_trip(spark, sf_dir):
    back = files.read_bundle(spark, _bundle(spark, sf_dir))
    return tidy(
        back.groupBy("split").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("CreditScore").alias("credit"), F.avg("RiskScore").alias("mean_target")
        )
    )


@query(
    "a3_checked_bundle",
    on_loans(
        f"""SELECT count(*) AS row_count, sum(Age)::BIGINT AS ages, round(avg(RiskScore), 6) AS mean_target FROM loans
        WHERE NOT ({_TEST})"""
    ),
)
def checked_bundle(spark, sf_dir):
    parts = files.read_checked_bundle(spark, _bundle(spark, sf_dir), "row_id", "RiskScore", "train")
    both = split.concat_columns(*parts)
    return tidy(
        both.agg(F.count(F.lit(1)).alias("row_count"), F.sum("Age").alias("ages"), F.avg("RiskScore").alias("mean_target"))
    )


@query("a4_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "csv")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    files.write_csv(df, path)
    return tidy(files.read_csv(spark, path, df.columns).selectExpr(
        "bigint(c_custkey) AS c_custkey", "c_name", "c_mktsegment", "double(c_acctbal) AS c_acctbal"))


@query("a4_csv_documents", "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents")
def csv_documents(spark, sf_dir):
    """Whole texts with line breaks, quotes and white space come back as they were."""
    path = fresh_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    rows = files.read_csv(spark, path, ["doc_id", "text"], multiline=True)
    return tidy(rows.selectExpr("bigint(doc_id) AS doc_id", "length(text) AS n_chars", "md5(text) AS digest"))


@query(
    "a5_json_report",
    on_loans(
        """WITH m AS (SELECT model AS section, CAST(count(*) AS DOUBLE) AS row_count,
          sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(pow(actual - predicted, 2)) AS mse,
          avg(abs(actual - predicted)) AS mae, 1 - avg(pow(actual - predicted, 2)) / var_pop(actual) AS r2,
          100 * avg(abs(actual - predicted) / actual) AS mape FROM scored GROUP BY model)
        SELECT section, key, round(value, 6) AS value FROM (UNPIVOT m ON row_count, rmse, mse, mae, r2, mape
          INTO NAME key VALUE value)""",
        PREDICTIONS_SQL,
    ).replace("\nWITH m AS", "\n, m AS", 1),
)
def json_report(spark, sf_dir):
    path = fresh_path(spark, "report")
    found = metrics.regression_metrics(predictions(spark, sf_dir), "model")
    files.write_report(files.metrics_report(found, "model"), path)
    return tidy(files.read_report(spark, path).drop("text"))


@query(
    "a5_text_report",
    """SELECT c_mktsegment AS section, 'customers' AS key, CAST(count(*) AS DOUBLE) AS value, min(c_name) AS text
    FROM customer GROUP BY 1""",
)
def text_report(spark, sf_dir):
    """Lines that hold a text beside their number."""
    path = fresh_path(spark, "report")
    segments = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("section"))
    files.write_report(
        segments.agg(F.lit("customers").alias("key"), F.count(F.lit(1)).cast("double").alias("value"), F.min("c_name").alias("text")), path
    )
    return tidy(files.read_report(spark, path))


def _small_pipeline(df):
    stages = [
        features.DateParts.of(column="ApplicationDate"),
        features.CraftedFeatures.of(on_zero="zero"),
        features.Polynomial.of(degree=2),
        features.CategoryEncoder.of(),
        features.TypeOptimizer.of(),
    ]
    return Pipeline(stages=stages).fit(df)


@query("a6_a7_artifacts_round_trip")
def artifacts_round_trip(spark, sf_dir):
    """Saves a fitted pipeline with its schemas, loads it, and transforms all loans with it."""
    df, path = loans(spark, sf_dir).select("row_id", *RAW_COLUMNS), fresh_path(spark, "artifacts")
    model = _small_pipeline(df)
    artifacts.save_artifacts(model, path, df, model.transform(df))
    loaded, raw, produced = artifacts.load_artifacts(spark, path)
    made = loaded.transform(df.select(*[c for c, _ in raw]))
    if [c for c, _ in produced] != made.columns:
        raise ValueError("the loaded pipeline does not keep its feature contract")
    return tidy(made)


@query(
    "a8_input_schema",
    """SELECT t.*, n AS row_count FROM (VALUES (CAST(0 AS BIGINT), 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'),
    (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'),
    (5, 'o_orderpriority', 'string')) t(position, column_name, column_type), (SELECT count(*) AS n FROM orders)""",
)
def input_schema(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return schema_table(df).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("row_count"))))
