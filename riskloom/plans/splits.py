"""Queries of splits, folds, samples and combinations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as ops
from ..sources.tables import loans, table
from .catalog import on_loans, query, tidy


def hash_sql(key, salt, digits=8):
    return f"CAST('0x' || substr(md5('{salt}:' || {key}), 1, {digits}) AS BIGINT)"


_TEST = f"{hash_sql('row_id', 42)} % 100 < 20"


@query("g1_train_test", on_loans(f"SELECT row_id, CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS split FROM loans"))
def train_test(spark, sf_dir):
    return ops.with_split(loans(spark, sf_dir).select("row_id"))


@query(
    "g2_nested_split",
    on_loans(
        f"""SELECT row_id, CASE WHEN {_TEST} THEN 'test' WHEN {hash_sql('row_id', '42-validation')} % 100 < 20
        THEN 'validation' ELSE 'train' END AS split FROM loans"""
    ),
)
def nested_split(spark, sf_dir):
    return ops.with_nested_split(loans(spark, sf_dir).select("row_id"))


@query(
    "g3_folds",
    f"""SELECT {hash_sql('o_orderkey', '42-fold')} % 5 AS fold, count(*) AS row_count,
    round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1""",
)
def folds(spark, sf_dir):
    dealt = ops.with_folds(table(spark, sf_dir, "orders"), "o_orderkey")
    return tidy(
        dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    )


@query(
    "g4_sample_rows",
    f"SELECT o_orderkey FROM orders ORDER BY {hash_sql('o_orderkey', '42-sample', 13)}, o_orderkey LIMIT 1000",
)
def sample_rows(spark, sf_dir):
    return ops.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")


@query("g4_sample_share", f"SELECT o_orderkey FROM orders WHERE {hash_sql('o_orderkey', '42-share')} % 100 < 10")
def sample_share(spark, sf_dir):
    return ops.sample_share(table(spark, sf_dir, "orders").select("o_orderkey"), 10, "o_orderkey")


@query(
    "g5_concat_rows",
    on_loans("SELECT EmploymentStatus, count(*) AS loans, sum(Age)::BIGINT AS ages FROM loans GROUP BY 1"),
)
def concat_rows(spark, sf_dir):
    train, test = ops.train_test(loans(spark, sf_dir).select("row_id", "EmploymentStatus", "Age"))
    both = ops.concat_rows(train, test.select("Age", "row_id", "EmploymentStatus"))
    return both.groupBy("EmploymentStatus").agg(F.count(F.lit(1)).alias("loans"), F.sum("Age").alias("ages"))


@query("g6_concat_columns", "SELECT doc_id, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents JOIN labels USING (doc_id)")
def concat_columns(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return tidy(ops.concat_columns(documents, table(spark, sf_dir, "labels"), "doc_id"))


@query(
    "g7_split_stats",
    on_loans(
        f"""SELECT CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS split, count(RiskScore) AS count,
        round(avg(RiskScore), 6) AS mean, round(stddev_samp(RiskScore), 6) AS std, round(min(RiskScore), 6) AS min,
        round(quantile_cont(RiskScore, 25E-2), 6) AS p25, round(quantile_cont(RiskScore, 5E-1), 6) AS p50,
        round(quantile_cont(RiskScore, 75E-2), 6) AS p75, round(max(RiskScore), 6) AS max FROM loans GROUP BY 1"""
    ),
)
def split_stats(spark, sf_dir):
    return tidy(ops.split_stats(ops.with_split(loans(spark, sf_dir)), "RiskScore"))
