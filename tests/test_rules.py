import statistics

import pytest
from pyspark.sql import functions as F

from riskloom.functions.maths import normal_quantile, safe_divide
from riskloom.operators import rules


def test_missing_band_input_is_the_worst(spark):
    df = spark.createDataFrame(
        [(float("nan"), None, None), (750.0, 0, "Self-Employed"), (749.9, 2, "self-employed")],
        "CreditScore double, BankruptcyHistory int, EmploymentStatus string",
    )
    got = df.select(
        rules.band("credit_score").alias("c"), rules.band("bankruptcy").alias("b"),
        rules.band("employment").alias("e"), rules.band("employment", ignore_case=True).alias("i"),
    ).collect()
    assert [tuple(r) for r in got] == [(5, 5, 4, 4), (1, 1, 4, 2), (2, 5, 4, 2)]


def test_free_loan_is_paid_in_equal_parts(spark):
    df = spark.createDataFrame([(0.0, 1200.0, 12), (0.12, 1000.0, 12)], "InterestRate double, LoanAmount double, LoanDuration long")
    free, paid = [r[0] for r in df.select(rules.monthly_payment()).collect()]
    assert free == 100.0 and paid == pytest.approx(88.848788678)


def test_safe_divide_modes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    for mode, fill in (("zero", 0.0), ("inf", float("inf")), ("nan", None)):
        got = [r[0] for r in df.select(safe_divide(F.col("a"), F.col("b"), mode)).collect()]
        assert got == [fill, fill, None, 1.5]


def test_normal_quantile(spark):
    ps = [1e-12, 1e-5, 0.01, 0.3, 0.5, 0.925, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-12)


def test_missing_month_has_no_season(spark):
    df = spark.createDataFrame([("bad",), ("2024-05-01",), ("2024-11-01",)], "ApplicationDate string")
    got = [r[0] for r in df.select(rules.approval_terms()["season"]).collect()]
    assert got == [0.0, -0.1, 0.0]
