"""The given tables, and the loan tables Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import rules
from ..schema import EDUCATION, HOME, LABELS, MARITAL, RAW_COLUMNS
from ..session import configure, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: str, values: tuple[str, ...]) -> str:
    return f"elt(int({index}) + 1, {', '.join(repr(v) for v in values)})"


def derive_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order.

    Line items are folded to one row per order before the join, so a hot order costs one
    partial aggregate per task. The customer join is left to adaptive execution: broadcast
    while the measured side is small, skew-split sort-merge beyond that.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
            F.sum(F.floor("l_extendedprice")).alias("gross"),
        )
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
        .na.fill(0, ["n_lines", "n_ret", "gross"])
    )
    applications = joined.withColumnsRenamed({"o_orderkey": "k", "o_custkey": "ck"}).selectExpr(
        "k AS row_id",
        "date_format(date(o_orderdate), 'yyyy-MM-dd') AS ApplicationDate",
        "18 + ck % 63 AS Age",
        "floor(15000 + (c_acctbal + 1000) * 20) AS AnnualIncome",
        "300 + (ck * 37 + k * 11) % 551 AS CreditScore",
        "CASE WHEN k % 10 < 7 THEN 'Employed' WHEN k % 10 < 9 THEN 'Self-Employed' ELSE 'Unemployed' END"
        " AS EmploymentStatus",
        f"{_pick('ck % 5', EDUCATION)} AS EducationLevel",
        "floor(double((ck % 63) * (k % 10)) / 10) AS Experience",
        "o_totalprice / 10 AS LoanAmount",
        "12 * (1 + k % 10) AS LoanDuration",
        f"{_pick('ck % 4', MARITAL)} AS MaritalStatus",
        "ck % 6 AS NumberOfDependents",
        f"{_pick('(ck + k) % 4', HOME)} AS HomeOwnershipStatus",
        "double(100 + (k * 7919) % 1900) AS MonthlyDebtPayments",
        "double((k * 31) % 1000) / 1000 AS CreditCardUtilizationRate",
        "n_lines AS NumberOfOpenCreditLines",
        "n_ret AS NumberOfCreditInquiries",
        "double((k * 17) % 900) / 1000 AS DebtToIncomeRatio",
        "bigint(k % 20 = 0) AS BankruptcyHistory",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Home' WHEN '2-HIGH' THEN 'Auto' WHEN '3-MEDIUM' THEN 'Education'"
        " WHEN '5-LOW' THEN 'Debt Consolidation' ELSE 'Other' END AS LoanPurpose",
        "bigint(k % 11 = 0) AS PreviousLoanDefaults",
        "40 + (k * 13) % 61 AS PaymentHistory",
        "1 + (ck * 7) % 29 AS LengthOfCreditHistory",
        "floor(abs(c_acctbal)) AS SavingsAccountBalance",
        "(k * 101) % 5000 AS CheckingAccountBalance",
        "gross AS TotalAssets",
        "floor(double(gross * (k % 9)) / 8) AS TotalLiabilities",
        "double((k * 29) % 1000) / 1000 AS UtilityBillsPaymentHistory",
        "(ck * 3) % 41 AS JobTenure",
        "0.8D + double((k * 53) % 401) / 1000 AS rate_multiplier",
        "double(floor(15000 + (c_acctbal + 1000) * 20)) / 12 AS MonthlyIncome",
    )
    derived = {
        "TotalAssets": rules.total_assets(),
        "BaseInterestRate": rules.base_interest_rate(),
        "NetWorth": rules.net_worth(),
        "InterestRate": rules.interest_rate("rate_multiplier"),
        "MonthlyLoanPayment": rules.monthly_payment(),
        "TotalDebtToIncomeRatio": rules.total_debt_to_income(),
        "LoanApproved": rules.approved(),
        "RiskScore": rules.risk_score(),
    }
    for name, rule in derived.items():
        applications = applications.withColumn(name, rule)
    return applications.select("row_id", *RAW_COLUMNS, "MaritalStatus", *LABELS)


_landed: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _land(spark: SparkSession, sf_dir: str, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """The derived table, written once per application to the shared folder.

    Jobs then scan plain columns. Conditions on them reach the Parquet scan instead of being
    pushed, and multiplied, through the formulas the rows were derived with.
    """
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place in _landed:
        path, schema = _landed[place]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the folder was cleared
            pass
    df, path = derive(), fresh_path(spark, name)
    df.write.parquet(path)
    _landed[place] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed loan table; ``derive_loans`` has its definition."""
    configure(spark)
    return _land(spark, sf_dir, "loans", lambda: derive_loans(spark, sf_dir))


def loans_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same applications as a landed table of text, with defects keyed by ``row_id``."""

    def seeded(name: str, modulus: int, values: dict[int, str]) -> str:
        whens = " ".join(f"WHEN {remainder} THEN {value}" for remainder, value in values.items())
        return f"CASE row_id % {modulus} {whens} ELSE string({name}) END AS {name}"

    defects = {
        "ApplicationDate": (109, {4: "'not-a-date'"}),
        "Age": (97, {0: "'17'", 1: "'thirty'", 2: "'25.5'"}),
        "CreditScore": (101, {1: "'bad'", 2: "'851'"}),
        "EmploymentStatus": (103, {2: "'retired'", 3: "'self_employed'", 4: "NULL"}),
        "LoanAmount": (107, {3: "NULL", 4: "'-1000'"}),
        "MonthlyIncome": (127, {6: "'0'"}),
    }
    columns = [*RAW_COLUMNS, "MaritalStatus"]
    shown = [seeded(c, *defects[c]) if c in defects else f"string({c}) AS {c}" for c in columns]
    clean = loans(spark, sf_dir)
    return _land(spark, sf_dir, "loans_dirty", lambda: clean.selectExpr("row_id", *shown))
