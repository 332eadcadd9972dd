"""Registry of runnable queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin for an independent engine."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: whole numbers as bigint, reals as rounded doubles."""

    def clean(f: T.StructField) -> str:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return f"round(double(`{f.name}`), {digits}) + 0D AS `{f.name}`"
        if isinstance(f.dataType, T.IntegralType):
            return f"bigint(`{f.name}`) AS `{f.name}`"
        return f"`{f.name}`"

    return df.selectExpr(*[clean(f) for f in df.schema.fields])


# The loan applications of sources.tables.loans, written independently in SQL.
LOANS = """
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_ret,
         CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS gross
  FROM lineitem GROUP BY l_orderkey),
raw0 AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderdate, o.o_totalprice, o.o_orderpriority, c.c_acctbal,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_ret, 0) AS n_ret, coalesce(gross, 0) AS gross
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN lines ON l_orderkey = o.o_orderkey),
raw1 AS (
  SELECT k AS row_id, strftime(o_orderdate, '%Y-%m-%d') AS ApplicationDate, 18 + ck % 63 AS Age,
    CAST(floor(15000 + (c_acctbal + 1000) * 20) AS BIGINT) AS AnnualIncome,
    300 + (ck * 37 + k * 11) % 551 AS CreditScore,
    CASE WHEN k % 10 < 7 THEN 'Employed' WHEN k % 10 < 9 THEN 'Self-Employed' ELSE 'Unemployed' END AS EmploymentStatus,
    ['High School', 'Associate', 'Bachelor', 'Master', 'Doctorate'][1 + ck % 5] AS EducationLevel,
    CAST(floor(CAST((ck % 63) * (k % 10) AS DOUBLE) / 10) AS BIGINT) AS Experience,
    o_totalprice / 10 AS LoanAmount, 12 * (1 + k % 10) AS LoanDuration,
    ['Single', 'Married', 'Divorced', 'Widowed'][1 + ck % 4] AS MaritalStatus, ck % 6 AS NumberOfDependents,
    ['Own', 'Rent', 'Mortgage', 'Other'][1 + (ck + k) % 4] AS HomeOwnershipStatus,
    CAST(100 + (k * 7919) % 1900 AS DOUBLE) AS MonthlyDebtPayments,
    CAST((k * 31) % 1000 AS DOUBLE) / 1000 AS CreditCardUtilizationRate,
    n_lines AS NumberOfOpenCreditLines, n_ret AS NumberOfCreditInquiries,
    CAST((k * 17) % 900 AS DOUBLE) / 1000 AS DebtToIncomeRatio,
    CAST(CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END AS BIGINT) AS BankruptcyHistory,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Home' WHEN '2-HIGH' THEN 'Auto' WHEN '3-MEDIUM' THEN 'Education'
      WHEN '5-LOW' THEN 'Debt Consolidation' ELSE 'Other' END AS LoanPurpose,
    CAST(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS PreviousLoanDefaults,
    40 + (k * 13) % 61 AS PaymentHistory, 1 + (ck * 7) % 29 AS LengthOfCreditHistory,
    CAST(floor(abs(c_acctbal)) AS BIGINT) AS SavingsAccountBalance, (k * 101) % 5000 AS CheckingAccountBalance,
    greatest(gross, CAST(floor(abs(c_acctbal)) AS BIGINT) + (k * 101) % 5000) AS TotalAssets,
    CAST(floor(CAST(gross * (k % 9) AS DOUBLE) / 8) AS BIGINT) AS TotalLiabilities,
    CAST(floor(15000 + (c_acctbal + 1000) * 20) AS DOUBLE) / 12 AS MonthlyIncome,
    CAST((k * 29) % 1000 AS DOUBLE) / 1000 AS UtilityBillsPaymentHistory, (ck * 3) % 41 AS JobTenure,
    8E-1 + CAST((k * 53) % 401 AS DOUBLE) / 1000 AS mult
  FROM raw0),
raw2 AS (
  SELECT *, greatest(TotalAssets - TotalLiabilities, 1000) AS NetWorth,
    3E-2 + CAST(850 - CreditScore AS DOUBLE) / 2000 + LoanAmount / 1000000 + CAST(LoanDuration AS DOUBLE) / 1200
      AS BaseInterestRate FROM raw1),
raw3 AS (SELECT *, BaseInterestRate * least(greatest(mult, 8E-1), 12E-1) AS InterestRate FROM raw2),
raw4 AS (
  SELECT *, LoanAmount * (InterestRate / 12) / (1 - pow(1 + InterestRate / 12, -LoanDuration)) AS MonthlyLoanPayment
  FROM raw3),
raw5 AS (
  SELECT *, (MonthlyDebtPayments + MonthlyLoanPayment) / MonthlyIncome AS TotalDebtToIncomeRatio FROM raw4),
raw6 AS (
  SELECT *, CAST(CASE WHEN
      CAST(CreditScore - 600 AS DOUBLE) / 250 + CAST(100000 - AnnualIncome AS DOUBLE) / 100000
      + (TotalDebtToIncomeRatio - 4E-1) * 2 + (LoanAmount - 10000) / 90000 + (InterestRate - 5E-2) * 10
      + BankruptcyHistory * 5E-1 + PreviousLoanDefaults * 3E-1
      + CASE WHEN EmploymentStatus = 'Unemployed' THEN 2E-1 ELSE 0E0 END
      - CASE WHEN HomeOwnershipStatus IN ('Own', 'Mortgage') THEN 1E-1 ELSE 0E0 END
      - CAST(PaymentHistory AS DOUBLE) / 120 - CAST(LengthOfCreditHistory AS DOUBLE) / 60
      - CAST(NetWorth AS DOUBLE) / 500000 + CAST(abs(Age - 40) AS DOUBLE) / 100 - CAST(Experience AS DOUBLE) / 200
      + CASE EducationLevel WHEN 'High School' THEN 2E-1 WHEN 'Associate' THEN 1E-1 WHEN 'Bachelor' THEN 0E0
          WHEN 'Master' THEN -1E-1 ELSE -2E-1 END
      - CASE WHEN CAST(substr(ApplicationDate, 6, 2) AS INT) BETWEEN 3 AND 8 THEN 1E-1 ELSE 0E0 END
      < 1 THEN 1 ELSE 0 END AS BIGINT) AS LoanApproved FROM raw5),
banded AS (
  SELECT *,
    CASE WHEN CreditScore >= 750 THEN 1 WHEN CreditScore >= 700 THEN 2 WHEN CreditScore >= 650 THEN 3
         WHEN CreditScore >= 600 THEN 4 ELSE 5 END AS credit_score_band,
    CASE WHEN DebtToIncomeRatio < 2E-1 THEN 1 WHEN DebtToIncomeRatio < 3E-1 THEN 2 WHEN DebtToIncomeRatio < 4E-1 THEN 3
         WHEN DebtToIncomeRatio < 5E-1 THEN 4 ELSE 5 END AS debt_to_income_band,
    CASE WHEN PaymentHistory >= 99 THEN 1 WHEN PaymentHistory >= 97 THEN 2 WHEN PaymentHistory >= 95 THEN 3
         WHEN PaymentHistory >= 90 THEN 4 ELSE 5 END AS payment_history_band,
    CASE WHEN CreditCardUtilizationRate < 2E-1 THEN 1 WHEN CreditCardUtilizationRate < 4E-1 THEN 2
         WHEN CreditCardUtilizationRate < 6E-1 THEN 3 WHEN CreditCardUtilizationRate < 8E-1 THEN 4 ELSE 5 END
      AS utilization_band,
    CASE WHEN LengthOfCreditHistory >= 10 THEN 1 WHEN LengthOfCreditHistory >= 7 THEN 2
         WHEN LengthOfCreditHistory >= 5 THEN 3 WHEN LengthOfCreditHistory >= 3 THEN 4 ELSE 5 END AS credit_history_band,
    CASE WHEN AnnualIncome >= 120000 THEN 1 WHEN AnnualIncome >= 80000 THEN 2 WHEN AnnualIncome >= 50000 THEN 3
         WHEN AnnualIncome >= 30000 THEN 4 ELSE 5 END AS income_band,
    CASE WHEN NetWorth >= 500000 THEN 1 WHEN NetWorth >= 250000 THEN 2 WHEN NetWorth >= 100000 THEN 3
         WHEN NetWorth >= 50000 THEN 4 ELSE 5 END AS net_worth_band,
    CASE WHEN BankruptcyHistory = 0 THEN 1 ELSE 5 END AS bankruptcy_band,
    CASE WHEN PreviousLoanDefaults = 0 THEN 1 WHEN PreviousLoanDefaults = 1 THEN 3 ELSE 5 END AS previous_defaults_band,
    CASE WHEN EmploymentStatus = 'Employed' THEN 1 ELSE 4 END AS employment_band
  FROM raw6),
loans_all AS (
  SELECT *, CAST(credit_score_band * 3 + debt_to_income_band * 2 + payment_history_band * 2 + bankruptcy_band * 3
      + previous_defaults_band * 3 + utilization_band + credit_history_band + income_band + employment_band
      + net_worth_band * 2 AS DOUBLE) * CASE WHEN LoanApproved = 1 THEN 8E-1 ELSE 1E0 END AS RiskScore
  FROM banded),
loans AS (
  SELECT row_id, ApplicationDate, Age, AnnualIncome, CreditScore, EmploymentStatus, EducationLevel, Experience,
    LoanAmount, LoanDuration, NumberOfDependents, HomeOwnershipStatus, MonthlyDebtPayments, CreditCardUtilizationRate,
    NumberOfOpenCreditLines, NumberOfCreditInquiries, DebtToIncomeRatio, BankruptcyHistory, LoanPurpose,
    PreviousLoanDefaults, PaymentHistory, LengthOfCreditHistory, SavingsAccountBalance, CheckingAccountBalance,
    TotalAssets, TotalLiabilities, MonthlyIncome, UtilityBillsPaymentHistory, JobTenure, NetWorth, BaseInterestRate,
    InterestRate, MonthlyLoanPayment, TotalDebtToIncomeRatio, MaritalStatus, LoanApproved, RiskScore
  FROM loans_all)"""

# The seeded defects of sources.tables.loans_dirty. Only these columns differ from ``loans``.
DIRTY = (
    LOANS
    + """,
dirty AS (
  SELECT * REPLACE (
    CASE WHEN row_id % 109 = 4 THEN 'not-a-date' ELSE ApplicationDate END AS ApplicationDate,
    CASE row_id % 97 WHEN 0 THEN '17' WHEN 1 THEN 'thirty' WHEN 2 THEN '25.5' ELSE CAST(Age AS VARCHAR) END AS Age,
    CASE row_id % 101 WHEN 1 THEN 'bad' WHEN 2 THEN '851' ELSE CAST(CreditScore AS VARCHAR) END AS CreditScore,
    CASE row_id % 103 WHEN 2 THEN 'retired' WHEN 3 THEN 'self_employed' WHEN 4 THEN NULL ELSE EmploymentStatus END
      AS EmploymentStatus,
    CASE row_id % 107 WHEN 3 THEN NULL WHEN 4 THEN '-1000' ELSE CAST(LoanAmount AS VARCHAR) END AS LoanAmount,
    CASE WHEN row_id % 127 = 6 THEN '0' ELSE CAST(MonthlyIncome AS VARCHAR) END AS MonthlyIncome)
  FROM loans)"""
)


def on_loans(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LOANS.strip(), *ctes]) + "\n" + select


def on_dirty(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([DIRTY.strip(), *ctes]) + "\n" + select
