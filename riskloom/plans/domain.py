"""Queries of the lending rules (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..schema import RAW_COLUMNS
from ..sources.tables import derive_loans as loans
from .catalog import on_loans, query, tidy

SUMMARY_SQL = """count(*) AS loans, round(avg(LoanApproved), 6) AS approval_rate,
  round(avg(CreditScore), 6) AS avg_credit_score, round(avg(AnnualIncome), 6) AS avg_income,
  round(avg(LoanAmount), 6) AS avg_amount, round(avg(TotalDebtToIncomeRatio), 6) AS avg_debt_ratio,
  round(avg(InterestRate), 6) AS avg_interest_rate, round(avg(RiskScore), 6) AS avg_risk_score"""


@query(
    "e19_portfolio_by_purpose",
    on_loans(f"SELECT LoanPurpose, {SUMMARY_SQL} FROM loans GROUP BY LoanPurpose"),
)
def portfolio_by_purpose(spark, sf_dir):
    return tidy(rules.portfolio_summary(loans(spark, sf_dir), "LoanPurpose"))


@query("e19_portfolio_total", on_loans(f"SELECT {SUMMARY_SQL} FROM loans"))
def portfolio_total(spark, sf_dir):
    return tidy(rules.portfolio_summary(loans(spark, sf_dir)))


@query(
    "e19_portfolio_rollup",
    on_loans(
        f"""SELECT coalesce(LoanPurpose, '(all)') AS LoanPurpose, coalesce(EmploymentStatus, '(all)') AS EmploymentStatus,
        {SUMMARY_SQL} FROM loans GROUP BY ROLLUP (LoanPurpose, EmploymentStatus)"""
    ),
)
def portfolio_rollup(spark, sf_dir):
    rolled = rules.portfolio_summary(loans(spark, sf_dir), "LoanPurpose", "EmploymentStatus", rollup=True)
    return tidy(rolled.na.fill("(all)", ["LoanPurpose", "EmploymentStatus"]))


def _derived(name, column):
    """Registers one derived column of the loan table, keyed by row."""

    @query(name, on_loans(f"SELECT row_id, round(CAST({column} AS DOUBLE), 6) AS {column} FROM loans"))
    def run(spark, sf_dir):
        return tidy(loans(spark, sf_dir).select("row_id", F.col(column).cast("double").alias(column)))


for _name, _column in {
    "e1_total_assets": "TotalAssets",
    "e2_net_worth": "NetWorth",
    "e3_base_interest_rate": "BaseInterestRate",
    "e4_interest_rate": "InterestRate",
    "e5_monthly_payment": "MonthlyLoanPayment",
    "e6_total_debt_to_income": "TotalDebtToIncomeRatio",
    "e18_risk_score": "RiskScore",
}.items():
    _derived(_name, _column)


@query(
    "e7_approval_terms",
    on_loans(
        """SELECT row_id, LoanApproved, round(CAST(CreditScore - 600 AS DOUBLE) / 250, 6) AS credit,
        round(CAST(100000 - AnnualIncome AS DOUBLE) / 100000, 6) AS income,
        round((TotalDebtToIncomeRatio - 4E-1) * 2, 3) AS debt, round((LoanAmount - 10000) / 90000, 9) AS amount,
        round((InterestRate - 5E-2) * 10, 6) AS rate, BankruptcyHistory * 5E-1 AS bankruptcy,
        PreviousLoanDefaults * 3E-1 AS defaults,
        CASE WHEN EmploymentStatus = 'Unemployed' THEN 2E-1 ELSE 0E0 END AS unemployed,
        CASE WHEN HomeOwnershipStatus IN ('Own', 'Mortgage') THEN -1E-1 ELSE 0E0 END AS housing,
        round(-CAST(PaymentHistory AS DOUBLE) / 120, 6) AS payments,
        round(-CAST(LengthOfCreditHistory AS DOUBLE) / 60, 6) AS history,
        round(-CAST(NetWorth AS DOUBLE) / 500000, 6) AS worth,
        round(CAST(abs(Age - 40) AS DOUBLE) / 100, 6) AS age,
        round(0E0 - CAST(Experience AS DOUBLE) / 200, 6) AS experience,
        CASE EducationLevel WHEN 'High School' THEN 2E-1 WHEN 'Associate' THEN 1E-1 WHEN 'Bachelor' THEN 0E0
          WHEN 'Master' THEN -1E-1 ELSE -2E-1 END AS education,
        CASE WHEN month(CAST(ApplicationDate AS DATE)) IN (3, 4, 5, 6, 7, 8) THEN -1E-1 ELSE 0E0 END AS season
        FROM loans"""
    ),
)
def approval_terms(spark, sf_dir):
    # The debt term carries the payment's last-digit noise; amounts can end on an exact half.
    digits = {"debt": 3, "amount": 9}
    terms = [F.round(c, digits.get(n, 6)).alias(n) for n, c in rules.approval_terms().items()]
    return loans(spark, sf_dir).select("row_id", "LoanApproved", *terms)


_BAND_IDS = {
    "e8": "credit_score", "e9": "debt_to_income", "e10": "payment_history", "e11": "bankruptcy",
    "e12": "previous_defaults", "e13": "utilization", "e14": "credit_history", "e15": "income",
    "e16": "employment", "e17": "net_worth",
}


def _band(op, name):
    band = f"{name}_band"

    @query(
        f"{op}_{band}",
        on_loans(
            f"""SELECT CAST({band} AS BIGINT) AS band, count(*) AS loans, round(avg(RiskScore), 6) AS avg_risk_score
            FROM loans_all GROUP BY 1"""
        ),
    )
    def run(spark, sf_dir):
        banded = loans(spark, sf_dir).select(rules.band(name).alias("band"), "RiskScore")
        return tidy(
            banded.groupBy("band").agg(
                F.count(F.lit(1)).alias("loans"), F.avg("RiskScore").alias("avg_risk_score")
            )
        )


for _op, _name in _BAND_IDS.items():
    _band(_op, _name)


@query(
    "e16_employment_band_any_case",
    on_loans(
        """SELECT row_id, CAST(CASE lower(EmploymentStatus) WHEN 'employed' THEN 1 WHEN 'self-employed' THEN 2
        WHEN 'part-time' THEN 3 ELSE 4 END AS BIGINT) AS band FROM loans"""
    ),
)
def employment_any_case(spark, sf_dir):
    return loans(spark, sf_dir).select("row_id", rules.band("employment", ignore_case=True).alias("band"))


@query("e0_loans_table", on_loans("SELECT " + ", ".join(
    ["row_id", "MaritalStatus", "LoanApproved"] + [
        c if c in ("ApplicationDate", "EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose")
        else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in RAW_COLUMNS]) + " FROM loans"))
def loans_table(spark, sf_dir):
    df = loans(spark, sf_dir)
    text = {"ApplicationDate", "EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"}
    return tidy(
        df.select(
            "row_id", "MaritalStatus", "LoanApproved",
            *[F.col(c) if c in text else F.col(c).cast("double").alias(c) for c in RAW_COLUMNS],
        )
    )
