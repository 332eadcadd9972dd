"""Lending rules as column expressions: derived amounts, approval score, risk bands.

Each rule is one SQL expression over the loan columns, handed to Catalyst as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: thresholds and weights of the rules ----

MIN_NET_WORTH = 1000
APPROVAL_LIMIT = 1
APPROVED_DISCOUNT = 0.8
EDUCATION_SCORE = {"High School": 0.2, "Associate": 0.1, "Bachelor": 0.0, "Master": -0.1, "Doctorate": -0.2}
EMPLOYMENT_BANDS = {"Employed": 1, "Self-employed": 2, "Part-time": 3}
EMPLOYMENT_OTHER = 4

# band name: (column, direction, thresholds of bands 1 to 4, weight); anything else is band 5
THRESHOLD_BANDS = {
    "credit_score": ("CreditScore", ">=", (750, 700, 650, 600), 3),
    "debt_to_income": ("DebtToIncomeRatio", "<", (0.20, 0.30, 0.40, 0.50), 2),
    "payment_history": ("PaymentHistory", ">=", (99, 97, 95, 90), 2),
    "utilization": ("CreditCardUtilizationRate", "<", (0.20, 0.40, 0.60, 0.80), 1),
    "credit_history": ("LengthOfCreditHistory", ">=", (10, 7, 5, 3), 1),
    "income": ("AnnualIncome", ">=", (120000, 80000, 50000, 30000), 1),
    "net_worth": ("NetWorth", ">=", (500000, 250000, 100000, 50000), 2),
}
OTHER_WEIGHTS = {"bankruptcy": 3, "previous_defaults": 3, "employment": 1}

WORST_BAND = 5

# ---- end of fixed values ----

def total_assets() -> Column:
    return F.expr("greatest(TotalAssets, SavingsAccountBalance + CheckingAccountBalance)")


def net_worth() -> Column:
    return F.expr(f"greatest(TotalAssets - TotalLiabilities, {MIN_NET_WORTH})")


def base_interest_rate() -> Column:
    return F.expr("0.03D + double(850 - CreditScore) / 2000 + LoanAmount / 1000000 + double(LoanDuration) / 1200")


def interest_rate(multiplier: str) -> Column:
    return F.expr(f"BaseInterestRate * least(greatest({multiplier}, 0.8D), 1.2D)")


def monthly_payment() -> Column:
    """Level payment of an amortised loan; a free loan is paid off in equal parts."""
    return F.expr(
        """CASE WHEN InterestRate = 0 THEN LoanAmount / LoanDuration
        ELSE try_divide(LoanAmount * (InterestRate / 12), 1 - pow(1 + InterestRate / 12, -LoanDuration)) END"""
    )


def total_debt_to_income() -> Column:
    return F.expr("try_divide(MonthlyDebtPayments + MonthlyLoanPayment, MonthlyIncome)")


def _lookup(column: str, values: dict, otherwise: object = "NULL") -> str:
    whens = " ".join(f"WHEN {column} = '{level}' THEN {value}" for level, value in values.items())
    return f"CASE {whens} ELSE {otherwise} END"


# Every additive part of the approval score, so that a decision can be explained.
APPROVAL_TERMS = {
    "credit": "double(CreditScore - 600) / 250",
    "income": "double(100000 - AnnualIncome) / 100000",
    "debt": "(TotalDebtToIncomeRatio - 0.4D) * 2",
    "amount": "(LoanAmount - 10000) / 90000",
    "rate": "(InterestRate - 0.05D) * 10",
    "bankruptcy": "IF(BankruptcyHistory = 1, 0.5D, 0D)",
    "defaults": "IF(PreviousLoanDefaults = 1, 0.3D, 0D)",
    "unemployed": "IF(EmploymentStatus = 'Unemployed', 0.2D, 0D)",
    "housing": "IF(HomeOwnershipStatus IN ('Own', 'Mortgage'), -0.1D, 0D)",
    "payments": "-double(PaymentHistory) / 120",
    "history": "-double(LengthOfCreditHistory) / 60",
    "worth": "-double(NetWorth) / 500000",
    "age": "double(abs(Age - 40)) / 100",
    "experience": "-double(Experience) / 200",
    "education": _lookup("EducationLevel", {k: f"{v}D" for k, v in EDUCATION_SCORE.items()}),
    "season": "IF(try_cast(split_part(ApplicationDate, '-', 2) AS INT) BETWEEN 3 AND 8, -0.1D, 0D)",
}


def approval_terms() -> dict[str, Column]:
    return {name: F.expr(term) for name, term in APPROVAL_TERMS.items()}


def approval_score() -> Column:
    return F.expr(" + ".join(f"({term})" for term in APPROVAL_TERMS.values()))


def approved() -> Column:
    return F.when(approval_score() < APPROVAL_LIMIT, 1).otherwise(0).cast("bigint")


def threshold_band(value: str, direction: str, thresholds: tuple[float, ...]) -> str:
    """Band 1 is the safest. A missing value is in the worst band, so NaN becomes null first."""
    known = f"nanvl(double({value}), NULL)"
    whens = " ".join(f"WHEN {known} {direction} {limit} THEN {band}" for band, limit in enumerate(thresholds, start=1))
    return f"CASE {whens} ELSE {WORST_BAND} END"


def employment_band(ignore_case: bool = False) -> str:
    """The listed spelling ``Self-employed`` is matched exactly unless ``ignore_case`` is set."""
    if ignore_case:
        lowered = {level.lower(): band for level, band in EMPLOYMENT_BANDS.items()}
        return _lookup("lower(EmploymentStatus)", lowered, EMPLOYMENT_OTHER)
    return _lookup("EmploymentStatus", EMPLOYMENT_BANDS, EMPLOYMENT_OTHER)


def band_rules(ignore_case: bool = False) -> dict[str, str]:
    out = {name: threshold_band(c, way, limits) for name, (c, way, limits, _) in THRESHOLD_BANDS.items()}
    out["bankruptcy"] = f"IF(BankruptcyHistory = 0, 1, {WORST_BAND})"
    out["previous_defaults"] = f"CASE PreviousLoanDefaults WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE {WORST_BAND} END"
    out["employment"] = employment_band(ignore_case)
    return out


def band(name: str, ignore_case: bool = False) -> Column:
    return F.expr(band_rules(ignore_case)[name]).cast("bigint")


def band_weights() -> dict[str, int]:
    return {name: weight for name, (*_, weight) in THRESHOLD_BANDS.items()} | OTHER_WEIGHTS


def risk_score(ignore_case: bool = False) -> Column:
    """Weighted sum of the ten bands, reduced for approved applications."""
    weights = band_weights()
    total = " + ".join(f"{weights[name]} * ({rule})" for name, rule in band_rules(ignore_case).items())
    return F.expr(f"double({total}) * IF(LoanApproved = 1, {APPROVED_DISCOUNT}D, 1D)")



def portfolio_summary(df: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    """Headline averages of a loan book, overall or by any dimensions."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return grouped.agg(
        F.count(F.lit(1)).alias("loans"),
        F.avg("LoanApproved").alias("approval_rate"),
        F.avg("CreditScore").alias("avg_credit_score"),
        F.avg("AnnualIncome").alias("avg_income"),
        F.avg("LoanAmount").alias("avg_amount"),
        F.avg("TotalDebtToIncomeRatio").alias("avg_debt_ratio"),
        F.avg("InterestRate").alias("avg_interest_rate"),
        F.avg("RiskScore").alias("avg_risk_score"),
    )
