"""A deterministic scored table for the evaluation queries: three fixed linear rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import loans

# Three stand-in models of the risk score; coefficients are arbitrary but fixed.
MODELS = {
    "three_factor": "80D - 0.06D * CreditScore + 12D * DebtToIncomeRatio + 10D * BankruptcyHistory",
    "score_only": "75D - 0.055D * CreditScore",
    "debt_only": "36D + 15D * DebtToIncomeRatio",
}

PREDICTIONS_SQL = """
scored AS (
  SELECT row_id, LoanPurpose, RiskScore AS actual, model, predicted FROM (
    SELECT *, 'three_factor' AS model, 80 - 6E-2 * CreditScore + 12 * DebtToIncomeRatio + 10 * BankruptcyHistory
      AS predicted FROM loans
    UNION ALL SELECT *, 'score_only', 75 - 55E-3 * CreditScore FROM loans
    UNION ALL SELECT *, 'debt_only', 36 + 15 * DebtToIncomeRatio FROM loans))"""


def predictions(spark, sf_dir) -> DataFrame:
    """(row_id, LoanPurpose, actual, model, predicted), one row per loan and model."""
    stacked = ", ".join(f"'{name}', {rule}" for name, rule in MODELS.items())
    return loans(spark, sf_dir).selectExpr(
        "row_id", "LoanPurpose", "RiskScore AS actual", f"stack({len(MODELS)}, {stacked}) AS (model, predicted)"
    )


def one_model(spark, sf_dir, model: str = "three_factor") -> DataFrame:
    """(row_id, actual, predicted) of a single rule; no need to stack the others."""
    return loans(spark, sf_dir).selectExpr("row_id", "RiskScore AS actual", f"{MODELS[model]} AS predicted")
