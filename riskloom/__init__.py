"""Loan-risk data jobs on Spark: validate, engineer, profile, train, score, watch."""
