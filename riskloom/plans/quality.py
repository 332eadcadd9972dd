"""Queries of the cleaning, validation and data-quality operators (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, quality
from ..operators.columns import guard_input
from ..schema import (
    PROCESSED_CONTRACT,
    RAW_COLUMNS,
    RAW_CONTRACT,
    UPLOAD_DATES,
    UPLOAD_NUMERIC,
    UPLOAD_RULES,
    UPLOAD_TEXT,
)
from ..session import settle
from ..sources.tables import loans, loans_dirty, table
from .catalog import on_dirty, on_loans, query, tidy
from .predictions import one_model

NUMBER_TEXT = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _number(name):
    return f"CASE WHEN regexp_matches({name}, {NUMBER_TEXT}) THEN TRY_CAST({name} AS DOUBLE) END"


@query(
    "c1_required_columns",
    on_dirty(
        """SELECT name AS column_name, n AS input_rows FROM (VALUES ('Age'), ('LoanPurpose')) t(name),
        (SELECT count(*) AS n FROM dirty)"""
    ),
)
def required_columns(spark, sf_dir):
    df = loans_dirty(spark, sf_dir).drop("Age", "LoanPurpose")
    absent = contracts.missing_columns(df, RAW_CONTRACT)
    return df.agg(F.count(F.lit(1)).alias("input_rows")).select(
        F.explode(F.array(*[F.lit(c) for c in absent])).alias("column_name"), "input_rows"
    )


@query(
    "c2_unknown_columns",
    on_loans(
        """SELECT LoanPurpose, count(*) AS loans, CAST(35 AS BIGINT) AS columns_kept,
        'LoanApproved,RiskScore' AS unknown FROM loans GROUP BY LoanPurpose"""
    ),
)
def unknown_columns(spark, sf_dir):
    df = loans(spark, sf_dir)
    unknown = contracts.unknown_columns(df, RAW_CONTRACT)
    kept = contracts.check_columns(df, RAW_CONTRACT, unknown="drop")
    return tidy(
        kept.groupBy("LoanPurpose")
        .agg(F.count(F.lit(1)).alias("loans"))
        .withColumns({"columns_kept": F.lit(len(kept.columns)), "unknown": F.lit(",".join(unknown))})
    )


@query(
    "c3_numeric_coercion",
    on_dirty(
        f"""SELECT row_id, round({_number('Age')}, 6) AS Age, round({_number('CreditScore')}, 6) AS CreditScore,
        round({_number('LoanAmount')}, 6) AS LoanAmount FROM dirty"""
    ),
)
def numeric_coercion(spark, sf_dir):
    df = loans_dirty(spark, sf_dir).select("row_id", "Age", "CreditScore", "LoanAmount")
    return tidy(contracts.coerce_numbers(df, UPLOAD_NUMERIC))


@query(
    "c4_text_normalise",
    on_dirty(
        """SELECT lower(trim(EmploymentStatus)) AS EmploymentStatus, lower(trim(EducationLevel)) AS EducationLevel,
        lower(trim(MaritalStatus)) AS MaritalStatus, lower(trim(HomeOwnershipStatus)) AS HomeOwnershipStatus,
        CAST(BankruptcyHistory AS VARCHAR) AS BankruptcyHistory, lower(trim(LoanPurpose)) AS LoanPurpose,
        CAST(PreviousLoanDefaults AS VARCHAR) AS PreviousLoanDefaults, count(*) AS loans,
        count(DISTINCT PaymentHistory) AS payment_levels, count(DISTINCT UtilityBillsPaymentHistory) AS utility_levels
        FROM dirty GROUP BY ALL"""
    ),
)
def text_normalise(spark, sf_dir):
    df = contracts.normalise_text(loans_dirty(spark, sf_dir), UPLOAD_TEXT)
    keys = [c for c in UPLOAD_TEXT if c not in ("PaymentHistory", "UtilityBillsPaymentHistory")]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loans"),
        F.countDistinct("PaymentHistory").alias("payment_levels"),
        F.countDistinct("UtilityBillsPaymentHistory").alias("utility_levels"),
    )


@query(
    "c5_date_coercion",
    on_dirty(
        """SELECT row_id, coalesce(strftime(TRY_CAST(ApplicationDate AS DATE), '%Y-%m-%d'), '(none)') AS ApplicationDate
        FROM dirty"""
    ),
)
def date_coercion(spark, sf_dir):
    df = contracts.coerce_dates(loans_dirty(spark, sf_dir).select("row_id", "ApplicationDate"), UPLOAD_DATES)
    return df.select("row_id", F.coalesce(F.col("ApplicationDate").cast("string"), F.lit("(none)")).alias("ApplicationDate"))


@query(
    "c6_strict_types",
    on_dirty(
        f"""SELECT field, code, count(*) AS violations FROM (
          SELECT 'Age' AS field, CASE WHEN {_number('Age')} IS NULL OR {_number('Age')} <> floor({_number('Age')})
            THEN 'bad_type' END AS code FROM dirty
          UNION ALL SELECT 'CreditScore', CASE WHEN {_number('CreditScore')} IS NULL THEN 'bad_type' END FROM dirty
          UNION ALL SELECT 'LoanAmount', CASE WHEN LoanAmount IS NULL THEN 'missing'
            WHEN {_number('LoanAmount')} IS NULL THEN 'bad_type' END FROM dirty
          UNION ALL SELECT 'EmploymentStatus', CASE WHEN EmploymentStatus IS NULL THEN 'missing' END FROM dirty)
        WHERE code IS NOT NULL GROUP BY field, code"""
    ),
)
def strict_types(spark, sf_dir):
    rows = contracts.violation_rows(loans_dirty(spark, sf_dir), RAW_CONTRACT)
    typed = rows.filter(F.col("code").isin("bad_type", "missing"))
    return typed.groupBy("field", "code").agg(F.count(F.lit(1)).alias("violations"))


VIOLATIONS_SQL = f"""
found AS (
  SELECT row_id, 'Age' AS field, Age AS value, CASE
    WHEN {_number('Age')} IS NULL OR {_number('Age')} <> floor({_number('Age')}) THEN 'bad_type'
    WHEN {_number('Age')} < 18 THEN 'too_small' WHEN {_number('Age')} > 100 THEN 'too_large' END AS code FROM dirty
  UNION ALL SELECT row_id, 'CreditScore', CreditScore, CASE WHEN {_number('CreditScore')} IS NULL THEN 'bad_type'
    WHEN {_number('CreditScore')} < 300 THEN 'too_small' WHEN {_number('CreditScore')} > 850 THEN 'too_large' END
    FROM dirty
  UNION ALL SELECT row_id, 'EmploymentStatus', EmploymentStatus, CASE WHEN EmploymentStatus IS NULL THEN 'missing'
    WHEN replace(lower(EmploymentStatus), '-', '_') NOT IN ('employed', 'self_employed', 'unemployed')
    THEN 'bad_level' END FROM dirty
  UNION ALL SELECT row_id, 'LoanAmount', LoanAmount, CASE WHEN LoanAmount IS NULL THEN 'missing'
    WHEN {_number('LoanAmount')} <= 0 THEN 'too_small' END FROM dirty
  UNION ALL SELECT row_id, 'MonthlyIncome', MonthlyIncome,
    CASE WHEN {_number('MonthlyIncome')} <= 0 THEN 'too_small' END FROM dirty),
violations AS (SELECT * FROM found WHERE code IS NOT NULL)"""


@query(
    "c7_range_violations",
    on_dirty(
        "SELECT row_id, field, code, value FROM violations WHERE code IN ('too_small', 'too_large')", VIOLATIONS_SQL
    ),
)
def range_violations(spark, sf_dir):
    rows = contracts.violation_rows(loans_dirty(spark, sf_dir), RAW_CONTRACT)
    return rows.filter(F.col("code").isin("too_small", "too_large"))


@query(
    "c8_enum_levels",
    on_dirty(
        """SELECT coalesce(CASE replace(lower(EmploymentStatus), '-', '_') WHEN 'employed' THEN 'Employed'
          WHEN 'self_employed' THEN 'Self-Employed' WHEN 'unemployed' THEN 'Unemployed' END, '(unknown)')
          AS EmploymentStatus, EducationLevel, HomeOwnershipStatus, LoanPurpose, MaritalStatus, count(*) AS loans
        FROM dirty GROUP BY ALL"""
    ),
)
def enum_levels(spark, sf_dir):
    names = ["EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose", "MaritalStatus"]
    enums = [f for f in RAW_CONTRACT if f.name in names]
    typed = contracts.typed_rows(loans_dirty(spark, sf_dir).select("row_id", *names), enums)
    return typed.na.fill("(unknown)", names).groupBy(*names).agg(F.count(F.lit(1)).alias("loans"))


@query("c9_row_violations", on_dirty("SELECT row_id, field, code, value FROM violations", VIOLATIONS_SQL))
def row_violations(spark, sf_dir):
    return contracts.violation_rows(loans_dirty(spark, sf_dir), RAW_CONTRACT)


@query(
    "c9_valid_rows",
    on_dirty(
        f"""SELECT row_id, CAST(Age AS BIGINT) AS Age, CAST(CreditScore AS BIGINT) AS CreditScore,
        CASE EmploymentStatus WHEN 'self_employed' THEN 'Self-Employed' ELSE EmploymentStatus END AS EmploymentStatus,
        round(CAST(LoanAmount AS DOUBLE), 6) AS LoanAmount FROM dirty
        WHERE row_id NOT IN (SELECT row_id FROM violations)""",
        VIOLATIONS_SQL,
    ),
)
def valid_rows(spark, sf_dir):
    good, _ = contracts.split_valid(loans_dirty(spark, sf_dir), RAW_CONTRACT)
    return tidy(good.select("row_id", "Age", "CreditScore", "EmploymentStatus", "LoanAmount"))


@query(
    "c9_quarantine",
    on_dirty(
        """SELECT row_id, string_agg(field || ':' || code, ',' ORDER BY field) AS reasons, count(*) AS broken
        FROM violations GROUP BY row_id""",
        VIOLATIONS_SQL,
    ),
)
def quarantine(spark, sf_dir):
    _, bad = contracts.split_valid(loans_dirty(spark, sf_dir), RAW_CONTRACT)
    reasons = "array_join(array_sort(transform(violations, v -> concat(v.field, ':', v.code))), ',') AS reasons"
    return tidy(bad.selectExpr("row_id", reasons, "size(violations) AS broken"))


@query(
    "c9_first_invalid",
    on_dirty(
        "SELECT min(row_id) AS row_id, count(DISTINCT row_id) AS invalid_rows FROM violations", VIOLATIONS_SQL
    ),
)
def first_invalid(spark, sf_dir):
    return contracts.first_invalid(loans_dirty(spark, sf_dir), RAW_CONTRACT)


BUSINESS_SQL = f"""
business AS (
  SELECT row_id, 'Age' AS column_name, {_number('Age')} AS value, 'is outside the valid range (18-80)' AS message
    FROM dirty WHERE {_number('Age')} < 18 OR {_number('Age')} > 80
  UNION ALL SELECT row_id, 'CreditScore', {_number('CreditScore')}, 'is outside the valid range (300-850)' FROM dirty
    WHERE {_number('CreditScore')} < 300 OR {_number('CreditScore')} > 850
  UNION ALL SELECT row_id, 'LoanAmount', {_number('LoanAmount')}, 'must be a positive value' FROM dirty
    WHERE {_number('LoanAmount')} <= 0
  UNION ALL SELECT row_id, 'MonthlyIncome', {_number('MonthlyIncome')}, 'must be a positive value' FROM dirty
    WHERE {_number('MonthlyIncome')} <= 0)"""


@query(
    "c10_business_errors",
    on_dirty("SELECT row_id, column_name, round(value, 6) AS value, message FROM business", BUSINESS_SQL),
)
def business_errors(spark, sf_dir):
    df = contracts.coerce_numbers(loans_dirty(spark, sf_dir), UPLOAD_NUMERIC)
    return tidy(contracts.business_errors(df, UPLOAD_RULES))


_CLEAN_SQL = f"""
cleaned AS (
  SELECT * REPLACE ({_number('Age')} AS Age, {_number('CreditScore')} AS CreditScore,
    {_number('LoanAmount')} AS LoanAmount, {_number('MonthlyIncome')} AS MonthlyIncome,
    TRY_CAST(ApplicationDate AS DATE) AS ApplicationDate) FROM dirty)"""


def _nulls_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM {source}" for c in columns
    )


@query(
    "c11_upload_report",
    on_dirty(
        """SELECT 'is_valid' AS section, '' AS name, CAST(count(*) = 0 AS BIGINT) AS amount FROM business
        UNION ALL SELECT 'errors', column_name, count(*) FROM business GROUP BY column_name
        UNION ALL SELECT 'missing_values', column_name, missing FROM nulls
        UNION ALL SELECT 'warnings', column_name, 1 FROM nulls WHERE missing > 0""",
        BUSINESS_SQL,
        _CLEAN_SQL,
        f"nulls AS ({_nulls_sql('cleaned', [*RAW_COLUMNS, 'MaritalStatus'])})",
    ),
)
def upload_report(spark, sf_dir):
    return contracts.upload_report(
        loans_dirty(spark, sf_dir), RAW_COLUMNS, UPLOAD_NUMERIC, UPLOAD_TEXT, UPLOAD_DATES, UPLOAD_RULES
    )


@query(
    "c11_upload_report_structure",
    on_dirty(
        """SELECT section, name, CAST(amount AS BIGINT) AS amount, n AS input_rows
        FROM (VALUES ('is_valid', '', 0), ('missing_column', 'Age', 1)) t(section, name, amount),
        (SELECT count(*) AS n FROM dirty)"""
    ),
)
def upload_report_structure(spark, sf_dir):
    df = loans_dirty(spark, sf_dir).drop("Age")
    report = contracts.upload_report(df, RAW_COLUMNS, UPLOAD_NUMERIC, UPLOAD_TEXT, UPLOAD_DATES, UPLOAD_RULES)
    return report.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("input_rows"))))


@query(
    "c12_label_consistency",
    """SELECT (SELECT count(*) FROM documents) AS feature_rows, (SELECT count(*) FROM labels) AS label_rows,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS features_without_label,
    (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_without_features,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0
      AND (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS consistent""",
)
def label_consistency(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.label_consistency(documents.select("doc_id"), labels.select("doc_id"), "doc_id")


@query(
    "c13_null_counts",
    on_dirty(
        "SELECT * FROM nulls WHERE missing > 0", _CLEAN_SQL, f"nulls AS ({_nulls_sql('cleaned', RAW_COLUMNS)})"
    ),
)
def null_counts(spark, sf_dir):
    df = contracts.coerce_numbers(loans_dirty(spark, sf_dir), UPLOAD_NUMERIC)
    return quality.null_counts(contracts.coerce_dates(df, UPLOAD_DATES))


def _audit_sql(source, numbers, others=()):
    parts = [
        f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} = 0) AS zeros,
        round(100E0 * count(*) FILTER ({c} = 0) / count(*), 6) AS zero_percent,
        count(*) FILTER ({c} IS NULL) > 0 AS missing_flag,
        100E0 * count(*) FILTER ({c} = 0) / count(*) > 10 AS zero_flag FROM {source}"""
        for c in numbers
    ]
    parts += [
        f"""SELECT '{c}', count(*) FILTER ({c} IS NULL), 0, 0E0, count(*) FILTER ({c} IS NULL) > 0, false FROM {source}"""
        for c in others
    ]
    return " UNION ALL ".join(parts)


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("c14_zero_audit_lineitem", _audit_sql("lineitem", _LINE_NUMBERS, ["l_returnflag", "l_linestatus", "l_shipdate"]))
def zero_audit(spark, sf_dir):
    return tidy(quality.column_audit(table(spark, sf_dir, "lineitem")))


_TEXT = {"ApplicationDate", "EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"}


@query(
    "c14_zero_audit_loans",
    on_loans(_audit_sql("loans", [c for c in RAW_COLUMNS if c not in _TEXT], [c for c in RAW_COLUMNS if c in _TEXT])),
)
def zero_audit_loans(spark, sf_dir):
    return tidy(quality.column_audit(loans(spark, sf_dir).select(*RAW_COLUMNS)))


@query(
    "c16_impute",
    on_dirty(
        """SELECT row_id, round(coalesce(Age, (SELECT median(Age) FROM cleaned)), 6) AS Age,
        round(coalesce(CreditScore, (SELECT median(CreditScore) FROM cleaned)), 6) AS CreditScore,
        round(coalesce(LoanAmount, (SELECT median(LoanAmount) FROM cleaned)), 6) AS LoanAmount,
        coalesce(EmploymentStatus, (SELECT EmploymentStatus FROM cleaned WHERE EmploymentStatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS EmploymentStatus,
        strftime(coalesce(ApplicationDate, (SELECT ApplicationDate FROM cleaned WHERE ApplicationDate IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)), '%Y-%m-%d') AS ApplicationDate
        FROM cleaned""",
        _CLEAN_SQL,
    ),
)
def impute(spark, sf_dir):
    df = loans_dirty(spark, sf_dir).select(
        "row_id", "ApplicationDate", "Age", "CreditScore", "LoanAmount", "EmploymentStatus"
    )
    clean = contracts.coerce_dates(contracts.coerce_numbers(df, UPLOAD_NUMERIC), UPLOAD_DATES)
    filled = quality.impute(clean)
    return tidy(filled.withColumn("ApplicationDate", F.col("ApplicationDate").cast("string")))


@query(
    "c17_guarded_input",
    on_loans("SELECT HomeOwnershipStatus, count(*) AS loans FROM loans GROUP BY HomeOwnershipStatus"),
)
def guarded_input(spark, sf_dir):
    df = guard_input(loans(spark, sf_dir), RAW_COLUMNS)
    return df.groupBy("HomeOwnershipStatus").agg(F.count(F.lit(1)).alias("loans"))


@query(
    "c18_prediction_sanity",
    on_loans(
        """SELECT count(*) AS row_count, count(predicted) AS scored, round(min(predicted), 6) AS lowest,
        round(max(predicted), 6) AS highest, count(*) FILTER (predicted < 0 OR predicted > 100) AS out_of_range,
        count(*) = count(predicted) AND min(predicted) < max(predicted)
          AND count(*) FILTER (predicted < 0 OR predicted > 100) = 0 AS sane
        FROM scored WHERE model = 'three_factor'""",
        "scored AS (SELECT 'three_factor' AS model, 80 - 6E-2 * CreditScore + 12 * DebtToIncomeRatio"
        " + 10 * BankruptcyHistory AS predicted FROM loans)",
    ),
)
def prediction_sanity(spark, sf_dir):
    return tidy(quality.prediction_sanity(one_model(spark, sf_dir), "predicted"))


_CODES = {
    "EmploymentStatus": ["Employed", "Self-Employed", "Unemployed"],
    "EducationLevel": ["High School", "Associate", "Bachelor", "Master", "Doctorate"],
    "HomeOwnershipStatus": ["Own", "Rent", "Mortgage", "Other"],
    "LoanPurpose": ["Home", "Auto", "Education", "Debt Consolidation", "Other"],
}


@query(
    "c19_processed_contract",
    on_loans(
        """SELECT 'PaymentHistory' AS field, 'too_large' AS code, count(*) AS violations, min(PaymentHistory) AS lowest
        FROM loans WHERE PaymentHistory > 3 HAVING count(*) > 0
        UNION ALL SELECT 'HomeOwnershipStatus', 'too_small', count(*), -1 FROM loans
        WHERE HomeOwnershipStatus = 'Other' HAVING count(*) > 0"""
    ),
)
def processed_contract(spark, sf_dir):
    """Encoded loans; one home-ownership level is left unencoded (-1) so that it shows up."""

    def code(c):
        levels = [v for v in _CODES[c] if not (c == "HomeOwnershipStatus" and v == "Other")]
        whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels))
        return F.expr(f"bigint(CASE {c} {whens} ELSE -1 END)")

    encoded = loans(spark, sf_dir).withColumns({c: code(c) for c in _CODES})
    rows = contracts.violation_rows(settle(encoded, "encoded"), PROCESSED_CONTRACT)
    return rows.groupBy("field", "code").agg(
        F.count(F.lit(1)).alias("violations"), F.min(F.col("value").cast("bigint")).alias("lowest")
    )


@query(
    "c20_target_numeric",
    on_loans(
        """SELECT 'RiskScore' AS column_name, count(RiskScore) AS count, round(avg(RiskScore), 6) AS mean,
        round(stddev_samp(RiskScore), 6) AS std, round(min(RiskScore), 6) AS min,
        round(quantile_cont(RiskScore, 25E-2), 6) AS p25, round(quantile_cont(RiskScore, 5E-1), 6) AS p50,
        round(quantile_cont(RiskScore, 75E-2), 6) AS p75, round(max(RiskScore), 6) AS max FROM loans"""
    ),
)
def target_numeric(spark, sf_dir):
    return tidy(quality.target_check(loans(spark, sf_dir), "RiskScore"))


@query(
    "c20_target_shares",
    on_loans(
        """SELECT LoanPurpose AS value, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM loans), 6) AS share
        FROM loans GROUP BY LoanPurpose"""
    ),
)
def target_shares(spark, sf_dir):
    return tidy(quality.target_check(loans(spark, sf_dir), "LoanPurpose"))
