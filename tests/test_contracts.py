import pytest
from pyspark.sql import functions as F

from riskloom.operators import contracts
from riskloom.schema import RAW_COLUMNS, RAW_CONTRACT, UPLOAD_RULES, text_schema

# A row that keeps every rule, in the order of the contract.
GOOD = dict(
    ApplicationDate="2021-09-30", Age="52", AnnualIncome="48210.5", CreditScore="611", EmploymentStatus="Self-Employed",
    EducationLevel="Associate", Experience="23", LoanAmount="18900", LoanDuration="48", NumberOfDependents="4",
    HomeOwnershipStatus="Rent", MonthlyDebtPayments="333.25", CreditCardUtilizationRate="0.61",
    NumberOfOpenCreditLines="3", NumberOfCreditInquiries="0", DebtToIncomeRatio="0.18", BankruptcyHistory="1",
    LoanPurpose="Auto", PreviousLoanDefaults="1", PaymentHistory="27", LengthOfCreditHistory="9",
    SavingsAccountBalance="812.75", CheckingAccountBalance="97", TotalAssets="64000", TotalLiabilities="71500",
    MonthlyIncome="4017.54", UtilityBillsPaymentHistory="0.7", JobTenure="3", NetWorth="-7500",
    BaseInterestRate="0.21", InterestRate="0.235", MonthlyLoanPayment="611.9", TotalDebtToIncomeRatio="0.235",
)

# (field, value, expected code or None)
CASES = [
    ("Age", "18", None), ("Age", "100", None), ("Age", "17", "too_small"), ("Age", "101", "too_large"),
    ("CreditScore", "300", None), ("CreditScore", "850", None), ("CreditScore", "299", "too_small"),
    ("CreditScore", "851", "too_large"), ("Age", "25.0", None), ("Age", "25.5", "bad_type"), ("Age", "thirty", "bad_type"),
    ("Age", "1d", "bad_type"), ("LoanAmount", "1e5", None), ("LoanAmount", "NaN", "bad_type"),
    ("LoanAmount", "0", "too_small"), ("LoanAmount", "-1", "too_small"), ("LoanAmount", None, "missing"),
    ("TotalAssets", "99999999999999999999", "bad_type"), ("NetWorth", "-5", None), ("NetWorth", "9007199254740993", None),
    ("NetWorth", "9223372036854775807", None), ("NetWorth", "9223372036854775808", "bad_type"), ("NetWorth", "9210000000000000000", None),
    ("InterestRate", "1", None), ("InterestRate", "1.01", "too_large"), ("LoanDuration", "0", "too_small"),
    ("EmploymentStatus", "self_employed", None), ("EmploymentStatus", "SELF-EMPLOYED", None),
    ("EmploymentStatus", "self employed", "bad_level"), ("EmploymentStatus", " Employed", "bad_level"),
    ("EducationLevel", "  high school ", None), ("EducationLevel", "PhD", "bad_level"),
    ("ApplicationDate", "not-a-date", None), ("MaritalStatus", None, None), ("MaritalStatus", "it's open", "bad_level"),
]


@pytest.fixture(scope="module")
def rows(spark):
    columns = ["row_id", *RAW_COLUMNS, "MaritalStatus"]
    data = []
    for i, (field, value, _) in enumerate(CASES):
        row = {"row_id": str(i), "MaritalStatus": None, **GOOD, field: value}
        data.append([row[c] for c in columns])
    return spark.createDataFrame(data, text_schema(columns)).withColumn("row_id", F.col("row_id").cast("bigint"))


def test_codes(rows):
    found = {r["row_id"]: (r["field"], r["code"]) for r in contracts.violation_rows(rows, RAW_CONTRACT).collect()}
    want = {i: (f, code) for i, (f, _, code) in enumerate(CASES) if code}
    assert found == want


def test_split_keeps_every_row(rows):
    good, bad = contracts.split_valid(rows, RAW_CONTRACT)
    assert good.count() + bad.count() == len(CASES)
    typed = {r["row_id"]: r for r in good.collect()}
    assert typed[8]["Age"] == 25 and dict(good.dtypes)["Age"] == "bigint"
    big = next(i for i, c in enumerate(CASES) if c[1] == "9007199254740993")
    assert typed[big]["NetWorth"] == 9007199254740993
    levels = {typed[i]["EmploymentStatus"] for i, c in enumerate(CASES) if c[0] == "EmploymentStatus" and not c[2]}
    assert levels == {"Self-Employed"}
    assert all(None not in [r[c] for c in RAW_COLUMNS] for r in typed.values())


def test_array_and_rows_agree(rows):
    folded = contracts.with_violations(rows, RAW_CONTRACT).selectExpr("row_id", "inline(violations)")
    assert sorted(folded.collect()) == sorted(contracts.violation_rows(rows, RAW_CONTRACT).collect())


def test_columns_are_checked(rows):
    with pytest.raises(ValueError, match="missing"):
        contracts.check_columns(rows.drop("Age"), RAW_CONTRACT)
    extra = rows.withColumn("surprise", F.lit(1))
    with pytest.raises(ValueError, match="unknown"):
        contracts.check_columns(extra, RAW_CONTRACT)
    assert "surprise" not in contracts.check_columns(extra, RAW_CONTRACT, unknown="drop").columns


def test_upload_rules_let_nulls_pass(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, 81.0, 0.0), (3, 18.0, -1.0)], "row_id long, Age double, LoanAmount double")
    found = {(r["row_id"], r["column_name"]) for r in contracts.business_errors(df, UPLOAD_RULES).collect()}
    assert found == {(2, "Age"), (2, "LoanAmount"), (3, "LoanAmount")}
