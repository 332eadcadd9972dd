"""Row contracts. Each contract is a plain list of field rules."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # "int", "float", "text" or "enum"
    ge: float | None = None
    gt: float | None = None
    le: float | None = None
    levels: tuple[str, ...] = ()
    fold: str = ""  # how spellings are compared: "dash" or "trim"
    optional: bool = False
    message: str = ""  # what a user is told when the rule is broken

    @property
    def spark_type(self) -> T.DataType:
        return {"int": T.LongType(), "float": T.DoubleType()}.get(self.kind, T.StringType())


def integer(name, **k):
    return Field(name, "int", **k)


def number(name, **k):
    return Field(name, "float", **k)


def enum(name, levels, fold, **k):
    return Field(name, "enum", levels=levels, fold=fold, **k)


# ---- Fixed values: column order, levels, ranges of the loan application ----

EMPLOYMENT = ("Employed", "Self-Employed", "Unemployed")
HOME = ("Own", "Rent", "Mortgage", "Other")
PURPOSE = ("Home", "Auto", "Education", "Debt Consolidation", "Other")
EDUCATION = ("High School", "Associate", "Bachelor", "Master", "Doctorate")
MARITAL = ("Single", "Married", "Divorced", "Widowed")

RAW_CONTRACT = [
    Field("ApplicationDate", "text"),
    integer("Age", ge=18, le=100),
    number("AnnualIncome", gt=0),
    integer("CreditScore", ge=300, le=850),
    enum("EmploymentStatus", EMPLOYMENT, "dash"),
    enum("EducationLevel", EDUCATION, "trim"),
    integer("Experience", ge=0),
    number("LoanAmount", gt=0),
    integer("LoanDuration", gt=0),
    integer("NumberOfDependents", ge=0),
    enum("HomeOwnershipStatus", HOME, "dash"),
    number("MonthlyDebtPayments", ge=0),
    number("CreditCardUtilizationRate", ge=0, le=1),
    integer("NumberOfOpenCreditLines", ge=0),
    integer("NumberOfCreditInquiries", ge=0),
    number("DebtToIncomeRatio", ge=0),
    integer("BankruptcyHistory", ge=0, le=1),
    enum("LoanPurpose", PURPOSE, "dash"),
    integer("PreviousLoanDefaults", ge=0, le=1),
    integer("PaymentHistory"),
    integer("LengthOfCreditHistory", ge=0),
    number("SavingsAccountBalance", ge=0),
    number("CheckingAccountBalance", ge=0),
    integer("TotalAssets", ge=0),
    integer("TotalLiabilities", ge=0),
    number("MonthlyIncome", gt=0),
    number("UtilityBillsPaymentHistory", ge=0, le=1),
    integer("JobTenure", ge=0),
    integer("NetWorth"),
    number("BaseInterestRate", ge=0, le=1),
    number("InterestRate", ge=0, le=1),
    number("MonthlyLoanPayment", ge=0),
    number("TotalDebtToIncomeRatio", ge=0),
    enum("MaritalStatus", MARITAL, "trim", optional=True),
]

RAW_COLUMNS = [f.name for f in RAW_CONTRACT if not f.optional]
LABELS = ["LoanApproved", "RiskScore"]

# The file check of the upload form: other bounds, nulls pass, one message per row and column.
POSITIVE = "must be a positive value"
NOT_NEGATIVE = "cannot be negative"

UPLOAD_RULES = [
    number("Age", ge=18, le=80, message="is outside the valid range (18-80)"),
    number("CreditScore", ge=300, le=850, message="is outside the valid range (300-850)"),
    number("AnnualIncome", gt=0, message=POSITIVE),
    number("LoanAmount", gt=0, message=POSITIVE),
    number("MonthlyIncome", gt=0, message=POSITIVE),
    number("Experience", ge=0, message=NOT_NEGATIVE),
    number("LoanDuration", ge=0, message=NOT_NEGATIVE),
    number("NumberOfDependents", ge=0, message=NOT_NEGATIVE),
    number("MonthlyDebtPayments", ge=0, message=NOT_NEGATIVE),
    number("NumberOfOpenCreditLines", ge=0, message=NOT_NEGATIVE),
    number("NumberOfCreditInquiries", ge=0, message=NOT_NEGATIVE),
    number("LengthOfCreditHistory", ge=0, message=NOT_NEGATIVE),
    number("JobTenure", ge=0, message=NOT_NEGATIVE),
    number("CreditCardUtilizationRate", ge=0, le=100, message="should be between 0 and 100"),
    number("InterestRate", ge=0, le=100, message="should be between 0 and 100"),
    number("BaseInterestRate", ge=0, le=100, message="should be between 0 and 100"),
]

UPLOAD_NUMERIC = [
    "Age", "AnnualIncome", "CreditScore", "Experience", "LoanAmount", "LoanDuration",
    "NumberOfDependents", "MonthlyDebtPayments", "CreditCardUtilizationRate",
    "NumberOfOpenCreditLines", "NumberOfCreditInquiries", "DebtToIncomeRatio",
    "LengthOfCreditHistory", "SavingsAccountBalance", "CheckingAccountBalance",
    "TotalAssets", "TotalLiabilities", "MonthlyIncome", "JobTenure", "NetWorth",
    "BaseInterestRate", "InterestRate", "MonthlyLoanPayment", "TotalDebtToIncomeRatio",
]

UPLOAD_TEXT = [
    "EmploymentStatus", "EducationLevel", "MaritalStatus", "HomeOwnershipStatus",
    "BankruptcyHistory", "LoanPurpose", "PreviousLoanDefaults", "PaymentHistory",
    "UtilityBillsPaymentHistory",
]

UPLOAD_DATES = ["ApplicationDate"]

# The encoded row: whole-number categories, a bounded payment history, no base rate and total debt ratio.
PROCESSED_CONTRACT = [
    Field("ApplicationDate", "text"),
    integer("Age", ge=18, le=100),
    number("AnnualIncome", gt=0),
    integer("CreditScore", ge=300, le=850),
    integer("EmploymentStatus", ge=0),
    integer("EducationLevel", ge=0, le=4),
    integer("Experience", ge=0),
    number("LoanAmount", gt=0),
    integer("LoanDuration", gt=0),
    integer("NumberOfDependents", ge=0),
    integer("HomeOwnershipStatus", ge=0),
    number("MonthlyDebtPayments", ge=0),
    number("CreditCardUtilizationRate", ge=0, le=1),
    integer("NumberOfOpenCreditLines", ge=0),
    integer("NumberOfCreditInquiries", ge=0),
    number("DebtToIncomeRatio", ge=0),
    integer("BankruptcyHistory", ge=0, le=1),
    integer("LoanPurpose", ge=0),
    integer("PreviousLoanDefaults", ge=0, le=1),
    integer("PaymentHistory", ge=0, le=3),
    integer("LengthOfCreditHistory", ge=0),
    number("SavingsAccountBalance", ge=0),
    number("CheckingAccountBalance", ge=0),
    integer("TotalAssets", ge=0),
    integer("TotalLiabilities", ge=0),
    number("MonthlyIncome", gt=0),
    number("UtilityBillsPaymentHistory", ge=0, le=1),
    integer("JobTenure", ge=0),
    integer("NetWorth"),
    number("InterestRate", ge=0, le=1),
    number("MonthlyLoanPayment", ge=0),
]

# ---- end of fixed values ----


def text_schema(columns: list[str]) -> T.StructType:
    """All-text schema for files whose values are not trusted yet."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def require(contract: list[Field], **changes: dict) -> list[Field]:
    """A copy of ``contract`` with some fields altered, for example ``Age={"le": 80}``."""
    return [replace(f, **changes.get(f.name, {})) for f in contract]
