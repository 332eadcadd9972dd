"""Queries of the feature operators (D) and the per-step audit (C15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ops
from ..operators import runaudit, split
from ..operators.quality import modes
from ..schema import RAW_COLUMNS
from ..sources.tables import loans, table
from .catalog import on_loans, query, tidy


@query(
    "d1_date_parts_loans",
    on_loans(
        """SELECT row_id, year(CAST(ApplicationDate AS DATE)) AS applicationdate_year,
        month(CAST(ApplicationDate AS DATE)) AS applicationdate_month, day(CAST(ApplicationDate AS DATE))
        AS applicationdate_day, isodow(CAST(ApplicationDate AS DATE)) - 1 AS applicationdate_weekday FROM loans"""
    ),
)
def date_parts_loans(spark, sf_dir):
    df = loans(spark, sf_dir).select("row_id", "ApplicationDate")
    return tidy(ops.date_parts(df, "ApplicationDate", weekday=True))


@query(
    "d1_date_parts_lineitem",
    """SELECT year(l_shipdate) AS l_shipdate_year, month(l_shipdate) AS l_shipdate_month,
    day(l_shipdate) AS l_shipdate_day, count(*) AS lines FROM lineitem GROUP BY ALL""",
)
def date_parts_lineitem(spark, sf_dir):
    df = ops.date_parts(table(spark, sf_dir, "lineitem").select("l_shipdate"), "l_shipdate")
    return tidy(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("lines")))


def _divide(mode, fill):
    @query(
        f"d2_safe_divide_{mode}",
        f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
        round(CASE WHEN l_discount = 0 THEN {fill} ELSE l_tax / l_discount END, 6) AS ratio FROM lineitem""",
    )
    def run(spark, sf_dir):
        ratio = ops.safe_divide(F.col("l_tax"), F.col("l_discount"), mode).alias("ratio")
        return tidy(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ratio))


for _mode, _fill in {"zero": "0E0", "inf": "'Infinity'::DOUBLE", "nan": "NULL"}.items():
    _divide(_mode, _fill)


def _ratio(op, name, formula):
    @query(f"{op}_{name}", on_loans(f"SELECT row_id, round(CAST(CAST({formula} AS FLOAT) AS DOUBLE), 6) AS {name} FROM loans"))
    def run(spark, sf_dir):
        return tidy(loans(spark, sf_dir).select("row_id", ops.ratio_features()[name].alias(name)))


_ratio("d3", "liquidity_ratio", "(SavingsAccountBalance + CheckingAccountBalance) / MonthlyIncome")
_ratio("d4", "debt_burden", "MonthlyDebtPayments / MonthlyIncome")
_ratio("d6", "loan_to_income_ratio", "LoanAmount / AnnualIncome")


@query(
    "d5_payment_capacity",
    on_loans(
        """SELECT row_id, CAST(trunc(MonthlyIncome - MonthlyDebtPayments - MonthlyLoanPayment) AS BIGINT)
        AS payment_capacity FROM loans"""
    ),
)
def payment_capacity(spark, sf_dir):
    df = loans(spark, sf_dir)
    crafted = ops.CraftedFeatures.of(on_zero="zero").fit(df).transform(df)
    return tidy(crafted.select("row_id", "payment_capacity"))


@query(
    "d7_ordered_rank",
    on_loans(
        """SELECT CASE WHEN Age < 35 THEN 0 WHEN Age < 55 THEN 1 ELSE 2 END::BIGINT AS life_stage, count(*) AS loans
        FROM loans GROUP BY 1"""
    ),
)
def ordered_rank(spark, sf_dir):
    df = loans(spark, sf_dir).selectExpr("CASE WHEN Age < 35 THEN 'Young' WHEN Age < 55 THEN 'Middle' ELSE 'Senior' END AS s")
    ranked = df.select(ops.ordered_rank("s", ops.LIFE_STAGES).alias("life_stage"))
    return tidy(ranked.groupBy("life_stage").agg(F.count(F.lit(1)).alias("loans")))


def _poly_sql(a, b):
    return f"""round({a}, 6) AS "{a}", round({b}, 6) AS "{b}", round({a} * {a}, 6) AS "{a}^2",
    round({a} * {b}, 6) AS "{a}*{b}", round({b} * {b}, 6) AS "{b}^2" """


@query(
    "d8_polynomial_lineitem",
    f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_poly_sql('l_quantity', 'l_discount')} FROM lineitem",
)
def polynomial_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return tidy(ops.polynomial(df, ["l_quantity", "l_discount"]))


@query(
    "d8_polynomial_interactions",
    """SELECT l_orderkey, 1E0 AS bias, round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount,
    round(l_tax, 6) AS l_tax, round(l_quantity * l_discount, 6) AS "l_quantity*l_discount",
    round(l_quantity * l_tax, 6) AS "l_quantity*l_tax", round(l_discount * l_tax, 6) AS "l_discount*l_tax",
    round(l_quantity * l_discount * l_tax, 9) AS "l_quantity*l_discount*l_tax" FROM lineitem""",
)
def polynomial_interactions(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    made = ops.polynomial(df, ["l_quantity", "l_discount", "l_tax"], degree=3, bias=True, interaction_only=True)
    return tidy(made, digits=9)


@query(
    "d8_polynomial_loans",
    on_loans(
        "SELECT row_id, "
        + ", ".join(
            [f'CAST({a} AS DOUBLE) AS "{a}"' for a in ops.POLYNOMIAL_COLUMNS]
            + [
                f'CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) AS "{a if a == b else a}{"^2" if a == b else "*" + b}"'
                for i, a in enumerate(ops.POLYNOMIAL_COLUMNS)
                for b in ops.POLYNOMIAL_COLUMNS[i:]
            ]
        )
        + " FROM loans"
    ),
)
def polynomial_loans(spark, sf_dir):
    return ops.polynomial(loans(spark, sf_dir).select("row_id", *ops.POLYNOMIAL_COLUMNS))


@query(
    "d9_ordinal_encode",
    on_loans(
        """SELECT row_id, CASE EducationLevel WHEN 'High School' THEN 0 WHEN 'Associate' THEN 1 WHEN 'Bachelor' THEN 2
        WHEN 'Master' THEN 3 ELSE -1 END::BIGINT AS EducationLevel FROM loans"""
    ),
)
def ordinal_encode(spark, sf_dir):
    rank = ops.ordered_rank("EducationLevel", ["High School", "Associate", "Bachelor", "Master"], unknown=-1)
    return tidy(loans(spark, sf_dir).select("row_id", rank.alias("EducationLevel")))


def _hot(column, levels):
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1E0 ELSE 0E0 END AS \"{column}_{v}\"" for v in levels)


@query(
    "d10_one_hot_loans",
    on_loans(
        f"""SELECT row_id, {_hot('HomeOwnershipStatus', ['Other', 'Own', 'Rent'])},
        {_hot('EmploymentStatus', ['Self-Employed', 'Unemployed'])},
        {_hot('LoanPurpose', ['Debt Consolidation', 'Education', 'Home', 'Other'])} FROM loans"""
    ),
)
def one_hot_loans(spark, sf_dir):
    df = loans(spark, sf_dir).select("row_id", *ops.ONE_HOT_COLUMNS)
    return ops.CategoryEncoder.of(ordinal={}).fit(df).transform(df)


@query(
    "d10_one_hot_unseen",
    """SELECT p_partkey, p_size::BIGINT AS p_size, CASE WHEN p_type = (SELECT max(p_type) FROM part WHERE p_size < 5)
    THEN 1E0 ELSE 0E0 END AS last_type FROM part""",
)
def one_hot_unseen(spark, sf_dir):
    """Levels are learned from the small parts; every part is encoded with them."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    made = ops.CategoryEncoder.of(one_hot=["p_type"], ordinal={}).fit(df.filter("p_size < 5")).transform(df)
    return tidy(made.select("p_partkey", "p_size", F.col(made.columns[-1]).alias("last_type")))


@query(
    "d11_most_frequent",
    on_loans(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS most_frequent, count(*) AS loans FROM loans
            GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
            for c in ops.ONE_HOT_COLUMNS
        )
    ),
)
def most_frequent(spark, sf_dir):
    df = loans(spark, sf_dir).select(*ops.ONE_HOT_COLUMNS)
    found = spark.createDataFrame(list(modes(df, ops.ONE_HOT_COLUMNS).items()), "column_name string, most_frequent string")
    cells = df.unpivot([], ops.ONE_HOT_COLUMNS, "column_name", "most_frequent")
    return cells.join(F.broadcast(found), ["column_name", "most_frequent"]).groupBy("column_name", "most_frequent").agg(
        F.count(F.lit(1)).alias("loans")
    )


def _types_sql(source, whole, real, text):
    parts = []
    for c in whole:
        parts.append(
            f"""SELECT '{c}' AS column_name, CASE WHEN count({c}) < count(*) THEN 'bigint'
            WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
            WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
            WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS chosen_type
            FROM {source}"""
        )
    for c in real:
        parts.append(
            f"""SELECT '{c}', CASE WHEN count(*) FILTER (abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE)) >
            1E-5 + 1E-5 * abs(CAST(CAST({c} AS FLOAT) AS DOUBLE))) = 0 THEN 'float' ELSE 'double' END FROM {source}"""
        )
    for c in text:
        parts.append(
            f"""SELECT '{c}', CASE WHEN count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 5E-1 THEN 'category'
            ELSE 'string' END FROM {source}"""
        )
    return " UNION ALL ".join(parts)


@query(
    "d12_types_lineitem",
    _types_sql(
        "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"],
    ),
)
def types_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return ops.TypeOptimizer.of(fixed={}).fit(df).chosen_types(df)


@query(
    "d12_types_customer",
    _types_sql("customer", ["c_custkey", "c_nationkey"], ["c_acctbal"], ["c_name", "c_mktsegment"]),
)
def types_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return ops.TypeOptimizer.of().fit(df).chosen_types(df)


@query(
    "d12_types_applied",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 6)
    AS l_extendedprice, round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 6) AS l_discount, l_returnflag FROM lineitem""",
)
def types_applied(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag")
    return tidy(ops.TypeOptimizer.of(fixed={}).fit(df).transform(df))


def _narrowest_sql(source, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CASE WHEN count({c}) = count(*) AND count(*) FILTER ({c} <> floor({c})) = 0 THEN
          CASE WHEN max({c}) <= 127 AND min({c}) >= -128 THEN 'tinyint' WHEN max({c}) <= 32767 AND min({c}) >= -32768
          THEN 'smallint' WHEN max({c}) <= 2147483647 AND min({c}) >= -2147483648 THEN 'int' ELSE 'bigint' END
          ELSE 'float' END AS chosen_type FROM {source}"""
        for c in columns
    )


@query(
    "d13_narrow_whole_reals",
    _narrowest_sql("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
)
def narrow_whole_reals(spark, sf_dir):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return ops.narrowest_types(table(spark, sf_dir, "lineitem"), columns)


@query(
    "d13_narrow_signed",
    """SELECT min(p_size)::BIGINT AS lowest, max(p_size)::BIGINT AS highest, sum(p_size)::BIGINT AS total,
    CASE WHEN min(p_size) >= -128 AND max(p_size) <= 127 THEN 'tinyint' WHEN max(p_size) <= 32767 THEN 'smallint'
    ELSE 'int' END AS kind FROM part""",
)
def narrow_signed(spark, sf_dir):
    """Only signed widths: there are no unsigned types, the next wider one takes their place."""
    df = table(spark, sf_dir, "part").select("p_size")
    made = ops.TypeOptimizer.of(fixed={}).fit(df).transform(df)
    return tidy(
        made.agg(F.min("p_size").alias("lowest"), F.max("p_size").alias("highest"), F.sum("p_size").alias("total")).withColumn(
            "kind", F.lit(dict(made.dtypes)["p_size"])
        )
    )


@query(
    "d14_size_report",
    """SELECT 'c_custkey' AS column_name, 'bigint' AS column_type, 8 * count(*) AS bytes FROM customer
    UNION ALL SELECT 'c_name', 'string', sum(strlen(c_name))::BIGINT FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', 4 * count(*) FROM customer
    UNION ALL SELECT 'c_acctbal', 'double', 8 * count(*) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', sum(strlen(c_mktsegment))::BIGINT FROM customer""",
)
def size_report(spark, sf_dir):
    return ops.logical_size(table(spark, sf_dir, "customer"))


@query(
    "d14_size_saving",
    """SELECT round(32E0 * count(*) / 1048576, 6) AS mb_before, round(16E0 * count(*) / 1048576, 6) AS mb_after,
    50E0 AS percent_saved FROM lineitem""",
)
def size_saving(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return tidy(ops.size_saving(df, ops.TypeOptimizer.of(fixed={}).fit(df).transform(df)))


@query(
    "d15_category_codes",
    on_loans("SELECT row_id, TRY_CAST(Age AS TINYINT)::BIGINT AS Age, BankruptcyHistory FROM loans"),
)
def category_codes(spark, sf_dir):
    df = loans(spark, sf_dir).selectExpr("row_id", "string(Age) AS Age", "string(BankruptcyHistory) AS BankruptcyHistory")
    return tidy(ops.category_codes(df, ["Age", "BankruptcyHistory"]))


# Raw columns that the whole pipeline hands on under their own names.
_PASSED = [
    c for c in RAW_COLUMNS
    if c not in ("ApplicationDate", "EducationLevel", *ops.ONE_HOT_COLUMNS, *ops.POLYNOMIAL_COLUMNS)
]


def _pipeline_model(df):
    features = df.select(*RAW_COLUMNS)
    return ops.build_pipeline(features).fit(features)


@query(
    "d16_pipeline_columns",
    on_loans(
        """SELECT unnest(["""
        + ", ".join(
            f"'{c}'"
            for c in [
                *_PASSED, "EducationLevel", "applicationdate_year", "applicationdate_month", "applicationdate_day",
                "liquidity_ratio", "debt_burden", "payment_capacity", "loan_to_income_ratio",
                *ops.polynomial_products(ops.POLYNOMIAL_COLUMNS),
                "HomeOwnershipStatus_Other", "HomeOwnershipStatus_Own", "HomeOwnershipStatus_Rent",
                "EmploymentStatus_Self-Employed", "EmploymentStatus_Unemployed", "LoanPurpose_Debt Consolidation",
                "LoanPurpose_Education", "LoanPurpose_Home", "LoanPurpose_Other",
            ]
        )
        + "]) AS column_name, (SELECT count(*) FROM loans) AS rows_out"
    ),
)
def pipeline_columns(spark, sf_dir):
    df = loans(spark, sf_dir)
    made = _pipeline_model(df).transform(df.select(*RAW_COLUMNS))
    size = made.agg(F.count(F.lit(1)).alias("rows_out"))
    return size.select(F.explode(F.array(*[F.lit(c) for c in made.columns])).alias("column_name"), "rows_out")


TEST_ROWS = "CAST('0x' || substr(md5('42:' || row_id), 1, 8) AS BIGINT) % 100 < 20"


@query(
    "d17_fit_train_transform_all",
    on_loans(
        f"""SELECT CASE WHEN {TEST_ROWS} THEN 'test' ELSE 'train' END AS split, count(*) AS row_count,
        sum(Age)::BIGINT AS age, sum(month(CAST(ApplicationDate AS DATE)))::BIGINT AS months,
        sum(CASE WHEN LoanPurpose = 'Home' THEN 1 ELSE 0 END)::BIGINT AS home,
        sum(CASE EducationLevel WHEN 'High School' THEN 0 WHEN 'Associate' THEN 1 WHEN 'Bachelor' THEN 2
          WHEN 'Master' THEN 3 ELSE 4 END)::BIGINT AS education,
        sum(CAST(trunc(MonthlyIncome - MonthlyDebtPayments - MonthlyLoanPayment) AS BIGINT))::BIGINT AS capacity
        FROM loans GROUP BY 1"""
    ),
)
def fit_train_transform_all(spark, sf_dir):
    marked = split.with_split(loans(spark, sf_dir).select("row_id", *RAW_COLUMNS))
    train = marked.filter("split = 'train'").select(*RAW_COLUMNS)
    keyed = [*RAW_COLUMNS, "row_id", "split"]
    model = ops.build_pipeline(train, expected=keyed).fit(train)
    made = model.transform(marked)
    return tidy(
        made.groupBy("split").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("Age").alias("age"),
            F.sum("applicationdate_month").alias("months"), F.sum("LoanPurpose_Home").cast("bigint").alias("home"),
            F.sum("EducationLevel").alias("education"), F.sum("payment_capacity").alias("capacity"),
        )
    )


def _fitted_run(spark, sf_dir):
    """All rows with their split, and the pipeline fitted on the training ones."""
    marked = split.with_split(loans(spark, sf_dir).select("row_id", *RAW_COLUMNS, "LoanApproved", "RiskScore"))
    train = marked.filter("split = 'train'").select(*RAW_COLUMNS, "LoanApproved")
    return marked, ops.build_pipeline(train, drop=["LoanApproved"]).fit(train)


# Text of a row as given; the other 29 columns are numbers of 8 bytes.
_TEXT = ["ApplicationDate", "EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"]


@query(
    "d18_run_summary",
    on_loans(
        f"""SELECT CASE WHEN {TEST_ROWS} THEN 'test' ELSE 'train' END AS split, count(RiskScore) AS count,
        round(avg(RiskScore), 6) AS mean, round(stddev_samp(RiskScore), 6) AS std, round(min(RiskScore), 6) AS min,
        round(quantile_cont(RiskScore, 25E-2), 6) AS p25, round(quantile_cont(RiskScore, 5E-1), 6) AS p50,
        round(quantile_cont(RiskScore, 75E-2), 6) AS p75, round(max(RiskScore), 6) AS max,
        CAST(35 AS BIGINT) AS raw_columns, 'RiskScore' AS target, 'LoanApproved' AS removed,
        count(*) AS split_rows, count(*) AS processed_rows, CAST(60 AS BIGINT) AS processed_columns,
        CAST(sum(8 * 29 + {' + '.join(f'strlen({c})' for c in _TEXT)}) AS BIGINT) AS split_bytes,
        'ColumnDropper,DateParts,CraftedFeatures,Polynomial,CategoryEncoder,TypeOptimizer' AS steps
        FROM loans GROUP BY 1"""
    ),
)
def run_summary(spark, sf_dir):
    marked, model = _fitted_run(spark, sf_dir)
    shapes = runaudit.run_summary(marked, model, "RiskScore").drop("processed_bytes")
    return tidy(split.split_stats(marked, "RiskScore").join(shapes, "split"))


# The pipeline's steps in SQL, each on the one before it.
_DUMMIES = {
    "HomeOwnershipStatus": ["Other", "Own", "Rent"],
    "EmploymentStatus": ["Self-Employed", "Unemployed"],
    "LoanPurpose": ["Debt Consolidation", "Education", "Home", "Other"],
}
_POWERS = ["AnnualIncome", "CreditScore", "TotalAssets", "TotalLiabilities", "NetWorth"]
_STEP_SQL = [
    f"s0 AS (SELECT * EXCLUDE (row_id, MaritalStatus, RiskScore), CASE WHEN {TEST_ROWS} THEN 'test' ELSE 'train' END AS data FROM loans)",
    "s1 AS (SELECT * EXCLUDE LoanApproved FROM s0)",
    """s2 AS (SELECT * EXCLUDE ApplicationDate, year(CAST(ApplicationDate AS DATE)) AS applicationdate_year,
    month(CAST(ApplicationDate AS DATE)) AS applicationdate_month, day(CAST(ApplicationDate AS DATE)) AS applicationdate_day FROM s1)""",
    """s3 AS (SELECT *, (SavingsAccountBalance + CheckingAccountBalance) / MonthlyIncome AS liquidity_ratio,
    MonthlyDebtPayments / MonthlyIncome AS debt_burden,
    CAST(trunc(MonthlyIncome - MonthlyDebtPayments - MonthlyLoanPayment) AS BIGINT) AS payment_capacity,
    LoanAmount / AnnualIncome AS loan_to_income_ratio FROM s2)""",
    "s4 AS (SELECT *, "
    + ", ".join(
        f'CAST({a} AS DOUBLE) * {b} AS "{a}^2"' if a == b else f'CAST({a} AS DOUBLE) * {b} AS "{a}*{b}"'
        for i, a in enumerate(_POWERS)
        for b in _POWERS[i:]
    )
    + " FROM s3)",
    """s5 AS (SELECT * EXCLUDE (HomeOwnershipStatus, EmploymentStatus, LoanPurpose, EducationLevel),
    CASE EducationLevel WHEN 'High School' THEN 0 WHEN 'Associate' THEN 1 WHEN 'Bachelor' THEN 2 WHEN 'Master' THEN 3
    ELSE 4 END AS EducationLevel, """
    + ", ".join(f"""CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS "{c}_{v}\"""" for c, levels in _DUMMIES.items() for v in levels)
    + " FROM s4)",
    "s6 AS (SELECT * FROM s5)",
]
_STEP_NAMES = [
    "input", "1 ColumnDropper", "2 DateParts", "3 CraftedFeatures", "4 Polynomial", "5 CategoryEncoder", "6 TypeOptimizer",
]


@query(
    "c15_step_audit",
    on_loans(
        " UNION ALL ".join(
            f"""SELECT data, '{name}' AS step, column_name, count(*) AS row_count, count(*) FILTER (v IS NULL) AS missing,
            count(*) FILTER (TRY_CAST(v AS DOUBLE) = 0) AS zeros,
            round(100E0 * count(*) FILTER (TRY_CAST(v AS DOUBLE) = 0) / count(*), 6) AS zero_percent,
            count(*) FILTER (v IS NULL) > 0 AS missing_flag,
            100E0 * count(*) FILTER (TRY_CAST(v AS DOUBLE) = 0) / count(*) > 10 AS zero_flag
            FROM (SELECT data, CAST(COLUMNS(* EXCLUDE data) AS VARCHAR) FROM s{k})
                 UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(* EXCLUDE data))) GROUP BY data, column_name"""
            for k, name in enumerate(_STEP_NAMES)
        ),
        *_STEP_SQL,
    ),
)
def step_audit(spark, sf_dir):
    marked, model = _fitted_run(spark, sf_dir)
    return tidy(runaudit.audit_run(marked, model, carried=("row_id", "RiskScore")).drop("step_no", "column_no", "bytes"))
