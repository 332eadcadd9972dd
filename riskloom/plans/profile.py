"""Queries of the profiling operators (F)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import profile as ops
from ..operators.columns import resolve_score_column
from ..schema import RAW_COLUMNS
from ..session import settle
from ..sources.tables import loans, table
from .catalog import on_loans, query, tidy
from .predictions import MODELS

TEXT = ["ApplicationDate", "EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"]
LOAN_NUMBERS = [c for c in RAW_COLUMNS if c not in TEXT]
LINE_NUMBERS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts):
    return " UNION ALL ".join(parts)


def describe_sql(source, columns):
    return union(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
        round(quantile_cont(CAST({c} AS DOUBLE), 25E-2), 6) AS p25,
        round(quantile_cont(CAST({c} AS DOUBLE), 5E-1), 6) AS p50,
        round(quantile_cont(CAST({c} AS DOUBLE), 75E-2), 6) AS p75,
        round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {source}"""
        for c in columns
    )


@query("f1_describe_loans", on_loans(describe_sql("loans", LOAN_NUMBERS)))
def describe_loans(spark, sf_dir):
    return tidy(ops.describe(loans(spark, sf_dir), LOAN_NUMBERS))


@query("f1_describe_lineitem", describe_sql("lineitem", LINE_NUMBERS))
def describe_lineitem(spark, sf_dir):
    return tidy(ops.describe(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query("f1_describe_customer", describe_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def describe_customer(spark, sf_dir):
    return tidy(ops.describe(table(spark, sf_dir, "customer")))


@query("f2_value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return ops.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "f2_value_shares",
    """SELECT o_orderpriority AS value, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM orders), 6) AS share
    FROM orders GROUP BY o_orderpriority""",
)
def value_shares(spark, sf_dir):
    return tidy(ops.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority", normalize=True))


@query(
    "f3_target_correlation",
    on_loans(
        union(
            f"SELECT '{c}' AS column_name, round(corr(CAST({c} AS DOUBLE), RiskScore), 6) AS correlation FROM loans"
            for c in LOAN_NUMBERS
        )
    ),
)
def target_correlation(spark, sf_dir):
    found = ops.target_correlation(loans(spark, sf_dir), "RiskScore", LOAN_NUMBERS)
    return tidy(found.orderBy(F.desc("correlation")))


def pearson_sql(source, columns):
    return union(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)
        AS correlation FROM {source}"""
        for a, b in combinations(columns, 2)
    )


@query("f4_pearson_loans", on_loans(pearson_sql("loans", [*LOAN_NUMBERS, "RiskScore"])))
def pearson_loans(spark, sf_dir):
    return tidy(ops.pearson_matrix(loans(spark, sf_dir), [*LOAN_NUMBERS, "RiskScore"]))


@query("f4_pearson_lineitem", pearson_sql("lineitem", LINE_NUMBERS))
def pearson_lineitem(spark, sf_dir):
    return tidy(ops.pearson_matrix(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


SPEARMAN_COLUMNS = [
    "CreditScore", "AnnualIncome", "LoanAmount", "DebtToIncomeRatio", "BankruptcyHistory", "NetWorth", "RiskScore",
]


def ranks_cte(source, columns):
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2E0 AS {c}" for c in columns
    )
    return f"ranked AS (SELECT {ranks} FROM {source})"


@query("f5_spearman_loans", on_loans(pearson_sql("ranked", SPEARMAN_COLUMNS), ranks_cte("loans", SPEARMAN_COLUMNS)))
def spearman_loans(spark, sf_dir):
    return tidy(ops.spearman_matrix(loans(spark, sf_dir), SPEARMAN_COLUMNS))


_LINE_RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "f5_spearman_lineitem",
    f"WITH {ranks_cte('lineitem', _LINE_RANKED)} {pearson_sql('ranked', _LINE_RANKED)}",
)
def spearman_lineitem(spark, sf_dir):
    # Line items have no key of their own: number them once, in a written table that stays put.
    lines = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("row_id"), *_LINE_RANKED)
    return tidy(ops.spearman_matrix(settle(lines, "lines"), _LINE_RANKED))


_GAPPY = {
    "nation": "c_nationkey",
    "balance": "CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END",
    "reversed": "CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal END",
}


def _pair_ranks(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2E0"
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(ra, rb), 6) AS correlation FROM (
      SELECT {rank.format(a)} AS ra, {rank.format(b)} AS rb FROM gappy WHERE {both})"""


@query(
    "f5_spearman_nulls",
    f"""WITH gappy AS (SELECT c_custkey, {', '.join(f'{sql} AS {c}' for c, sql in _GAPPY.items())} FROM customer)
    {union(_pair_ranks(a, b) for a, b in combinations(_GAPPY, 2))}""",
)
def spearman_nulls(spark, sf_dir):
    """Every pair is ranked over the rows that hold both sides."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{sql} AS {c}" for c, sql in _GAPPY.items()])
    return tidy(ops.spearman_matrix(rows, list(_GAPPY), "c_custkey"))


CATEGORIES = ["EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"]
ASSOCIATED = ["CreditScore", "LoanAmount", "RiskScore"]


def bin_sql(c, bins=10, source="loans"):
    low, high = f"(SELECT min({c}) FROM {source})", f"(SELECT max({c}) FROM {source})"
    return f"CAST(least(floor(({c} - {low}) / (CAST({high} AS DOUBLE) - {low}) * {bins}) + 1, {bins}) AS BIGINT)"


def cramers_sql(source, a, b):
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, 'cramers_v' AS method, round(sqrt(
      greatest(0, s - 1 - (k - 1) * (r - 1) / (n - 1)) /
      (least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1)), 6) AS association
    FROM (SELECT sum(o * o / (CAST(ra AS DOUBLE) * cb)) AS s, CAST(sum(o) AS DOUBLE) AS n, count(DISTINCT la) AS r,
            count(DISTINCT lb) AS k FROM (
      SELECT la, lb, o, sum(o) OVER (PARTITION BY la) AS ra, sum(o) OVER (PARTITION BY lb) AS cb
      FROM (SELECT {a} AS la, {b} AS lb, count(*) AS o FROM {source} GROUP BY 1, 2)))"""


@query(
    "f6_association_auto",
    on_loans(
        union(
            [
                f"""SELECT '{a}' AS column_a, '{b}' AS column_b, 'spearman' AS method, round(corr({a}, {b}), 6)
                AS association FROM ranked"""
                for a, b in combinations(ASSOCIATED, 2)
            ]
            + [cramers_sql("binned", a, b) for a, b in combinations([*CATEGORIES, *ASSOCIATED], 2) if a in CATEGORIES]
        ),
        ranks_cte("loans", ASSOCIATED),
        f"binned AS (SELECT {', '.join(CATEGORIES)}, {', '.join(f'{bin_sql(c)} AS {c}' for c in ASSOCIATED)} FROM loans)",
    ),
)
def association_auto(spark, sf_dir):
    return tidy(ops.association_matrix(loans(spark, sf_dir), ASSOCIATED, CATEGORIES))


INTERACTIONS = ["CreditScore", "DebtToIncomeRatio", "AnnualIncome", "LoanAmount"]


@query(
    "f7_target_interactions",
    on_loans(
        union(
            f"""SELECT '{c}' AS column_name, {bin_sql(c)} AS feature_bin, {bin_sql('RiskScore')} AS target_bin,
            count(*) AS row_count, round(avg(RiskScore), 6) AS mean_target FROM loans GROUP BY 1, 2, 3"""
            for c in INTERACTIONS
        )
    ),
)
def target_interactions(spark, sf_dir):
    return tidy(ops.target_interactions(loans(spark, sf_dir), "RiskScore", INTERACTIONS))


def profile_sql(source, key, columns):
    def q(c, p):
        return f"quantile_cont(CAST({c} AS DOUBLE), {p})"

    return union(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, count(*) FILTER ({c} IS NULL) AS missing,
        count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
        round(CAST(max({c}) AS DOUBLE), 6) AS max, round(CAST(max({c}) - min({c}) AS DOUBLE), 6) AS range,
        round(stddev_samp({c}) / avg({c}), 6) AS cv, round(skewness(CAST({c} AS DOUBLE)), 6) AS skewness,
        round(kurtosis(CAST({c} AS DOUBLE)), 6) AS kurtosis,
        round({q(c, '5E-2')}, 6) AS p5, round({q(c, '25E-2')}, 6) AS p25, round({q(c, '5E-1')}, 6) AS p50,
        round({q(c, '75E-2')}, 6) AS p75, round({q(c, '95E-2')}, 6) AS p95,
        round({q(c, '75E-2')} - {q(c, '25E-2')}, 6) AS iqr, round(mad(CAST({c} AS DOUBLE)), 6) AS mad,
        round(CAST(printf('%.8e', CAST(sum({c}) AS DOUBLE)) AS DOUBLE), 6) AS sum,
        round(CAST(printf('%.8e', var_samp({c})) AS DOUBLE), 6) AS variance,
        count(DISTINCT {c}) AS distinct_values,
        (SELECT count(*) FROM (SELECT 1 FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1))
          AS unique_values,
        (SELECT coalesce(min(d) >= 0, true) FROM (SELECT {c} - lag({c}) OVER (ORDER BY {key}) AS d FROM {source}))
          AS rising,
        (SELECT coalesce(max(d) <= 0, true) FROM (SELECT {c} - lag({c}) OVER (ORDER BY {key}) AS d FROM {source}))
          AS falling
        FROM {source}"""
        for c in columns
    )


def nine_digits(df, *columns):
    """Sums of reals differ in their last digits with the order of the rows."""
    return df.withColumns({c: F.format_string("%.8e", F.col(c)).cast("double") for c in columns})


PROFILED = ["AnnualIncome", "CreditScore", "LoanAmount", "DebtToIncomeRatio", "NumberOfDependents", "BankruptcyHistory", "RiskScore"]


@query("f8_profile_loans", on_loans(profile_sql("loans", "row_id", PROFILED)))
def profile_loans(spark, sf_dir):
    df = loans(spark, sf_dir).select("row_id", *PROFILED)
    return tidy(nine_digits(ops.variable_profile(df, "row_id", PROFILED), "sum", "variance"))


@query("f8_profile_events", profile_sql("events", "event_id", ["user_id", "value"]))
def profile_events(spark, sf_dir):
    return tidy(nine_digits(ops.variable_profile(table(spark, sf_dir, "events"), "event_id"), "sum", "variance"))


@query("f8_profile_customer", profile_sql("customer", "c_custkey", ["c_nationkey", "c_acctbal"]))
def profile_customer(spark, sf_dir):
    return tidy(nine_digits(ops.variable_profile(table(spark, sf_dir, "customer"), "c_custkey"), "sum", "variance"))


def frequent_sql(source, columns, k):
    return union(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place FROM {source} WHERE {c} IS NOT NULL
        GROUP BY {c}) WHERE place <= {k}"""
        for c in columns
    )


@query("f9_frequent_part", frequent_sql("part", ["p_name", "p_brand", "p_type", "p_size"], 10))
def frequent_part(spark, sf_dir):
    return tidy(ops.frequent_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"], 10))


@query("f9_frequent_loans", on_loans(frequent_sql("loans", [*CATEGORIES, "Age", "CreditScore"], 5)))
def frequent_loans(spark, sf_dir):
    return tidy(ops.frequent_values(loans(spark, sf_dir), [*CATEGORIES, "Age", "CreditScore"], 5))


@query(
    "f9_extreme_lineitem",
    union(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, round(CAST({c} AS DOUBLE), 6) AS value, count(*) AS n,
        row_number() OVER (ORDER BY {c} {way}) AS place, '{side}' AS side FROM lineitem GROUP BY {c}) WHERE place <= 5"""
        for c in ("l_extendedprice", "l_quantity")
        for side, way in (("lowest", "ASC"), ("highest", "DESC"))
    ),
)
def extreme_lineitem(spark, sf_dir):
    return tidy(ops.extreme_values(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], 5))


@query(
    "f10_duplicate_rows",
    """SELECT text, lang, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1""",
)
def duplicate_rows(spark, sf_dir):
    return ops.duplicate_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


@query(
    "f10_duplicate_summary",
    """SELECT sum(n)::BIGINT AS row_count, (sum(n) - count(*))::BIGINT AS duplicates,
    count(*) FILTER (n > 1) AS groups, round(100E0 * (sum(n) - count(*)) / sum(n), 6) AS duplicate_percent
    FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_brand, p_type, p_size)""",
)
def duplicate_summary(spark, sf_dir):
    names = ["p_name", "p_brand", "p_type", "p_size"]
    return tidy(ops.duplicate_summary(table(spark, sf_dir, "part").select(*names), names))


def histogram_sql(source, column, bins, low, high):
    return f"""counted AS (SELECT CAST(CASE WHEN {column} < {low} THEN 0 WHEN {column} > {high} THEN {bins + 1}
      ELSE least(floor({bins} * ({column} - {low}) / (({high} - {low}) * 1E0)) + 1, {bins}) END
      AS BIGINT) AS bin, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT i AS bin, CASE WHEN i > 0 THEN round({low} + (i - 1) * (({high} - {low}) * 1E0 / {bins}), 6) END AS bin_start,
      CASE WHEN i <= {bins} THEN round({low} + i * (({high} - {low}) * 1E0 / {bins}), 6) END AS bin_end,
      coalesce(n, 0) AS n
    FROM range(0, {bins + 2}) t(i) LEFT JOIN counted ON bin = i"""


@query("f11_histogram_scores", on_loans("SELECT * FROM (WITH " + histogram_sql("loans", "RiskScore", 30, 0, 100) + ")"))
def histogram_scores(spark, sf_dir):
    return tidy(ops.histogram(loans(spark, sf_dir), "RiskScore"))


@query("f11_histogram_events", "WITH " + histogram_sql("events", "value", 50, 0, 100))
def histogram_events(spark, sf_dir):
    return tidy(ops.histogram(table(spark, sf_dir, "events"), "value", bins=50))


def fences_cte(source, column):
    return f"""quarters AS (SELECT quantile_cont({column}, 25E-2) AS q1, quantile_cont({column}, 5E-1) AS q2,
      quantile_cont({column}, 75E-2) AS q3 FROM {source}),
    fences AS (SELECT *, q1 - 15E-1 * (q3 - q1) AS low, q3 + 15E-1 * (q3 - q1) AS high FROM quarters)"""


@query(
    "f12_box_events",
    f"""WITH {fences_cte('events', 'value')}
    SELECT round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
      round(any_value(low), 6) AS lower_fence, round(any_value(high), 6) AS upper_fence,
      round(min(value) FILTER (value >= low), 6) AS lower_whisker,
      round(max(value) FILTER (value <= high), 6) AS upper_whisker,
      count(*) FILTER (value < low OR value > high) AS outliers FROM events, fences""",
)
def box_events(spark, sf_dir):
    return tidy(ops.box_stats(table(spark, sf_dir, "events"), "value"))


@query(
    "f12_box_outliers",
    on_loans(
        """SELECT row_id, round(CAST(NetWorth AS DOUBLE), 6) AS NetWorth FROM loans, fences
        WHERE NetWorth < low OR NetWorth > high""",
        fences_cte("loans", "CAST(NetWorth AS DOUBLE)"),
    ),
)
def box_outliers(spark, sf_dir):
    df = loans(spark, sf_dir).select("row_id", F.col("NetWorth").cast("double").alias("NetWorth"))
    return tidy(ops.box_outliers(df, "NetWorth"))


@query(
    "f13_quick_stats",
    on_loans(
        """SELECT round(avg(RiskScore), 6) AS mean, round(median(RiskScore), 6) AS median,
        round(stddev_pop(RiskScore), 6) AS std FROM loans"""
    ),
)
def quick_stats(spark, sf_dir):
    return tidy(ops.quick_stats(loans(spark, sf_dir), "RiskScore"))


@query(
    "f14_result_summary",
    on_loans(
        """SELECT count(*) AS applicants, count(*) FILTER (RiskScore >= 50) AS high_risk,
        round(sum(CAST(floor(LoanAmount) AS BIGINT))::DOUBLE, 6) AS total_amount FROM loans"""
    ),
)
def result_summary(spark, sf_dir):
    df = loans(spark, sf_dir).selectExpr(
        "IF(RiskScore >= 50, 'High', 'Other') AS risk_category", "double(floor(LoanAmount)) AS loan_amount"
    )
    return tidy(ops.result_summary(df, "risk_category", "loan_amount"))


@query(
    "f15_score_column",
    on_loans(
        """SELECT 'prediction' AS score_column, round(avg(80 - 6E-2 * CreditScore + 12 * DebtToIncomeRatio
        + 10 * BankruptcyHistory), 6) AS mean_score FROM loans"""
    ),
)
def score_column(spark, sf_dir):
    df = loans(spark, sf_dir).withColumn("prediction", F.expr(MODELS["three_factor"]))
    name = resolve_score_column(df)
    return tidy(df.agg(F.avg(name).alias("mean_score")).withColumn("score_column", F.lit(name)))


@query(
    "f16_flag_outliers",
    """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d,
      quantile_cont(l_extendedprice, 25E-2) AS q1, quantile_cont(l_extendedprice, 75E-2) AS q3 FROM lineitem)
    SELECT l_extendedprice < q1 - 15E-1 * (q3 - q1) OR l_extendedprice > q3 + 15E-1 * (q3 - q1)
        AS l_extendedprice_iqr_outlier, abs((l_extendedprice - m) / d) > 15E-1 AS l_extendedprice_z_outlier,
      l_extendedprice < 1000 OR l_extendedprice > 90000 AS l_extendedprice_domain_outlier, count(*) AS lines
    FROM lineitem, s GROUP BY 1, 2, 3""",
)
def flag_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    flagged = ops.flag_outliers(df, ["l_extendedprice"], 1.5, {"l_extendedprice": (1000, 90000)})
    flags = [c for c in flagged.columns if c.endswith("_outlier")]
    return flagged.groupBy(*flags).agg(F.count(F.lit(1)).alias("lines"))
