"""Feature steps as ML stages: stateless ones are Transformers, learning ones Estimators.

Every stage is a projection of native expressions. What a stage learns (levels, types, a
null check) is a few values found by aggregation and kept as saved parameters.
"""

from __future__ import annotations

import json
from itertools import combinations, combinations_with_replacement

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import safe_divide
from ..schema import EDUCATION, RAW_COLUMNS
from .columns import classify_columns, distinct_counts, literal, long_table, numeric_columns, quoted

# ---- Fixed values: which columns the loan pipeline works on ----

POLYNOMIAL_COLUMNS = ["AnnualIncome", "CreditScore", "TotalAssets", "TotalLiabilities", "NetWorth"]
ORDINAL_LEVELS = {"EducationLevel": list(EDUCATION)}
ONE_HOT_COLUMNS = ["HomeOwnershipStatus", "EmploymentStatus", "LoanPurpose"]
LIFE_STAGES = ["Young", "Middle", "Senior"]
CRAFTED_INPUTS = [
    "SavingsAccountBalance", "CheckingAccountBalance", "MonthlyIncome", "MonthlyDebtPayments", "MonthlyLoanPayment",
    "LoanAmount", "AnnualIncome",
]
FIXED_TYPES = {
    "BankruptcyHistory": "double",
    "PreviousLoanDefaults": "category",
    "PaymentHistory": "bigint",
    "UtilityBillsPaymentHistory": "double",
    "LoanPurpose": "category",
}
CATEGORY_SHARE = 0.5  # text with fewer distinct values than this share of rows is a category
FLOAT_TOLERANCE = 1e-5  # both relative and absolute, for narrowing to float

# ---- end of fixed values ----


# -- expressions --


def date_parts(df: DataFrame, column: str, weekday: bool = False) -> DataFrame:
    """Year, month and day of a date column, which is dropped. Unreadable dates give nulls."""
    date = F.try_to_timestamp(F.col(quoted(column)).cast("string"))
    low = column.lower()
    parts = {
        f"{low}_year": F.year(date).cast("smallint"),
        f"{low}_month": F.month(date).cast("tinyint"),
        f"{low}_day": F.dayofmonth(date).cast("tinyint"),
    }
    if weekday:
        parts[f"{low}_weekday"] = F.weekday(date).cast("tinyint")
    return df.withColumns(parts).drop(column)


def ratio_features(on_zero: str = "nan") -> dict[str, Column]:
    """The three crafted ratios, as floats."""
    c = F.col
    ratios = {
        "liquidity_ratio": (c("SavingsAccountBalance") + c("CheckingAccountBalance"), c("MonthlyIncome")),
        "debt_burden": (c("MonthlyDebtPayments"), c("MonthlyIncome")),
        "loan_to_income_ratio": (c("LoanAmount"), c("AnnualIncome")),
    }
    return {name: safe_divide(num, den, on_zero).cast("float") for name, (num, den) in ratios.items()}


def payment_capacity() -> Column:
    return F.col("MonthlyIncome") - F.col("MonthlyDebtPayments") - F.col("MonthlyLoanPayment")


def ordered_rank(column: str, levels: list[str], unknown: int | None = None) -> Column:
    """Position of a level in its order; unknown levels give ``unknown``."""
    whens = F.lit(unknown).cast("int")
    for i, level in enumerate(levels):
        whens = F.when(F.col(quoted(column)) == level, i).otherwise(whens)
    return whens


def polynomial_products(columns: list[str], degree: int = 2, interaction_only: bool = False) -> dict[str, tuple[str, ...]]:
    """Name to factors of every product up to a degree: ``A``, ``A^2``, ``A*B``."""
    choose = combinations if interaction_only else combinations_with_replacement
    out = {}
    for size in range(1, degree + 1):
        for chosen in choose(columns, size):
            powers = {c: chosen.count(c) for c in dict.fromkeys(chosen)}
            out["*".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())] = chosen
    return out


def polynomial_terms(columns: list[str], degree: int = 2, bias: bool = False, interaction_only: bool = False) -> dict[str, Column]:
    """The products as columns; reals, so that long products cannot overflow."""
    products = polynomial_products(columns, degree, interaction_only)
    terms = {name: F.expr(" * ".join(f"double({quoted(c)})" for c in f)) for name, f in products.items()}
    return {"bias": F.lit(1.0), **terms} if bias else terms


def polynomial(df: DataFrame, columns: list[str] | None = None, degree: int = 2, bias: bool = False, interaction_only: bool = False) -> DataFrame:
    """Other columns, then the polynomial ones. Absent columns are skipped."""
    present = [c for c in (columns or POLYNOMIAL_COLUMNS) if c in df.columns]
    if not present:
        return df
    terms = polynomial_terms(present, degree, bias, interaction_only)
    kept = [quoted(c) for c in df.columns if c not in present]
    return df.select(*kept, *[term.alias(name) for name, term in terms.items()])


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Category columns as one-byte codes; what does not fit becomes null."""
    return df.withColumns({c: F.col(quoted(c)).try_cast("tinyint") for c in columns if c in df.columns})


def logical_size(df: DataFrame) -> DataFrame:
    """Bytes per column: fixed width by type, measured length for text. One aggregation."""
    widths = {
        "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8,
        "timestamp": 8, "timestamp_ntz": 8,
    }
    sums = []
    for c, kind in df.dtypes:
        size = f"count(1) * {widths[kind]}" if kind in widths else f"coalesce(sum(octet_length(string({quoted(c)}))), 0)"
        sums.append(F.expr(f"bigint({size}) AS {quoted(c)}"))
    return long_table(
        df.agg(*sums),
        [{"column_name": literal(c), "column_type": literal(kind), "bytes": quoted(c)} for c, kind in df.dtypes],
    )


def size_saving(before: DataFrame, after: DataFrame) -> DataFrame:
    """Megabytes before and after, and the percentage saved."""
    first = logical_size(before).agg(F.sum("bytes").alias("b"))
    second = logical_size(after).agg(F.sum("bytes").alias("a"))
    mb = 1024 * 1024
    return first.join(F.broadcast(second)).selectExpr(
        f"b / {mb}D AS mb_before", f"a / {mb}D AS mb_after", "try_divide(100D * (b - a), b) AS percent_saved"
    )


# -- stages --


class _Json(DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose settings and learned values are one JSON parameter, so that it can be saved."""

    state = Param(Params._dummy(), "state", "settings and learned values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._set(state=state)

    @classmethod
    def of(cls, **values):
        return cls(state=json.dumps(values))

    @property
    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class ColumnDropper(_Json, Transformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.values["columns"])


class DateParts(_Json, Transformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        if self.values["column"] not in df.columns:
            raise ValueError(f"date column {self.values['column']} is missing")
        return date_parts(df, self.values["column"], self.values.get("weekday", False))


class CraftedFeatures(_Json, Estimator):
    """Learns whether the payment capacity is known for every row; only then it is a whole number."""

    def _fit(self, df: DataFrame):
        absent = [c for c in CRAFTED_INPUTS if c not in df.columns]
        if absent:
            raise ValueError(f"required columns are missing: {absent}")
        gaps = df.agg(F.count_if(payment_capacity().isNull()).alias("n")).first()["n"]
        return CraftedFeaturesModel.of(on_zero=self.values.get("on_zero", "nan"), whole=gaps == 0)


class CraftedFeaturesModel(_Json, Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        ratios = ratio_features(self.values["on_zero"])
        # Truncates like the fitted data; a later null or overflow stays null instead of failing the batch.
        capacity = payment_capacity()
        if self.values["whole"]:
            capacity = capacity.try_cast("int")
        order = {n: ratios[n] for n in ("liquidity_ratio", "debt_burden")}
        order |= {"payment_capacity": capacity, "loan_to_income_ratio": ratios["loan_to_income_ratio"]}
        if "life_stage" in df.columns:
            order["life_stage"] = ordered_rank("life_stage", LIFE_STAGES)
        return df.withColumns(order)


class Polynomial(_Json, Transformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        return polynomial(df, v.get("columns"), v.get("degree", 2), v.get("bias", False), v.get("interaction_only", False))


class CategoryEncoder(_Json, Estimator):
    """Ordinal codes for ordered categories, 0/1 columns for the others.

    One-hot levels are sorted, the first is dropped, unseen ones give all zeros. Learns the levels
    of all columns with their most frequent one from one grouped count. Every level becomes a column,
    so levels are what the driver can list; ``most_levels``, if given, refuses a column with more.
    """

    def _fit(self, df: DataFrame):
        names = [c for c in self.values.get("one_hot", ONE_HOT_COLUMNS) if c in df.columns]
        most, found = self.values.get("most_levels"), {c: [] for c in names}
        if names:
            text = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in names])
            cells = text.unpivot([], names, "column_name", "v").dropna(subset=["v"])
            counts = cells.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
            if most is not None:
                wide = counts.groupBy("column_name").count().filter(F.col("count") > most).first()
                if wide:
                    raise ValueError(f"{wide['column_name']} has more than {most} levels; it is not a category")
            for r in counts.collect():
                found[r["column_name"]].append(r)
        levels = {c: sorted(r["v"] for r in rows) for c, rows in found.items()}
        frequent = {c: min(rows, key=lambda r: (-r["n"], r["v"]))["v"] for c, rows in found.items() if rows}
        ordinal = {c: o for c, o in self.values.get("ordinal", ORDINAL_LEVELS).items() if c in df.columns}
        return CategoryEncoderModel.of(
            levels=levels, frequent=frequent, ordinal=ordinal, keep_ordinal=self.values.get("keep_ordinal", True)
        )


class CategoryEncoderModel(_Json, Model):
    @property
    def most_frequent(self) -> dict[str, str]:
        return self.values["frequent"]

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        kept = []
        for c in df.columns:
            if c in v["ordinal"]:
                if v["keep_ordinal"]:
                    kept.append(ordered_rank(c, v["ordinal"][c], -1).alias(c))
            elif c not in v["levels"]:
                kept.append(F.col(quoted(c)))
        hot = [
            F.when(F.col(quoted(c)) == level, 1.0).otherwise(0.0).alias(f"{c}_{level}")
            for c, levels in v["levels"].items()
            if c in df.columns
            for level in levels[1:]
        ]
        return df.select(*kept, *hot)


class TypeOptimizer(_Json, Estimator):
    """Chooses the narrowest type per column from one aggregation over all columns.

    Whole numbers: smallest signed width that holds them, or bigint when some are missing.
    Reals: float when every value survives it within the tolerance. Text: a category when
    its values repeat enough.
    """

    def _fit(self, df: DataFrame):
        fixed = self.values.get("fixed", FIXED_TYPES)
        kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in fixed}
        whole = [c for c, t in kinds.items() if isinstance(t, T.IntegralType)]
        real = [c for c, t in kinds.items() if isinstance(t, (T.FloatType, T.DoubleType))]
        text = [c for c, t in kinds.items() if isinstance(t, T.StringType)]
        aggs = [F.count(F.lit(1)).alias("n rows")]
        for c in whole:
            q = quoted(c)
            fits = [f"max({q}) <= {2 ** (bits - 1) - 1} AND min({q}) >= {-(2 ** (bits - 1))}" for bits in (8, 16, 32)]
            aggs.append(
                F.expr(
                    f"CASE WHEN count({q}) < count(1) THEN 'bigint' WHEN {fits[0]} THEN 'tinyint'"
                    f" WHEN {fits[1]} THEN 'smallint' WHEN {fits[2]} THEN 'int' ELSE 'bigint' END"
                ).alias(f"type {c}")
            )
        for c in real:
            x = f"double({quoted(c)})"
            narrow = f"double(float({quoted(c)}))"
            close = f"abs({x} - {narrow}) <= {FLOAT_TOLERANCE} + {FLOAT_TOLERANCE} * abs({narrow})"
            near = f"{x} = {narrow} OR (abs({narrow}) < double('inf') AND {close})"
            lost = f"{quoted(c)} IS NOT NULL AND NOT isnan({x}) AND NOT ({near})"
            aggs.append(F.expr(f"IF(count_if({lost}) = 0, 'float', 'double')").alias(f"type {c}"))
        row = df.agg(*aggs).first().asDict()
        types = {c: row[f"type {c}"] for c in [*whole, *real]}
        limit = row["n rows"] * CATEGORY_SHARE
        distinct = distinct_counts(df, {c: limit for c in text})
        types |= {c: "category" if distinct[c] < limit else "string" for c in text}
        chosen = {c: fixed.get(c) or types.get(c) for c in df.columns}
        return TypeOptimizerModel.of(types={c: t for c, t in chosen.items() if t})


class TypeOptimizerModel(_Json, Model):
    @property
    def types(self) -> dict[str, str]:
        return self.values["types"]

    def _transform(self, df: DataFrame) -> DataFrame:
        out, types = [], self.types
        for f in df.schema.fields:
            c, kind = quoted(f.name), types.get(f.name)
            if kind == "category":
                # A category keeps its values; the mark travels with the schema.
                held = f.dataType if isinstance(f.dataType, T.NumericType) else T.StringType()
                out.append(F.col(c).cast(held).alias(f.name, metadata={"category": True}))
            elif kind and kind != f.dataType.simpleString():
                # Later data can exceed the fitted range; such a value becomes null, not a failed batch.
                out.append(F.expr(f"{'cast' if kind == 'float' else 'try_cast'}({c} AS {kind}) AS {c}"))
            else:
                out.append(c)
        return df.select(*out)

    def chosen_types(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(list(self.types.items()), "column_name string, chosen_type string")


def narrowest_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, chosen_type) of numeric columns, from one aggregation.

    Whole numbers, and reals whose values are all present and whole, get the smallest signed width;
    other reals get float where their range allows it. Columns without values stay as they are.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    names = [c for c in columns or kinds if c in kinds]
    aggs = []
    for c in names:
        q, x = quoted(c), f"double({quoted(c)})"
        whole = "true"
        if not isinstance(kinds[c], T.IntegralType):
            whole = f"count({q}) = count(1) AND count_if(isnan({x}) OR abs({x}) = double('inf') OR {x} <> floor({x})) = 0"
        widths = " ".join(
            f"WHEN max({x}) <= {2 ** (bits - 1) - 1} AND min({x}) >= {-(2 ** (bits - 1))} THEN '{kind}'"
            for bits, kind in ((8, "tinyint"), (16, "smallint"), (32, "int"))
        )
        held = kinds[c].simpleString()
        real = f"IF(max(abs(nanvl({x}, 0D))) <= 3.4028234663852886E38D, 'float', '{held}')"
        signed = f"CASE {widths} WHEN max(abs({x})) < 9.2E18D THEN 'bigint' ELSE '{held}' END"
        aggs.append(F.expr(f"CASE WHEN count({q}) = 0 THEN '{held}' WHEN {whole} THEN {signed} ELSE {real} END").alias(c))
    return long_table(df.agg(*aggs), [{"column_name": literal(c), "chosen_type": quoted(c)} for c in names])


def build_pipeline(
    df: DataFrame, drop: list[str] = (), degree: int = 2, on_zero: str = "zero", keep_ordinal: bool = True,
    date_column: str = "ApplicationDate", expected: list[str] | None = None,
) -> Pipeline:
    """Drop, date parts, crafted features, polynomials, encoding (if there is any category), types."""
    unknown = [c for c in df.columns if c not in (expected or RAW_COLUMNS)]
    dropped = list(dict.fromkeys([*drop, *unknown]))
    kept = df.drop(*dropped)
    classes = classify_columns(kept) if kept.columns else {}
    if not any(k in ("numerical", "categorical", "date") for k in classes.values()):
        raise ValueError("at least one feature type must be present")
    stages = [ColumnDropper.of(columns=dropped)] if dropped else []
    stages += [DateParts.of(column=date_column), CraftedFeatures.of(on_zero=on_zero), Polynomial.of(degree=degree)]
    if "categorical" in classes.values():
        stages.append(CategoryEncoder.of(keep_ordinal=keep_ordinal))
    stages.append(TypeOptimizer.of())
    return Pipeline(stages=stages)
