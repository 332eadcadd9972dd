"""Row contracts compiled to column expressions: violations, typed rows, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import FOREIGN, double_text, long_text, parse_date, parse_double, tidy_text
from ..schema import Field
from .columns import literal, quoted

VIOLATIONS = "violations"
# Doubles below 2^63 fit a bigint; digits that round up to it are read as digits.
LONG_LIMIT = "9223372036854775808D"


def folded(level: str, fold: str) -> str:
    return level.lower().replace("-", "_") if fold == "dash" else level.lower()


def own_spellings(field: Field) -> list[str]:
    """Levels that a text spelled just so stands for: most texts, known without folding them."""
    known = {folded(level, field.fold): level for level in field.levels}
    return [v for v in field.levels if known[folded(v, field.fold)] == v and (field.fold == "dash" or v == v.strip(" "))]


def canonical_level(c: Column, field: Field) -> Column:
    """The contract's own spelling of a category, or null for an unknown one.

    Spellings are compared in lower case, with dashes as underscores or trimmed.
    """
    held = c.cast("string")
    text = F.lower(held)
    text = F.translate(text, "-", "_") if field.fold == "dash" else F.trim(text)
    out = F.lit(None).cast("string")
    for level in field.levels:
        out = F.when(text == folded(level, field.fold), level).otherwise(out)
    return F.when(held.isin(own_spellings(field)), held).otherwise(out)


def typed_value(field: Field, source: T.DataType) -> Column:
    """The field's value in its contract type, or null when it cannot be read as such."""
    name = quoted(field.name)
    if field.kind == "int":
        return F.expr(f"bigint({name})" if isinstance(source, T.IntegralType) else long_text(f"string({name})"))
    if field.kind == "float":
        return F.expr(f"nanvl(double({name}), double(NULL))" if isinstance(source, T.NumericType) else double_text(f"string({name})"))
    if field.kind == "enum":
        return canonical_level(F.col(name), field)
    return F.expr(f"string({name})")


def _kinds(df: DataFrame, contract: list[Field]) -> dict[Field, T.DataType]:
    """Fields present in the table, with the type they arrive in."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {f: types[f.name] for f in contract if f.name in types}


def _checked_value(field: Field, source: T.DataType) -> str:
    """SQL text of the value the rules look at; null if it cannot be read.

    It is written apart from ``typed_value`` on purpose. Where a filter and a projection above
    it share many expressions, the optimizer derives every mixture of the two as a constraint,
    a number that doubles with each shared field.
    """
    name = quoted(field.name)
    if field.kind == "enum":
        text = f"translate(lower({name}), '-', '_')" if field.fold == "dash" else f"lower(trim({name}))"
        listed = ", ".join(literal(folded(v, field.fold)) for v in field.levels)
        exact = ", ".join(literal(v) for v in own_spellings(field)) or "NULL"
        return f"IF({name} IN ({exact}) OR {text} IN ({listed}), 1, NULL)"
    if field.kind == "text":
        return name
    value = _number(field, source)
    if field.kind == "int" and not isinstance(source, T.IntegralType):
        return f"IF({_whole(value, name, source)}, {value}, NULL)"
    return value


def _number(field: Field, source: T.DataType) -> str:
    """SQL text of a number as it arrives, whole or not; null if it is none."""
    name = quoted(field.name)
    if isinstance(source, T.IntegralType):
        return name
    if isinstance(source, T.NumericType):
        return f"nanvl(double({name}), NULL)"
    return f"IF({name} RLIKE '{FOREIGN}', NULL, try_cast({name} AS DOUBLE))"


def _whole(value: str, name: str, source: T.DataType) -> str:
    """SQL condition that a double is a whole number of a bigint's range."""
    fits = f"abs({value}) < {LONG_LIMIT}"
    if not isinstance(source, T.NumericType):
        fits = f"({fits} OR (instr({name}, '.') = 0 AND try_cast({name} AS BIGINT) IS NOT NULL))"
    return f"{value} = floor({value}) AND {fits}"


def violation_code(field: Field, source: T.DataType) -> str:
    """SQL text giving the first broken rule of a field, or null."""
    value = _checked_value(field, source)
    missing = "NULL" if field.optional else "'missing'"
    unreadable = "bad_level" if field.kind == "enum" else "bad_type"
    whens = [f"WHEN {quoted(field.name)} IS NULL THEN {missing}", f"WHEN {value} IS NULL THEN '{unreadable}'"]
    bounds = [("<", field.ge, "too_small"), ("<=", field.gt, "too_small"), (">", field.le, "too_large")]
    whens += [f"WHEN {value} {op} {limit} THEN '{code}'" for op, limit, code in bounds if limit is not None]
    return f"CASE {' '.join(whens)} END"


def _holds(field: Field, source: T.DataType) -> str:
    """SQL condition that a field keeps its rules.

    A filter computes an expression as often as it is written. Plain digits, what most whole numbers come
    as, are judged as digits; only other texts are read as a double, bound to a name for its several tests.
    """
    value, name = _checked_value(field, source), quoted(field.name)
    bounds = [(">=", field.ge), (">", field.gt), ("<=", field.le)]
    limits = [f"{op} {limit}" for op, limit in bounds if limit is not None]
    if field.kind == "int" and not isinstance(source, T.IntegralType):
        rest = [_whole("v", name, source), *[f"v {limit}" for limit in limits]]
        tests = [f"exists(array({_number(field, source)}), v -> {' AND '.join(rest)})", "false"]
        if not isinstance(source, T.NumericType):
            # Casts to bigint take a DEL around the digits for white space, casts to double do not.
            digits = f"IF(instr({name}, chr(127)) = 0, double(try_cast({name} AS BIGINT)), NULL)"
            tests.insert(0, " AND ".join(f"{digits} {limit}" for limit in limits) or f"IF({digits} IS NULL, NULL, true)")
        held = f"coalesce({', '.join(tests)})"
    else:
        held = f"coalesce({' AND '.join(f'{value} {limit}' for limit in limits) or f'{value} IS NOT NULL'}, false)"
    return f"({name} IS NULL OR {held})" if field.optional else held


def broken_fields(df: DataFrame, contract: list[Field]) -> str:
    """SQL number of broken fields: one flat sum, evaluated in generated code."""
    return " + ".join(f"IF({_holds(f, kind)}, 0, 1)" for f, kind in _kinds(df, contract).items())


def _findings(df: DataFrame, contract: list[Field]) -> str:
    """SQL array with one entry per field, broken or not."""
    entries = [
        f"named_struct('field', {literal(f.name)}, 'code', {violation_code(f, kind)}, 'value', string({quoted(f.name)}))"
        for f, kind in _kinds(df, contract).items()
    ]
    return f"array({', '.join(entries)})"


def with_violations(df: DataFrame, contract: list[Field]) -> DataFrame:
    """Adds ``violations``: one entry (field, code, value) per broken field."""
    found = F.expr(f"filter({_findings(df, contract)}, v -> v.code IS NOT NULL)")
    return df.select(*[quoted(c) for c in df.columns], found.alias(VIOLATIONS))


def missing_columns(df: DataFrame, contract: list[Field]) -> list[str]:
    return [f.name for f in contract if not f.optional and f.name not in df.columns]


def unknown_columns(df: DataFrame, contract: list[Field], keys: tuple[str, ...] = ("row_id",)) -> list[str]:
    known = {f.name for f in contract} | set(keys)
    return [c for c in df.columns if c not in known]


def check_columns(df: DataFrame, contract: list[Field], unknown: str = "reject", keys=("row_id",)) -> DataFrame:
    """Refuses absent columns; unknown ones are refused or dropped."""
    absent, extra = missing_columns(df, contract), unknown_columns(df, contract, keys)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    if extra and unknown == "reject":
        raise ValueError(f"unknown columns: {extra}")
    return df.drop(*extra)


def typed_rows(df: DataFrame, contract: list[Field], keys=("row_id",)) -> DataFrame:
    """Contract columns in their contract types and spellings; unreadable values become null."""
    held = [c for c in keys if c in df.columns]
    return df.select(*held, *[typed_value(f, kind).alias(f.name) for f, kind in _kinds(df, contract).items()])


def split_valid(df: DataFrame, contract: list[Field], keys=("row_id",)) -> tuple[DataFrame, DataFrame]:
    """(typed good rows, untouched bad rows with their violations); together the whole input."""
    broken = broken_fields(df, contract)
    good = typed_rows(df.filter(f"{broken} = 0"), contract, keys)
    return good, with_violations(df.filter(f"{broken} > 0"), contract)


def violation_rows(df: DataFrame, contract: list[Field], key: str = "row_id") -> DataFrame:
    """One row per violation. Only bad rows are unfolded into their fields."""
    bad = df.filter(f"{broken_fields(df, contract)} > 0")
    return bad.selectExpr(key, f"inline({_findings(df, contract)})").filter("code IS NOT NULL")


def first_invalid(df: DataFrame, contract: list[Field], key: str = "row_id") -> DataFrame:
    """The lowest failing key: what a fail-fast caller reports."""
    bad = df.filter(f"{broken_fields(df, contract)} > 0")
    return bad.agg(F.min(key).alias(key), F.count(F.lit(1)).alias("invalid_rows"))


# -- the looser check of uploaded files --


def coerce_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: parse_double(F.col(c)) for c in names if c in df.columns})


def normalise_text(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: tidy_text(F.col(c)) for c in names if c in df.columns})


def coerce_dates(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: parse_date(F.col(c)) for c in names if c in df.columns})


def broken_rule(field: Field) -> str:
    """SQL condition that breaks any bound of the rule. A null breaks nothing."""
    c = quoted(field.name)
    bounds = [("<", field.ge), ("<=", field.gt), (">", field.le)]
    return " OR ".join(f"{c} {op} {limit}" for op, limit in bounds if limit is not None)


def business_errors(df: DataFrame, rules: list[Field], key: str = "row_id") -> DataFrame:
    """One row per broken business rule: key, column, value, message."""
    entries = []
    for f in rules:
        if f.name in df.columns:
            entries.append(
                f"IF({broken_rule(f)}, named_struct('column_name', {literal(f.name)}, 'value', double({quoted(f.name)}),"
                f" 'message', {literal(f.message)}), NULL)"
            )
    return df.select(key, F.expr(f"inline(array_compact(array({', '.join(entries)})))"))


def upload_report(
    df: DataFrame, required: list[str], numbers: list[str], texts: list[str], dates: list[str], rules: list[Field],
    key: str = "row_id",
) -> DataFrame:
    """Long report of an uploaded table: section, name, amount.

    Absent columns end the check. Otherwise it counts business errors per column, warns of
    columns holding nulls, and lists null counts, all from one pass over the rows.
    """
    spark = df.sparkSession
    schema = "section string, name string, amount bigint"
    absent = [c for c in required if c not in df.columns]
    if absent:
        rows = [("is_valid", "", 0)] + [("missing_column", c, 1) for c in absent]
        return spark.createDataFrame(rows, schema)
    clean = coerce_dates(normalise_text(coerce_numbers(df, numbers), texts), dates)
    checked = [f for f in rules if f.name in clean.columns]
    columns = [c for c in clean.columns if c != key]
    totals = clean.agg(
        *[F.expr(f"count_if({broken_rule(f)}) AS `error {f.name}`") for f in checked],
        *[F.expr(f"count_if({quoted(c)} IS NULL) AS `null {c}`") for c in columns],
    )
    errors = [f"named_struct('section', 'errors', 'name', {literal(f.name)}, 'amount', {quoted('error ' + f.name)})" for f in checked]
    nulls = [f"named_struct('section', 'missing_values', 'name', {literal(c)}, 'amount', {quoted('null ' + c)})" for c in columns]
    warned = [
        f"named_struct('section', 'warnings', 'name', {literal(c)}, 'amount', bigint({quoted('null ' + c)} > 0))" for c in columns
    ]
    broken = " + ".join(f"`error {f.name}`" for f in checked)
    valid = f"named_struct('section', 'is_valid', 'name', '', 'amount', bigint({broken} = 0))"
    return totals.selectExpr(f"inline(array({', '.join([valid, *errors, *warned, *nulls])}))").filter(
        "section IN ('is_valid', 'missing_values') OR amount > 0"
    )
