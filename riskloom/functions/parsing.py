"""Column helpers that turn untrusted text into typed values, never raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Java's own number spellings (1d, 2f, 0x1p3, NaN, Infinity); an exponent's e stays allowed.
FOREIGN = "[dDfFxXpPnN]"


def parse_double(c: Column) -> Column:
    """Number or null: digits with sign, point and exponent, nothing else."""
    text = c.cast("string")
    return F.when(~text.rlike(FOREIGN), text.try_cast("double"))


def double_text(text: str) -> str:
    """``parse_double`` of a string as SQL text: wide tables of columns are planned faster from it."""
    return f"CASE WHEN NOT {text} RLIKE '{FOREIGN}' THEN try_cast({text} AS DOUBLE) END"


def long_text(text: str) -> str:
    """SQL text of a whole number or null: takes ``35``, ``"35"`` and ``25.0``, refuses ``25.5`` and text."""
    number = double_text(text)
    whole = f"CASE WHEN {number} = floor({number}) THEN try_cast({number} AS BIGINT) END"
    # Plain digits go straight to bigint, which keeps every digit of a long number.
    return f"coalesce(CASE WHEN instr({text}, '.') = 0 THEN try_cast({text} AS BIGINT) END, {whole})"


def parse_date(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string")).cast("date")


def tidy_text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))
