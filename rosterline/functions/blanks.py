"""What counts as "no value". The operators differ on this, so each rule has its own name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    """Null or the empty string; white space is a value."""
    return value.isNull() | (value.cast("string") == "")


def is_filled(value: Column) -> Column:
    """Not null and not only white space; never null itself."""
    return F.coalesce(strip(value.cast("string")) != "", F.lit(False))


def none_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def is_true(condition: Column) -> Column:
    """Three-valued logic to two-valued: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def no_nan(value: Column) -> Column:
    """NaN to null: Spark orders NaN above every number, so it must not enter a filter."""
    return F.when(~F.isnan(value), value)


# What reads as a number; testing it first is far cheaper than a cast that fails.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"


def to_number(value: Column) -> Column:
    """Text to double, null where it is not a number or says NaN."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled_sql(column: str, numeric: bool = False) -> str:
    """``is_filled`` of a column as SQL text, for expressions over many columns."""
    if numeric:
        return f"(`{column}` is not null)"
    return f"coalesce(btrim(cast(`{column}` as string), '{WHITESPACE}') != '', false)"
