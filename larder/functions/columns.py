"""Small column expressions: money, ratios, bands, exact moments, calendar parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(cents: Column | str) -> Column:
    """Whole cents to currency units; the quotient already has two decimals."""
    return as_col(cents) / F.lit(100.0)


def rounded(amount: Column | str) -> Column:
    """Two decimals for a product of doubles, whose noise must not decide an exact half."""
    return F.round(F.round(as_col(amount), 6), 2)


def cents(amount: Column | str) -> Column:
    """Currency units to whole cents."""
    return F.round(as_col(amount) * 100).cast("long")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL (not an error) where the denominator is zero."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def percent(part: Column | str, whole: Column | str, digits: int | None = 2) -> Column:
    value = F.try_divide(as_col(part) * F.lit(100.0), as_col(whole).cast("double"))
    return value if digits is None else F.round(value, digits)


def banded(value: Column, bands: Sequence[tuple[float, str]], otherwise: str, op: str = ">") -> Column:
    """First label whose cut the value passes; NULL falls through to ``otherwise``."""
    tests = {
        ">": lambda cut: value > F.lit(cut),
        ">=": lambda cut: value >= F.lit(cut),
        "<=": lambda cut: value <= F.lit(cut),
    }
    chain = F
    for cut, label in bands:
        chain = chain.when(tests[op](cut), F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def paired_tier(first: Column, second: Column, cuts: Sequence[tuple[float, float, str]], otherwise: str) -> Column:
    """First label whose two lower bounds both hold."""
    chain = F
    for low_first, low_second, label in cuts:
        chain = chain.when((first >= F.lit(low_first)) & (second >= F.lit(low_second)), F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """n*sum(x^2) - sum(x)^2 without rounding, as double."""
    wide = [c.cast("decimal(19,0)") for c in (n, total, squares)]
    return (wide[0] * wide[2] - wide[1] * wide[1]).cast("double")


def stddev_pop_exact(n: Column | str, total: Column | str, squares: Column | str) -> Column:
    """Population deviation of integers from their mergeable sums."""
    n, total, squares = as_col(n), as_col(total), as_col(squares)
    return F.try_divide(F.sqrt(_spread(n, total, squares)), n.cast("double"))


def stddev_samp_exact(n: Column | str, total: Column | str, squares: Column | str) -> Column:
    """Sample deviation of integers from their mergeable sums; NULL for a single row."""
    n, total, squares = as_col(n), as_col(total), as_col(squares)
    return F.sqrt(F.try_divide(_spread(n, total, squares), n.cast("double") * (n - 1).cast("double")))


def squares(value: Column | str) -> Column:
    value = as_col(value).cast("long")
    return F.sum(value * value)


def month_start(day: Column | str) -> Column:
    return F.trunc(as_col(day), "MM")


def year_month(day: Column | str) -> Column:
    return F.date_format(as_col(day), "yyyy-MM")


def monday_week(day: Column | str) -> Column:
    """Week of the year, weeks starting on Monday, days before the first Monday in week 0."""
    day = as_col(day)
    return F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7).cast("int")


def sunday_weekday(day: Column | str) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(as_col(day)) - 1


def plain_number(value: Column) -> Column:
    """Two-decimal text without exponent notation."""
    return value.cast("decimal(38,2)").cast("string")
