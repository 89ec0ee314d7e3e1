"""One-row figures turned into (metric, value) text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_values(one_row: DataFrame, **metrics: Column) -> DataFrame:
    """Each keyword becomes a row; underscores in its name become spaces."""
    names = {name: name.replace("_", " ") for name in metrics}
    wide = one_row.select(*(value.cast("string").alias(names[name]) for name, value in metrics.items()))
    return wide.unpivot([], list(names.values()), "metric", "value")


def dollars(amount: Column, digits: int = 2) -> Column:
    return F.format_string(f"$%,.{digits}f", amount)


def units(amount: Column) -> Column:
    return F.format_string("%.0f units", amount)


def with_percent(amount: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", amount)
