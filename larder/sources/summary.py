"""Sales summed once per SKU and day, laid out by month, for the operators that ask for sums by SKU.

A look-back reads the months it touches and nothing else, where the sales themselves would be scanned and
summed again by every operator. All measures are sums, least or greatest values, so they merge.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.columns import year_month
from larder.sources.files import read_table, write_table

NAME = "sales_summary"
MONTH = "sales_month"
READS = ("date", "sku_id", "quantity_ordered", "quantity_fulfilled", "backorder_quantity")
_SUMS = ("sales_rows", "fulfilled_rows", "quantity_ordered", "quantity_fulfilled", "fulfilled_squares", "backorder_quantity", "backorder_rows", "short_rows")


def instead(columns: str) -> dict[str, tuple[str, str]]:
    """For ``operator``: the summary's columns that stand in for sales."""
    return {"sales": (NAME, f"{MONTH} {columns}")}


def measures(sales: DataFrame) -> DataFrame:
    """Each sale as a summary of itself, or a summary as it is; only the measures that are read are computed."""
    if "sales_rows" in sales.columns:
        return sales
    sold = F.col("quantity_fulfilled")
    made = {"sales_rows": F.lit(1).cast("long")}
    if "quantity_fulfilled" in sales.columns:
        made |= {
            "fulfilled_rows": sold.isNotNull().cast("long"), "fulfilled_squares": sold.cast("long") * sold.cast("long"),
            "fulfilled_min": sold, "fulfilled_max": sold,
        }
    if "backorder_quantity" in sales.columns:
        made["backorder_rows"] = F.coalesce(F.col("backorder_quantity") > 0, F.lit(False)).cast("long")
    if {"quantity_fulfilled", "quantity_ordered"} <= set(sales.columns):
        made["short_rows"] = F.coalesce(sold < F.col("quantity_ordered"), F.lit(False)).cast("long")
    return sales.withColumns(made)


def merged(*names: str) -> list[Column]:
    """These measures of many rows as one."""
    least = {"fulfilled_min": F.min, "fulfilled_max": F.max}
    return [least.get(name, F.sum)(name).alias(name) for name in names]


def summarized(sales: DataFrame) -> DataFrame:
    """One row per SKU and day, summed in the task before the shuffle, so a hot SKU is a row per task and day."""
    return measures(sales.select(*READS)).groupBy("sku_id", "date").agg(*merged(*_SUMS, "fulfilled_min", "fulfilled_max"))


def write_sales_summary(sales: DataFrame, name: str, months: tuple[date, date] | None = None) -> None:
    """Writes the summary as a table by month, or replaces the months from one day's to another's alone.

    A sale without a date is in no look-back, but stays in the table, in the month of unknown name.
    """
    if months is not None:
        first, last = (F.trunc(F.lit(day), "MM") for day in months)
        sales = sales.filter((F.col("date") >= first) & (F.col("date") <= F.last_day(last)))
    write_table(summarized(sales), name, by_month="date", only_months=months is not None)


def read_sales_summary(spark: SparkSession, name: str) -> DataFrame:
    return read_table(spark, name)


def since(rows: DataFrame, first: Column) -> DataFrame:
    """Rows from a day on. Folders of earlier months are never listed for reading: their name is compared too."""
    rows = rows.filter(F.col("date") >= first)
    return rows.filter(F.col(MONTH) >= year_month(first)) if MONTH in rows.columns else rows
