"""The tables behind the dashboard's charts and tiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import labels
from larder.functions.columns import banded, money, month_start, paired_tier, percent, ratio, rounded, year_month
from larder.operators.policy import READS, policy_rows
from larder.plans.operator import Tables, operator

MONDAY = date(2024, 1, 1)


def mean_quantity() -> Column:
    return ratio(F.sum("quantity_fulfilled"), F.count("quantity_fulfilled"))


def stockouts() -> Column:
    return F.count_if(F.col("backorder_quantity") > 0)


def revenue() -> Column:
    return money(F.sum("revenue_cents"))


@operator(sales="date quantity_fulfilled revenue_cents")
def daily_sales(t: Tables) -> DataFrame:
    """Revenue and units per day."""
    return t["sales"].groupBy("date").agg(
        revenue().alias("revenue"), F.sum("quantity_fulfilled").alias("quantity_fulfilled")
    ).orderBy("date")


@operator(sales="date quantity_fulfilled")
def year_month_units(t: Tables) -> DataFrame:
    """Units per year and month."""
    return t["sales"].groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("quantity_fulfilled").alias("quantity_fulfilled")
    ).orderBy("year", "month")


@operator(sales="date quantity_fulfilled")
def avg_by_month(t: Tables) -> DataFrame:
    """Mean sold quantity per sales row and month of the year, with the month's short name."""
    return t["sales"].groupBy(F.month("date").alias("month")).agg(mean_quantity().alias("avg_quantity")).withColumn(
        "month_name", F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMM")
    ).orderBy("month")


@operator(sales="category quantity_fulfilled revenue_cents")
def category_sales_desc(t: Tables) -> DataFrame:
    """Revenue and units per category, highest revenue first."""
    return t["sales"].groupBy("category").agg(
        revenue().alias("revenue"), F.sum("quantity_fulfilled").alias("quantity_fulfilled")
    ).orderBy(F.desc("revenue"), "category")


def _pareto(top: DataFrame, value: str, *keys: str) -> DataFrame:
    """Running share within the rows given. They are cut to the top n before, and sorted in one task:
    ``top`` has to stay a number that a chart can show."""
    order = Window.orderBy(F.desc(value), *keys)
    running = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("cumulative_pct", percent(running, F.sum(value).over(Window.partitionBy())))


@operator(current_inventory="sku_id warehouse_id total_value_cents", sku_master="sku_id product_name category")
def pareto_top_n(t: Tables, *, top: int = 50) -> DataFrame:
    """The most valuable stock lines and their running share within that list."""
    rows = t["current_inventory"].join(t["sku_master"], "sku_id")
    cut = rows.orderBy(F.desc("total_value_cents"), "sku_id", "warehouse_id").limit(top)
    return _pareto(cut, "total_value_cents", "sku_id", "warehouse_id").select(
        "sku_id", "product_name", "category", "warehouse_id", money("total_value_cents").alias("total_value"),
        "cumulative_pct",
    ).orderBy(F.desc("total_value"), "sku_id", "warehouse_id")


@operator(**READS)
def cost_pareto_top_n(t: Tables, *, top: int = 30, **params: float) -> DataFrame:
    """The most expensive SKUs of the policy and their running share within that list."""
    rows = policy_rows(t, **params).select("sku_id", "total_annual_cost")
    cut = rows.orderBy(F.desc("total_annual_cost"), "sku_id").limit(top)
    return _pareto(cut, "total_annual_cost", "sku_id").withColumn(
        "total_annual_cost", rounded("total_annual_cost")
    )


@operator(supplier_master="supplier_id supplier_name country on_time_delivery_rate quality_rating")
def top_suppliers(t: Tables, *, top: int = 15) -> DataFrame:
    """Most punctual suppliers with their tier in the chart."""
    rate, quality = F.col("on_time_delivery_rate"), F.col("quality_rating")
    return t["supplier_master"].orderBy(rate.desc(), "supplier_id").limit(top).select(
        "supplier_id", "supplier_name", "country", F.round(rate * 100, 1).alias("on_time_pct"), "quality_rating",
        paired_tier(rate, quality, labels.CHART_TIERS, labels.CHART_TIER_REST).alias("tier"),
    )


@operator(sales="category backorder_quantity")
def stockout_rate_by_category(t: Tables) -> DataFrame:
    """Share of sales rows short of stock per category."""
    return t["sales"].groupBy("category").agg(
        stockouts().alias("stockouts"), F.count(F.lit(1)).alias("orders"),
        percent(stockouts(), F.count(F.lit(1))).alias("stockout_rate"),
    ).orderBy(F.desc("stockout_rate"))


@operator(warehouse_master="warehouse_id warehouse_name current_utilization_rate")
def warehouse_utilization_band(t: Tables) -> DataFrame:
    """Warehouses by recorded use, with its band."""
    rate = F.col("current_utilization_rate")
    return t["warehouse_master"].select(
        "warehouse_id", "warehouse_name", F.round(rate * 100, 1).alias("utilization_pct"),
        banded(rate, labels.UTILIZATION_BANDS, labels.UTILIZATION_REST).alias("utilization_band"),
    ).orderBy(F.desc("utilization_pct"), "warehouse_id")


@operator(sales="quantity_ordered quantity_fulfilled backorder_quantity revenue_cents")
def dashboard_kpis(t: Tables) -> DataFrame:
    """Revenue, units, stockout rate and fill rate."""
    return t["sales"].agg(
        revenue().alias("total_revenue"), F.sum("quantity_fulfilled").alias("total_units"),
        percent(stockouts(), F.count(F.lit(1))).alias("stockout_rate"),
        percent(F.sum("quantity_fulfilled"), F.sum("quantity_ordered")).alias("fill_rate"),
    )


@operator(sales="date revenue_cents")
def monthly_revenue(t: Tables) -> DataFrame:
    """Revenue per month."""
    sums = t["sales"].groupBy(month_start("date").alias("start")).agg(revenue().alias("revenue"))
    return sums.select(year_month("start").alias("month"), "revenue").orderBy("month")


@operator(**READS)
def top_cost_drivers(t: Tables, *, top: int = 10, **params: float) -> DataFrame:
    """SKUs with the highest yearly policy cost."""
    cut = policy_rows(t, **params).orderBy(F.desc("total_annual_cost"), "sku_id").limit(top)
    return cut.select("sku_id", "product_name", "category", rounded("total_annual_cost").alias("total_annual_cost"))


@operator(**READS)
def category_cost(t: Tables, **params: float) -> DataFrame:
    """Yearly policy cost per category, lowest first."""
    return policy_rows(t, **params).groupBy("category").agg(
        rounded(F.sum("total_annual_cost")).alias("total_annual_cost")
    ).orderBy("total_annual_cost")


@operator(**READS)
def policy_averages(t: Tables, **params: float) -> DataFrame:
    """Mean order quantity, mean reorder point and total yearly cost."""
    return policy_rows(t, **params).agg(
        F.round(ratio(F.sum("eoq"), F.count("eoq")), 2).alias("avg_eoq"),
        F.round(ratio(F.sum("reorder_point"), F.count("reorder_point")), 2).alias("avg_reorder_point"),
        rounded(F.sum("total_annual_cost")).alias("total_annual_cost"),
    )


@operator(supplier_master="on_time_delivery_rate quality_rating is_preferred")
def supplier_kpis(t: Tables) -> DataFrame:
    """Mean rates, preferred suppliers, and those late too often."""
    return t["supplier_master"].agg(
        F.round(F.avg("on_time_delivery_rate") * 100, 2).alias("avg_on_time_pct"),
        F.round(F.avg("quality_rating"), 2).alias("avg_quality"),
        F.count_if("is_preferred").alias("preferred_suppliers"), F.count(F.lit(1)).alias("suppliers"),
        F.count_if(F.col("on_time_delivery_rate") < 0.70).alias("poor_suppliers"),
    )


@operator(supplier_master="supplier_type")
def supplier_type_distribution(t: Tables) -> DataFrame:
    """Number of suppliers per type, most first."""
    return t["supplier_master"].groupBy("supplier_type").agg(F.count(F.lit(1)).alias("suppliers")).orderBy(
        F.desc("suppliers"), "supplier_type"
    )


@operator(sales="date quantity_fulfilled")
def day_of_week_pattern(t: Tables) -> DataFrame:
    """Mean sold quantity per weekday, Monday first."""
    sums = t["sales"].groupBy((F.weekday("date") + 1).alias("day_number")).agg(mean_quantity().alias("avg_quantity"))
    name = F.date_format(F.date_add(F.lit(MONDAY), F.col("day_number") - 1), "EEEE")
    return sums.select("day_number", name.alias("day_of_week"), "avg_quantity").orderBy("day_number")
