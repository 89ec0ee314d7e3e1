"""Exploratory figures on sales, stock and suppliers."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.functions.columns import money, month_start, percent, ratio, year_month
from larder.functions.report import dollars, key_values, with_percent
from larder.plans.operator import Tables, operator


def everything() -> WindowSpec:
    """Window over all rows; used on grouped rows only: months, categories."""
    return Window.partitionBy()


def _stockout_share() -> Column:
    return percent(F.count_if(F.col("backorder_quantity") > 0), F.count(F.lit(1)), None)


@operator(sales="date quantity_fulfilled revenue_cents")
def sales_totals(t: Tables) -> DataFrame:
    """Revenue, units, mean order value and date range."""
    return t["sales"].agg(
        money(F.sum("revenue_cents")).alias("total_revenue"),
        F.sum("quantity_fulfilled").alias("total_units"),
        F.round(ratio(F.sum("revenue_cents"), F.count("revenue_cents")) / 100, 2).alias("avg_order_value"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


@operator(sales="date quantity_fulfilled revenue_cents")
def report_kv(t: Tables) -> DataFrame:
    """The sales totals as (metric, value) text rows."""
    return key_values(
        sales_totals(t),
        Total_Revenue=dollars(F.col("total_revenue")), Total_Units=F.col("total_units"),
        Average_Order_Value=dollars(F.col("avg_order_value")),
        Date_Range=F.concat_ws(" to ", "first_date", "last_date"),
    )


@operator(sales="date quantity_fulfilled backorder_quantity revenue_cents")
def monthly_sales_trends(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Revenue, units and backorders per month."""
    sums = t["sales"].groupBy(month_start("date").alias("start")).agg(
        money(F.sum("revenue_cents")).alias("revenue"),
        F.sum("quantity_fulfilled").alias("quantity_fulfilled"),
        F.sum("backorder_quantity").alias("backorder_quantity"),
    )
    # Dates are the key of the sum and become text once a month, not once a row.
    result = sums.select(year_month("start").alias("month"), "revenue", "quantity_fulfilled", "backorder_quantity")
    return result.orderBy("month") if ordered else result


@operator(sales="date revenue_cents")
def monthly_sales_summary(t: Tables) -> DataFrame:
    """Mean, highest and lowest revenue of a month."""
    months = t["sales"].groupBy(month_start("date").alias("month")).agg(F.sum("revenue_cents").alias("c"))
    return months.agg(
        F.round(ratio(F.sum("c"), F.count("c")) / 100, 2).alias("avg_monthly_revenue"),
        money(F.max("c")).alias("peak_month_revenue"), money(F.min("c")).alias("lowest_month_revenue"),
    )


@operator(sales="date quantity_fulfilled")
def seasonal_pattern(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Mean sold quantity per sales row and month of the year, with peak, low and their ratio."""
    months = t["sales"].groupBy(F.month("date").alias("month")).agg(
        ratio(F.sum("quantity_fulfilled"), F.count("quantity_fulfilled")).alias("avg_quantity")
    )
    avg = F.col("avg_quantity")
    result = months.select(
        "month", "avg_quantity",
        F.max_by("month", avg).over(everything()).alias("peak_month"), F.min_by("month", avg).over(everything()).alias("low_month"),
        F.round(F.try_divide(F.max(avg).over(everything()), F.min(avg).over(everything())), 2).alias("seasonal_variation"),
    )
    return result.orderBy("month") if ordered else result


@operator(sales="category quantity_fulfilled revenue_cents")
def category_performance(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Revenue, units, share and rank of each category."""
    groups = t["sales"].groupBy("category").agg(
        F.sum("revenue_cents").alias("c"), F.sum("quantity_fulfilled").alias("quantity_fulfilled")
    )
    result = groups.select(
        "category", money("c").alias("revenue"), "quantity_fulfilled",
        percent("c", F.sum("c").over(everything())).alias("pct_of_revenue"),
        F.row_number().over(Window.orderBy(F.desc("c"), "category")).alias("revenue_rank"),
    )
    return result.orderBy("revenue_rank") if ordered else result


@operator(sales="backorder_quantity unit_price_cents")
def stockout_summary(t: Tables) -> DataFrame:
    """Share of rows short of stock, missing units, and those at the mean price."""
    units = F.sum("backorder_quantity")
    mean_price = ratio(F.sum("unit_price_cents"), F.count("unit_price_cents"))
    return t["sales"].agg(
        F.round(_stockout_share(), 2).alias("stockout_rate_pct"), units.alias("total_backorder_units"),
        F.round(units * mean_price / 100, 2).alias("estimated_lost_revenue"),
    )


@operator(current_inventory="quantity_on_hand total_value_cents")
def inventory_position(t: Tables) -> DataFrame:
    """Value and units of all stock and the mean cost of a unit."""
    value, held = F.sum("total_value_cents"), F.sum("quantity_on_hand")
    return t["current_inventory"].agg(
        money(value).alias("total_inventory_value"), held.alias("total_units"),
        F.round(ratio(value, held) / 100, 2).alias("avg_unit_cost"),
    )


@operator(current_inventory="warehouse_id quantity_on_hand total_value_cents")
def top_warehouses(t: Tables, *, top: int = 5) -> DataFrame:
    """Warehouses with the most stock value and their share of all stock value."""
    groups = t["current_inventory"].groupBy("warehouse_id").agg(
        F.sum("quantity_on_hand").alias("quantity_on_hand"), F.sum("total_value_cents").alias("c")
    )
    share = percent("c", F.sum("c").over(everything()))  # one row per warehouse
    return groups.withColumn("pct_of_total", share).orderBy(F.desc("c"), "warehouse_id").limit(top).select(
        "warehouse_id", "quantity_on_hand", money("c").alias("total_value"), "pct_of_total"
    )


def _stock_subset(stock: DataFrame, condition: Column) -> DataFrame:
    value = F.coalesce(F.sum(F.when(condition, F.col("total_value_cents"))), F.lit(0))
    return stock.agg(
        F.count_if(condition).alias("items"), percent(F.count_if(condition), F.count(F.lit(1))).alias("pct_of_items"),
        money(value).alias("total_value"),
    )


@operator(current_inventory="quantity_on_hand reorder_point total_value_cents")
def below_reorder_point(t: Tables) -> DataFrame:
    """Stock lines under their reorder point."""
    return _stock_subset(t["current_inventory"], F.col("quantity_on_hand") < F.col("reorder_point"))


@operator(current_inventory="quantity_on_hand safety_stock total_value_cents")
def excess_inventory(t: Tables, *, factor: int = 3) -> DataFrame:
    """Stock lines above ``factor`` times their safety stock."""
    return _stock_subset(t["current_inventory"], F.col("quantity_on_hand") > F.col("safety_stock") * factor)


def best_tier() -> Column:
    return (F.col("on_time_delivery_rate") >= 0.95) & (F.col("quality_rating") >= 4.5)


def worst_tier() -> Column:
    return (F.col("on_time_delivery_rate") < 0.70) | (F.col("quality_rating") < 3.5)


@operator(supplier_master="on_time_delivery_rate quality_rating")
def supplier_tier_counts(t: Tables) -> DataFrame:
    """Mean rates, and how many suppliers are in the best and the worst tier."""
    n = F.count(F.lit(1))
    return t["supplier_master"].agg(
        n.alias("suppliers"),
        F.round(F.avg("on_time_delivery_rate") * 100, 2).alias("avg_on_time_pct"),
        F.round(F.avg("quality_rating"), 2).alias("avg_quality_rating"),
        F.count_if(best_tier()).alias("tier_1_count"), percent(F.count_if(best_tier()), n).alias("tier_1_pct"),
        F.count_if(worst_tier()).alias("tier_4_count"), percent(F.count_if(worst_tier()), n).alias("tier_4_pct"),
    )


@operator(supplier_master="country on_time_delivery_rate quality_rating")
def supplier_by_country(t: Tables, *, ordered: bool = True) -> DataFrame:
    """Mean rates (three decimals, half to even) and number of suppliers per country."""
    result = t["supplier_master"].groupBy("country").agg(
        F.bround(F.round(F.avg("on_time_delivery_rate"), 9), 3).alias("avg_on_time_rate"),
        F.bround(F.round(F.avg("quality_rating"), 9), 3).alias("avg_quality"),
        F.count(F.lit(1)).alias("num_suppliers"),
    )
    return result.orderBy(F.desc("avg_on_time_rate")) if ordered else result


@operator(
    sales="date quantity_fulfilled backorder_quantity revenue_cents",
    current_inventory="quantity_on_hand reorder_point safety_stock total_value_cents",
    supplier_master="on_time_delivery_rate quality_rating",
)
def insights(t: Tables) -> DataFrame:
    """Findings in words, numbered; those about counts appear only where the count is positive."""
    # One scan of sales: per month first, then the year's months.
    months = t["sales"].groupBy(month_start("date").alias("ym"), F.month("date").alias("month")).agg(
        F.sum("revenue_cents").alias("c"), F.sum("quantity_fulfilled").alias("q"),
        F.count("quantity_fulfilled").alias("n"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("backorder_quantity") > 0).alias("outs"),
    )
    seasons = months.groupBy("month").agg(
        F.sum("c").alias("c"), ratio(F.sum("q"), F.sum("n")).alias("avg"), F.sum("rows").alias("rows"),
        F.sum("outs").alias("outs"), F.count(F.lit(1)).alias("months"),
    )
    sold = seasons.agg(
        money(F.sum("c")).alias("revenue"), F.sum("months").alias("months"), F.max_by("month", "avg").alias("peak"),
        F.try_divide(F.max("avg"), F.min("avg")).alias("variation"),
        percent(F.sum("outs"), F.sum("rows"), None).alias("out_pct"),
    )
    low = F.col("quantity_on_hand") < F.col("reorder_point")
    high = F.col("quantity_on_hand") > F.col("safety_stock") * 3
    stock = t["current_inventory"].agg(
        money(F.sum("total_value_cents")).alias("value"), F.count_if(low).alias("low"), F.count_if(high).alias("high"),
        money(F.sum(F.when(high, F.col("total_value_cents")))).alias("excess"),
    )
    tiers = t["supplier_master"].agg(F.count_if(worst_tier()).alias("poor"))
    lines = (
        (sold, 1, None, F.format_string("Total revenue over %d months: $%,.2f", "months", "revenue")),
        (sold, 2, None, F.format_string("Demand peaks in month %d with %.2fx variation", "peak", "variation")),
        (sold, 3, None, F.format_string(
            "Stockout rate of %.1f%% indicates inventory optimization opportunity", "out_pct")),
        (stock, 4, None, F.format_string("Current inventory value: $%,.2f", "value")),
        (stock, 5, F.col("low") > 0, F.format_string(
            "%d items below reorder point - immediate action required", "low")),
        (stock, 6, F.col("high") > 0, F.format_string(
            "$%,.2f in excess inventory - potential cost reduction", "excess")),
        (tiers, 7, F.col("poor") > 0, F.format_string(
            "%d suppliers in Tier 4 - review and potentially replace", "poor")),
    )

    def said(source: DataFrame) -> DataFrame:
        made = [F.struct(F.lit(i).alias("position"), (F.when(cond, text) if cond is not None else text).alias("insight"))
                for df, i, cond, text in lines if df is source]
        return source.select(F.explode(F.array(*made)).alias("r")).select("r.*").filter("insight IS NOT NULL")

    return reduce(DataFrame.unionByName, map(said, (sold, stock, tiers)))


@operator(
    sales="date quantity_ordered quantity_fulfilled backorder_quantity revenue_cents",
    current_inventory="total_value_cents", sku_master="sku_id", warehouse_master="warehouse_id",
    supplier_master="supplier_id",
)
def executive_summary(t: Tables, *, as_of: date) -> DataFrame:
    """Ten headline values as text."""
    sold = t["sales"].agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"),
        money(F.sum("revenue_cents")).alias("revenue"),
        percent(F.sum("quantity_fulfilled"), F.sum("quantity_ordered"), None).alias("fill"),
        _stockout_share().alias("out_pct"),
    )
    value = t["current_inventory"].agg(money(F.sum("total_value_cents"))).scalar()

    def size(name: str) -> Column:
        return t[name].agg(F.count(F.lit(1))).scalar()

    return key_values(
        sold,
        Report_Generated=F.lit(as_of),
        Data_Period=F.concat_ws(" to ", "first", "last"),
        Total_SKUs=size("sku_master"), Total_Warehouses=size("warehouse_master"),
        Total_Suppliers=size("supplier_master"),
        Total_Sales_Transactions=F.col("n"),
        Total_Revenue=dollars(F.col("revenue")), Total_Inventory_Value=dollars(value),
        Average_Fill_Rate=with_percent(F.col("fill")), Stockout_Rate=with_percent(F.col("out_pct")),
    )
