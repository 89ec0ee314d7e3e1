"""Monthly profit and its features deal out sales once and sort an entity's months once."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larder.operators import profit


@pytest.fixture
def tables(spark):
    sales = "date date, sku_id long, category string, quantity_ordered long, quantity_fulfilled long, backorder_quantity long, unit_price_cents long, revenue_cents long"
    rows = [(date(2000, m, 3), sku, "a" if sku < 3 else "b", 10, 9, 1, 500 + sku, 9 * (500 + sku) + m) for m in range(1, 9) for sku in (1, 2, 3) if (m, sku) != (4, 3)]
    rows += [(None, 1, "a", 1, 1, 0, 501, 501), (date(2000, 2, 9), None, None, 1, 1, 0, None, None), (date(2000, 2, 9), 9, "b", 2, 2, 0, None, None)]
    master = [(1, 300, 0.15), (2, 310, 0.16), (2, 320, 0.16), (3, None, 0.17)]  # 2 comes twice, 3 has no cost, 9 is missing
    return {"sales": spark.createDataFrame(rows, sales), "sku_master": spark.createDataFrame(master, "sku_id long, unit_cost_cents long, carrying_cost_rate double")}


@pytest.fixture
def no_broadcast(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sku_features_use_one_shuffle_of_sales(tables, no_broadcast):
    prices = tables["sku_master"].select("sku_id", F.lit(500).cast("long").alias("unit_price_cents"))
    sales = tables["sales"].drop("unit_price_cents").join(prices, "sku_id", "left")  # sales meet the parts for their price
    executed = plan(profit.features({**tables, "sales": sales}, "sku_id", False, 3))
    assert executed.count("Exchange hashpartitioning") == 3  # sales, prices and master data, for the joins
    assert executed.count("Window [") == 2  # months in order, and the median of all


def test_sales_of_wide_entities_are_summed_at_once(tables, no_broadcast):
    executed = plan(profit.monthly(tables, "category"))
    assert executed.count("HashAggregate(") == 2  # in the task, and by entity and month


def test_monthly_sums_of_odd_rows(tables):
    def of(by):
        return {(r["entity"], r["year_month"]): r for r in profit.monthly(tables, by).collect()}

    skus, categories = of("sku_id"), of("category")
    assert dict(profit.monthly(tables, "sku_id").dtypes)["entity"] == "string"
    month = date(2000, 2, 1)
    assert skus["2", month]["revenue"] == 2 * (9 * 502 + 2) / 100  # as often as its master data
    assert skus["2", month]["cogs"] == 9 * (310 + 320) / 100
    assert skus["3", month]["cogs"] is None and skus[None, month]["revenue"] is None and ("1", None) in skus
    both = skus["1", month]["revenue"] + skus["2", month]["revenue"]
    assert categories["a", month]["revenue"] == pytest.approx(both)
    assert categories["a", month]["unit_cost"] == pytest.approx((300 + 310 + 320) / 300)
    assert categories["b", month]["unit_price"] == pytest.approx(5.03)  # SKU 9 has no price
    assert categories["b", month]["unit_cost"] is None


def test_features_equal_the_steps_one_by_one(tables):
    rows = profit.with_target(profit.monthly(tables, "sku_id"), 3)
    for step in (profit.add_lags, profit.add_rolling, profit.add_changes, profit.add_calendar, profit.add_cost_ratios):
        rows = rows.transform(step)
    wanted = profit.add_risk_flags(rows).na.drop("any", subset=[c for c in rows.columns if c not in profit.TARGETS.values()])
    found = profit.features(tables, "sku_id", False, 3)
    assert found.columns == wanted.columns and found.dtypes == wanted.dtypes
    by = ("entity", "year_month")
    assert found.orderBy(*by).collect() == wanted.orderBy(*by).collect() != []
    assert found.filter(F.col("entity") == "2").count() == 5
