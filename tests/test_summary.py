"""Operators that read the sales summary give what they give on the sales themselves."""

from datetime import date, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from larder.operators import demand, inventory, kpi, service
from larder.plans.catalog import AS_OF
from larder.sources import summary
from larder.sources.star import ALL_COLUMNS, StarViews

SALES = "date date, sku_id string, quantity_ordered long, quantity_fulfilled long, backorder_quantity long"
OPERATORS = {
    "turnover": (inventory.inventory_turnover, {}), "order quantity": (inventory.eoq_sql, {}),
    "slow": (inventory.slow_moving_inventory, {}), "volatility": (demand.demand_volatility, {}),
    "fill rate": (service.fill_rate_analysis, {"min_orders": 0}),
    "fill rate, all dates": (service.fill_rate_analysis, {"lookback_months": None, "min_orders": 2}),
    "figures": (kpi.executive_kpis, {}),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    views = StarViews(spark, SMALL)
    tables = {name: views.table(name, columns) for name, columns in ALL_COLUMNS.items()}
    path = str(tmp_path_factory.mktemp("tables") / "summary")
    summary.write_sales_summary(tables["sales"], path)
    return tables, {**{n: t for n, t in tables.items() if n != "sales"}, summary.NAME: summary.read_sales_summary(spark, path)}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_the_summary_stands_in_for_sales(tables, name):
    op, params = OPERATORS[name]
    plain, short = (op(t, as_of=AS_OF, **params) for t in tables)
    assert plain.dtypes == short.dtypes
    want = rows(plain)
    assert want and rows(short) == want


def test_a_look_back_reads_its_months_alone(tables):
    plan = inventory.inventory_turnover(tables[1], as_of=AS_OF)._jdf.queryExecution().executedPlan().toString()
    scan = next(p for p in plan.splitlines() if "FileScan" in p and "sales_month" in p)
    assert "PartitionFilters: [isnotnull(sales_month" in scan and "2000-11" in scan
    assert "fulfilled_squares" not in scan and "backorder" not in scan


def test_nulls_hot_skus_and_empty_tables(make, spark, tmp_path):
    day = date(2024, 1, 31)
    sales = make(SALES, *[(day + timedelta(i % 3), "hot", 5, 5 - i % 2, i % 2) for i in range(300)],
                 (day, "none", None, None, None), (None, "undated", 1, 1, 0), (day, None, 2, 2, 0))
    got = {(r.sku_id, r.date): r for r in summary.summarized(sales).collect()}
    assert len(got) == 6 and sum(r.sales_rows for r in got.values()) == 303
    none = got["none", day]
    assert (none.sales_rows, none.fulfilled_rows, none.quantity_fulfilled, none.short_rows, none.backorder_rows) == (1, 0, None, 0, 0)
    hot = got["hot", day]
    assert (hot.sales_rows, hot.quantity_fulfilled, hot.fulfilled_squares, hot.short_rows, hot.fulfilled_min, hot.fulfilled_max) == (100, 450, 2050, 50, 4, 5)
    path = str(tmp_path / "empty")
    summary.write_sales_summary(sales.limit(0), path)
    assert summary.summarized(sales.limit(0)).count() == 0


def test_single_months_are_replaced(make, spark, tmp_path):
    path = str(tmp_path / "summary")
    old = make(SALES, *((date(2024, m, 3), "a", 9, 9, 0) for m in (1, 2, 3)))
    summary.write_sales_summary(old, path)
    new = make(SALES, *((date(2024, m, 4), "b", 2, 1, 1) for m in (1, 2, 3)))
    summary.write_sales_summary(new, path, months=(date(2024, 2, 20), date(2024, 2, 20)))
    got = summary.read_sales_summary(spark, path).orderBy("date").select("sku_id", "date").collect()
    assert [(r.sku_id, r.date) for r in got] == [("a", date(2024, 1, 3)), ("b", date(2024, 2, 4)), ("a", date(2024, 3, 3))]
    assert summary.since(summary.read_sales_summary(spark, path), F.lit(date(2024, 2, 1))).count() == 2
