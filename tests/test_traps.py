"""Hand-made frames for the cases where engines differ."""

import math
from datetime import date

from pyspark.sql import functions as F

import pytest
from pyspark.sql import functions as F
from larder.functions.columns import monday_week, stddev_pop_exact, stddev_samp_exact, sunday_weekday
from larder.functions.running import running_total_desc
from larder.operators import bom, demand, inventory, kpi, models, policy, profit, quality, service, supplier

DAY = date(2024, 6, 15)
SALES = ("date date, sku_id string, category string, quantity_ordered long, quantity_fulfilled long, "
         "backorder_quantity long, unit_price_cents long, revenue_cents long")


def sale(day, sku, ordered, fulfilled, price=1000, category="c"):
    return (day, sku, category, ordered, fulfilled, ordered - fulfilled, price, fulfilled * price)


def master(make, *skus):
    return make("sku_id string, product_name string, category string, unit_cost_cents long, unit_price_cents long, "
                "lead_time_days int, carrying_cost_rate double",
                *((s, f"name {s}", "c", 500, 1000, 9, 0.2) for s in skus))


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def stock(make, *rows):
    return make("sku_id string, warehouse_id string, quantity_on_hand long, reorder_point long, safety_stock long, "
                "unit_cost_cents long, total_value_cents long",
                *((s, w, q, 10, 5, 500, q * 500) for s, w, q in rows))


def test_running_total_shares_ties_and_spans_digits(make, spark):
    values = [5, 5, 70_000, 3, 2**33, 2**33 + 1, 0, 65_536, 65_535, 70_000]
    df = make("v long", *((v,) for v in values))
    got = sorted((r.v, r.run, r.total) for r in running_total_desc(df, "v", "run", "total").collect())
    assert got == sorted((v, sum(x for x in values if x >= v), sum(values)) for v in values)


def test_abc_digits_equal_window(spark, make):
    t = {"current_inventory": stock(make, *((f"s{i}", "w", (i * 7919) % 97) for i in range(200))),
         "sku_master": master(make, *(f"s{i}" for i in range(200)))}
    one = inventory.abc_classification(t).collect()
    two = inventory.abc_classification(t, method="window").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    shares = sorted(r.cumulative_pct for r in one)
    assert shares[-1] == 100.0


def test_slow_stock_without_and_with_zero_sales(make):
    t = {"sales": make(SALES, sale(date(2024, 6, 1), "zero", 5, 0), sale(date(2024, 6, 1), "sold", 90, 90)),
         "sku_master": master(make, "zero", "sold", "none"),
         "current_inventory": stock(make, ("zero", "w", 10), ("sold", "w", 181), ("none", "w", 10))}
    rows = by(inventory.slow_moving_inventory(t, as_of=DAY), "sku_id")
    assert (rows["none"].days_of_inventory, rows["none"].inventory_status) == (999.0, "No Sales (Obsolete)")
    assert (rows["zero"].days_of_inventory, rows["zero"].inventory_status) == (999.0, "Normal")
    assert (rows["sold"].days_of_inventory, rows["sold"].inventory_status) == (181.0, "Excess (>180 days)")
    assert rows["sold"].days_since_last_sale == 14


def test_turnover_without_sales_is_slowest(make):
    t = {"sales": make(SALES, sale(date(2024, 6, 1), "a", 13, 13)), "sku_master": master(make, "a", "b"),
         "warehouse_master": make("warehouse_id string, warehouse_name string", ("w", "W"), ("x", "X")),
         "current_inventory": stock(make, ("a", "w", 1), ("a", "x", 3), ("b", "w", 1))}
    rows = by(inventory.inventory_turnover(t, as_of=DAY), "sku_id", "warehouse_id")
    assert rows["a", "w"].movement_category == "Fast Moving" and rows["a", "w"].inventory_turnover_ratio == 13.0
    assert rows["a", "x"].inventory_turnover_ratio == 4.33
    assert rows["b", "w"].inventory_turnover_ratio is None
    assert rows["b", "w"].movement_category == "Very Slow / Obsolete"
    split = by(inventory.inventory_turnover(t, as_of=DAY, apportion=True), "sku_id", "warehouse_id")
    assert split["a", "w"].inventory_turnover_ratio == split["a", "x"].inventory_turnover_ratio == 3.25


def test_volatility_of_zero_mean_is_low(make):
    t = {"sales": make(SALES, sale(date(2024, 6, 1), "z", 5, 0), sale(date(2024, 6, 2), "z", 5, 0),
                       sale(date(2024, 6, 1), "one", 4, 4)), "sku_master": master(make, "z", "one")}
    rows = by(demand.demand_volatility(t, as_of=DAY), "sku_id")
    assert rows["z"].coefficient_of_variation is None and rows["z"].volatility_category == "Low Volatility"
    assert rows["one"].stddev_demand == 0.0


def test_exact_deviations(make):
    row = make("n long, t long, s long", (4, 20, 120), (1, 7, 49)).select(
        "n", stddev_pop_exact("n", "t", "s").alias("p"), stddev_samp_exact("n", "t", "s").alias("q")).collect()
    assert row[0].p == math.sqrt(5) and math.isclose(row[0].q, math.sqrt(20 / 3))
    assert row[1].p == 0.0 and row[1].q is None


def test_weeks_and_weekdays(make):
    days = {date(2024, 1, 7): 1, date(2024, 1, 8): 2, date(2024, 12, 31): 53, date(2023, 1, 1): 0}
    df = make("d date", *((d,) for d in days)).select("d", monday_week("d").alias("w"), sunday_weekday("d").alias("s"))
    for r in df.collect():
        assert r.w == days[r.d] and r.s == (r.d.weekday() + 1) % 7


def test_fill_rate_needs_more_than_ten_orders(make):
    rows = [sale(date(2024, 6, 1), "eleven", 10, 9) for _ in range(11)] + [sale(DAY, "ten", 1, 1)] * 10
    t = {"sales": make(SALES, *rows), "sku_master": master(make, "eleven", "ten")}
    out = service.fill_rate_analysis(t, as_of=DAY).collect()
    assert [(r.sku_id, r.fill_rate_pct, r.lost_revenue_estimate) for r in out] == [("eleven", 90.0, 110.0)]
    assert out[0].service_level_status == "Below Target (90-95%)"


PO = ("supplier_id string, sku_id string, actual_delivery_date date, on_time boolean, quality_accepted boolean, "
      "order_quantity long, received_quantity long, total_cost_cents long, lead_time_actual long, lead_time_expected long")


def test_root_cause_modes(make):
    late, fine = date(2024, 3, 20), date(2024, 9, 1)
    t = {"sales": make(SALES, sale(date(2024, 4, 1), "a", 5, 3), sale(date(2024, 4, 1), "a", 5, 4),
                       sale(date(2024, 8, 1), "a", 5, 0), sale(date(2024, 4, 1), "b", 5, 3)),
         "sku_master": master(make, "a", "b"),
         "purchase_orders": make(PO, ("s", "a", late, False, True, 1, 1, 1, 1, 1), ("s", "a", fine, False, True, 1, 1, 1, 1, 1),
                                 ("s", "a", fine, True, True, 1, 1, 1, 1, 1))}
    rows = by(service.stockout_root_cause(t), "sku_id")
    # April rows match all three orders, August the last two; two of the orders are late.
    assert rows["a"].total_backorder_units == 2 * 3 + 1 * 3 + 5 * 2
    assert rows["a"].supplier_delays_count == 2 + 2 + 1
    assert rows["a"].num_stockout_days == 2 and rows["a"].pct_due_to_supplier_delay == 250.0
    assert (rows["b"].total_backorder_units, rows["b"].primary_root_cause) == (2, "Forecast Error")
    bounded = by(service.stockout_root_cause(t, mode="bounded"), "sku_id")
    assert bounded["a"].supplier_delays_count == 1 and bounded["a"].total_backorder_units == 8


def test_supplier_without_orders_is_last_and_worst(make):
    t = {"supplier_master": make("supplier_id string, supplier_name string, supplier_type string, country string",
                                 ("s", "S", "t", "c"), ("n", "N", "t", "c")),
         "purchase_orders": make(PO, ("s", "a", DAY, True, True, 10, 8, 100_00, 70, 60))}
    out = supplier.supplier_scorecard_po(t).collect()
    assert [r.supplier_id for r in out] == ["s", "n"]
    assert out[0].composite_score == 98.0 and out[1].composite_score is None
    assert out[1].supplier_tier == "Tier 4 - Poor (Review Required)"
    cost = supplier.supplier_tco(t).collect()
    assert cost[0].total_cost_of_ownership == 200.0 and cost[0].hidden_cost_pct == 100.0
    assert cost[1].total_cost_of_ownership is None


def test_warehouse_without_stock(make):
    t = {"warehouse_master": make("warehouse_id string, warehouse_name string, city string, capacity_units long, "
                                  "monthly_operating_cost_cents long", ("w", "W", "x", 100, 1000), ("e", "E", "x", 100, 1000)),
         "current_inventory": stock(make, ("a", "w", 95))}
    rows = by(service.warehouse_efficiency(t), "warehouse_id")
    assert rows["e"].efficiency_status == "Optimal Utilization" and rows["e"].cost_per_unit_stored is None
    assert rows["w"].efficiency_status == "Over Capacity - Expansion Needed"


def test_bom_cycle_stops_at_depth(make):
    t = {"bom": make("parent_sku string, component_sku string, quantity_per long", ("a", "b", 2), ("b", "a", 3)),
         "sku_master": master(make, "a", "b")}
    out = bom.bom_explosion(t).collect()
    assert len(out) == 10 and max(r.level for r in out) == 5
    assert {r.total_quantity_needed for r in out if r.level == 5} == {2 * 3 * 2 * 3 * 2, 3 * 2 * 3 * 2 * 3}


def test_bom_with_unknown_component_goes_on_below(make):
    t = {"bom": make("parent_sku string, component_sku string, quantity_per long", ("a", "x", 2), ("x", "b", 3)),
         "sku_master": master(make, "a", "b")}
    assert [(r.root_product, r.component_sku, r.level) for r in bom.bom_explosion(t).collect()] == [("a", "b", 2)]


def test_kpi_turnover_modes(make):
    t = {"sales": make(SALES, sale(date(2024, 6, 1), "a", 8, 8), sale(date(2024, 6, 1), "none", 8, 8)),
         "sku_master": master(make, "a", "none"), "current_inventory": stock(make, ("a", "w", 1), ("a", "x", 3)),
         "supplier_master": make("on_time_delivery_rate double", (0.5,), (1.0,))}
    reference = by(kpi.executive_kpis(t, as_of=DAY), "metric")
    corrected = by(kpi.executive_kpis(t, as_of=DAY, mode="corrected"), "metric")
    assert reference["Average Inventory Turnover"].value == 8.0  # 8 units twice, over a mean of 2
    assert corrected["Average Inventory Turnover"].value == 2.0
    assert reference["Total Inventory Value"].value_text == "$20.00"


def test_policy_comparison_without_stock(make):
    t = {"sales": make(SALES, sale(DAY, "a", 8, 8), sale(DAY, "n", 8, 8)), "sku_master": master(make, "a", "n"),
         "current_inventory": stock(make, ("a", "w", 100), ("a", "x", 100))}
    rows = policy.policy_comparison(t).collect()
    assert [r.sku_id for r in rows] == ["a", "a", "n"] and rows[-1].potential_savings is None
    fixed = policy.policy_comparison(t, mode="corrected").collect()
    assert [r.sku_id for r in fixed] == ["a", "n"] and fixed[-1].potential_savings < 0
    assert fixed[0].reorder_point_current == 20


def test_single_sale_takes_a_tenth_as_deviation(make):
    t = {"sales": make(SALES, sale(DAY, "a", 8, 8)), "sku_master": master(make, "a")}
    assert policy.demand_statistics(t).collect()[0].std_daily_demand == 0.8


def test_quality_counts_copies_and_gaps(make):
    df = make("a long, b double", (1, 1.0), (1, 1.0), (1, 1.0), (2, None), (3, float("nan")))
    row = quality.data_quality({"x": df}).collect()[0]
    assert (row.rows, row.missing_values, row.duplicates, row.missing_pct, row.high_missing) == (5, 2, 2, 20.0, True)
    assert quality.data_quality({"x": df.limit(0)}).collect()[0].rows == 0


def test_change_from_zero_is_null(make):
    t = {"sales": make(SALES, sale(date(2024, 1, 5), "a", 5, 0), sale(date(2024, 2, 5), "a", 5, 5)),
         "sku_master": master(make, "a")}
    rows = by(profit.mom_change(t), "year_month")
    assert rows[date(2024, 2, 1)].revenue_mom_change is None


def test_margin_rule(make):
    df = make("p double, r double", (-1.0, 10.0), (3.0, 10.0), (1.5, 10.0), (5.0, 0.0), (9.0, 10.0))
    got = [r.x for r in df.select(models.margin_rule(F.col("p"), F.col("r")).alias("x")).collect()]
    assert got == [1.0, 0.0, 0.5, 1.0, 0.0]


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_quality_deals_no_rows_before_it_knows_which_repeat(make, monkeypatch, words):
    monkeypatch.setattr(quality, "WORDS", words)  # with one word most rows pass the filter, and the result is the same
    df = make("a long, b string", *((k % 90, "x" if k % 90 < 40 else str(k)) for k in range(180)))
    assert quality.data_quality({"x": df}).collect()[0].duplicates == 40
    rows = df.withColumns({"_d1": F.xxhash64("a", "b"), "_d2": F.xxhash64("b", "a")})
    marks = rows.groupBy("_d1", "_d2").count().filter("count > 1")
    passed = quality.may_repeat(rows, marks)
    assert passed.filter("a < 40").count() == 80 and (words == 1 or passed.count() == 80)
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
