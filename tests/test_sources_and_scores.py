"""Files in and out, and the scores and alerts on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larder.operators import forecast, models, profit
from larder.sources import files


def test_csv_is_read_by_schema_as_cents(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "date,sku_id,category,quantity_ordered,quantity_fulfilled,backorder_quantity,unit_price,revenue,"
        "customer_segment,region\n2024-01-31,A,c,5,4,1,1.15,4.6,Retail,East\n")
    row = files.read_csv(spark, str(tmp_path / "s.csv"), "sales").first()
    assert (row.date, row.unit_price_cents, row.revenue_cents, row.backorder_quantity) == (date(2024, 1, 31), 115, 460, 1)


def test_csv_with_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "b.csv").write_text("parent_sku,other,quantity_per,is_critical\nA,B,1,True\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "b.csv"), "bom").collect()


def test_json_array_and_lines(spark, tmp_path):
    record = ('{"po_number": "P1", "order_date": "2024-01-01", "sku_id": "A", "supplier_id": "S", "order_quantity": 5, '
              '"received_quantity": 5, "unit_cost": 2.5, "total_cost": 12.5, "on_time": true, "quality_accepted": false}')
    (tmp_path / "a.json").write_text(f"[{record},\n {record}]")
    (tmp_path / "l.json").write_text(f"{record}\n{record}\n")
    array = files.load_files(spark, {"purchase_orders": str(tmp_path / "a.json")})["purchase_orders"].collect()
    lines = files.read_json_records(spark, str(tmp_path / "l.json"), "purchase_orders", array_file=False).collect()
    assert array == lines and len(array) == 2
    assert array[0].total_cost_cents == 1250 and array[0].on_time and array[0].order_date == date(2024, 1, 1)


def test_promotion_categories_become_a_list(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        'promotion_name,start_date,end_date,discount_rate,expected_demand_lift,categories_included\n'
        'Sale,2024-01-01,2024-01-15,0.3,1.69,"A,B"\n')
    assert files.read_csv(spark, str(tmp_path / "p.csv"), "promotional_calendar").first().categories_included == ["A", "B"]


def test_malformed_numbers_are_an_error(spark, tmp_path):
    (tmp_path / "b.csv").write_text("parent_sku,component_sku,quantity_per,is_critical\nA,B,x1,True\nA,C,2,1\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|convert|x1"):
        files.read_csv(spark, str(tmp_path / "b.csv"), "bom").collect()
    kept = files.read_csv(spark, str(tmp_path / "b.csv"), "bom", strict=False)
    assert [(r.quantity_per, r.is_critical) for r in kept.orderBy("component_sku").collect()] == [(None, True), (2, True)]
    assert tuple(files.corrupt_rows(kept).first()) == (2, 1)


def test_spellings_of_booleans(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"on_time": "true", "quality_accepted": 0}\n{"on_time": 1, "quality_accepted": "No"}\n{"on_time": true}\n')
    rows = files.read_json_records(spark, str(tmp_path / "p.json"), "purchase_orders", array_file=False)
    assert [(r.on_time, r.quality_accepted) for r in rows.collect()] == [(True, False), (True, False), (True, None)]
    (tmp_path / "q.json").write_text('{"on_time": "maybe"}\n')
    with pytest.raises(Exception, match="no boolean"):
        files.read_json_records(spark, str(tmp_path / "q.json"), "purchase_orders", array_file=False).collect()


def test_text_that_is_no_date_is_null_and_counted(make):
    df = make("d string", ("2024-03-01xyz",), ("2024-03-01",), (None,))
    assert [r.d for r in files.parse_dates(df, "d").collect()] == [None, date(2024, 3, 1), None]
    assert files.unparsed(df, "d").first().d == 1


def test_report_by_class(make):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 4
    got = {r["class"]: (r.precision_pct, r.recall_pct, r.f1_pct, r.support) for r in models.class_report(make("label int, prediction int", *rows)).collect()}
    assert got == {0: (60.0, 75.0, 66.67, 4), 1: (80.0, 66.67, 72.73, 6)}


def test_dates_from_text(make):
    df = make("d string", ("2024-02-29",), ("2024-03-01 10:11:12",))
    assert [r.d for r in files.parse_dates(df, "d").collect()] == [date(2024, 2, 29), date(2024, 3, 1)]


def test_table_by_month_is_pruned(spark, make, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(make("date date, n long", (date(2024, 1, 5), 1), (date(2024, 2, 5), 2)), path, by_month="date")
    read = files.read_table(spark, path).filter("sales_month = '2024-02'")
    assert [r.n for r in read.collect()] == [2]
    assert "PartitionFilters: [isnotnull(sales_month" in read._jdf.queryExecution().executedPlan().toString()


def test_classifier_scores(make):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 4
    got = models.classifier_metrics(make("label int, prediction int", *rows)).first()
    assert (got.loss_found, got.loss_missed, got.false_alarm, got.profit_found) == (3, 1, 2, 4)
    assert (got.accuracy_pct, got.loss_precision_pct, got.loss_recall_pct) == (70.0, 60.0, 75.0)


def test_regressor_scores(make):
    got = models.regressor_metrics(make("actual double, predicted double", (1.0, 2.0), (2.0, 2.0), (3.0, 1.0))).first()
    assert (got.mae, got.rmse, got.r2, got.mape) == (1.0, 1.29, -1.5, 55.56)


def test_alerts_and_actions(make):
    scored = make("entity string, year_month date, operating_profit double, predicted double, loss double, fill_rate double, "
                  "stockout_cost double, operating_margin_pct double",
                  ("a", date(2024, 1, 1), 5.0, 4.0, 0.71, 89.0, 60000.0, 9.0), ("b", date(2024, 1, 1), 5.0, 4.0, 0.7, 95.0, 1.0, 20.0),
                  ("c", date(2024, 1, 1), 5.0, 4.0, 0.4, 80.0, 1.0, 1.0))
    alerts = models.alerts_from(scored)
    assert {r.entity: r.risk_level for r in alerts.collect()} == {"a": "HIGH RISK", "b": "MEDIUM RISK", "c": "LOW RISK"}
    acts = {r.entity: r.actions for r in models.alert_actions(alerts).collect()}
    assert acts == {"a": ["Fill rate is low (89.0%) - improve inventory", "High stockout costs ($60,000) - fix supplier issues",
                          "Low margin (9.0%) - reduce costs"], "b": []}
    assert models.high_risk_count(alerts).first().asDict() == {"high_risk": 1, "medium_risk": 1, "low_risk": 1}


def test_histogram_holds_every_value(make):
    df = make("x double", *((float(i),) for i in range(101)))
    bins = forecast.histogram(df, "x", 10).collect()
    assert [b.n for b in bins] == [10] * 9 + [11] and bins[0].bin_start == 0.0 and bins[-1].bin_end == 100.0
    assert [b.n for b in forecast.histogram(make("x double", (5.0,), (5.0,)), "x").collect()] == [2] + [0] * 29


def test_point_in_time_median_looks_back_only(make):
    rows = make("entity string, year_month date, fill_rate double, stockout_cost double, revenue_mom_change double",
                *(("e", date(2024, m, 1), 95.0, c, None) for m, c in ((1, 1.0), (2, 5.0), (3, 100.0), (4, 200.0))))
    for flag, want in ((False, [0, 0, 1, 1]), (True, [0, 1, 1, 1])):
        got = profit.add_risk_flags(rows, point_in_time=flag).orderBy("year_month").collect()
        assert [r.high_stockout_flag for r in got] == want


def test_scores_of_a_constant_are_zero(make):
    got = profit.standard_scores(make("a double, b double", (1.0, 2.0), (1.0, 4.0)), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, -1.0), (0.0, 1.0)]


@pytest.fixture(params=["path", "table"])
def place(request, spark, tmp_path):
    name = str(tmp_path / "sold") if request.param == "path" else f"sold_{tmp_path.name.replace('-', '_')}"
    yield name
    if request.param == "table":
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def sold(make, *rows):
    return make("date date, n long", *((date(2024, m, 1), n) for m, n in rows))


def held(spark, place):
    return sorted((r.date.month, r.n, str(r.sales_month)) for r in files.read_table(spark, place).collect())


def test_failing_write_leaves_the_old_table(spark, make, place):
    files.write_table(sold(make, (1, 10), (2, 20)), place, by_month="date")
    before = held(spark, place)
    bad = sold(make, (1, 1), (3, 3)).withColumn("n", F.when(F.col("n") == 3, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        files.write_table(bad, place, by_month="date")
    assert held(spark, place) == before == [(1, 10, "2024-01"), (2, 20, "2024-02")]


def test_table_is_replaced_from_itself_and_month_by_month(spark, make, place):
    files.write_table(sold(make, (1, 10), (2, 20)), place, by_month="date", only_months=True)  # the first write makes it
    files.write_table(sold(make, (2, 21), (2, 22), (3, 30)), place, by_month="date", only_months=True)
    assert held(spark, place) == [(1, 10, "2024-01"), (2, 21, "2024-02"), (2, 22, "2024-02"), (3, 30, "2024-03")]
    files.write_table(files.read_table(spark, place).select("date", (F.col("n") * 2).alias("n")).filter("n > 40"), place, by_month="date")
    assert held(spark, place) == [(2, 42, "2024-02"), (2, 44, "2024-02"), (3, 60, "2024-03")]
    with pytest.raises(ValueError):
        files.write_table(sold(make, (1, 1)), place, only_months=True)
