"""Hot keys, brute force, plans that hold at scale, and results that do not depend on partitions."""

import random
import re
from collections import Counter
from datetime import date, timedelta
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from larder.functions.kernels import (
    best_pairs, common_days, extend_ar, fit_waves, match_group, smooth, smooth_all, smoothing_pass, sparse_weights, waves_all,
)
from larder.operators import demand, forecast, models, profit, service
from larder.plans.audit import audit_summary, query_audit
from larder.sources.star import StarViews

START = date(2024, 1, 1)


def hot_sales(make, rows=3000, skus=40):
    """A third of all rows on one SKU, and many days."""
    rng = random.Random(7)
    data = []
    for i in range(rows):
        sku = 0 if i % 3 == 0 else rng.randrange(1, skus)
        q = rng.randrange(1, 9)
        short = rng.randrange(0, q) if rng.random() < 0.3 else 0
        data.append((START + timedelta(rng.randrange(90)), f"s{sku:02d}", q, q - short, short))
    return data, make("date date, sku_id string, quantity_ordered long, quantity_fulfilled long, backorder_quantity long", *data)


@pytest.mark.parametrize("top, block", [(20, 7), (None, 16), (50, 1000)])
def test_pairs_equal_brute_force(make, top, block):
    data, sales = hot_sales(make)
    days = {}
    for day, sku, _, sold, _ in data:
        days.setdefault(day, Counter())[sku] += sold
    want = Counter(p for d in days.values() for p in combinations(sorted(d), 2))
    want = sorted(((-n, *p) for p, n in want.items() if n > 12))[:top]
    names = make("sku_id string, product_name string", *((f"s{i:02d}", f"n{i}") for i in range(40)))
    got = demand.sku_cooccurrence({"sales": sales, "sku_master": names}, min_days=12, top=top, block_rows=block).collect()
    assert [(-r.days_sold_together, r.sku_a, r.sku_b) for r in got] == want
    for pair in got[:40]:
        both = [d for d in days.values() if pair.sku_a in d and pair.sku_b in d]
        assert pair.avg_qty_a == pytest.approx(sum(d[pair.sku_a] for d in both) / len(both), abs=0.051)
        assert pair.avg_qty_b == pytest.approx(sum(d[pair.sku_b] for d in both) / len(both), abs=0.051)


def test_shared_days_both_ways():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.9):
        rows = [np.flatnonzero(rng.random(400) < share) for _ in range(30)]
        want = [[len(np.intersect1d(a, b)) if i < j else 0 for j, b in enumerate(rows)] for i, a in enumerate(rows)]
        assert common_days(rows).tolist() == want


def test_match_keeps_exactly_the_best():
    rows = pd.DataFrame({"sku_id": range(30), "days": [np.arange(20)] * 30,
                         "quantities": [np.full(20, k) for k in range(30)]})
    got = match_group(3, 5)((0, 0, 0), rows)
    assert list(zip(got.sku_a, got.sku_b)) == [(0, j) for j in range(1, 6)]
    assert got.qty_a.tolist() == [0] * 5 and got.qty_b.tolist() == [20 * j for j in range(1, 6)]


def test_skus_meet_by_blocks_not_by_days(make):
    listed = make("sku_id long, days array<int>, quantities array<long>", *((k, list(range(40)), [1] * 40) for k in range(60)))
    groups = {}
    for r in demand.dealt(listed, 4).select("sku_id", "block", "left", "right").collect():
        groups.setdefault((r.left, r.right), {})[r.sku_id] = r.block
    assert sum(map(len, groups.values())) == 60 * 4  # once a block, however many days
    met = Counter(p for (a, b), own in groups.items() for p in combinations(sorted(own), 2) if a == b or own[p[0]] != own[p[1]])
    assert len(met) == 60 * 59 / 2 and set(met.values()) == {1}


def test_blocks_meet_without_copies_of_their_rows(make, spark):
    rng = random.Random(2)
    rows = [(k, sorted(rng.sample(range(60), 20))) for k in range(50)]
    listed = make("sku_id long, days array<int>, quantities array<long>", *((k, days, [k] * 20) for k, days in rows))
    met = demand.whole_blocks(listed, 6)
    own = {r.left: [x.sku_id for x in r.left_skus] for r in met.filter("left = right").collect()}
    assert sorted(k for skus in own.values() for k in skus) == list(range(50))
    pairs = [(r.left, r.right) for r in met.select("left", "right").collect()]
    assert sorted(pairs) == sorted((a, b) for a in own for b in own if a <= b)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("sku_a", "sku_b", "days_sold_together", "qty_a", "qty_b")])
    before = spark.conf.get(demand.BATCH_BYTES)
    for top in (9, None):
        got = sorted((-r.days_sold_together, r.sku_a, r.sku_b, r.qty_a, r.qty_b) for r in demand.matched_blocks(met, kind, 5, top).collect())
        shared = ((a, b, len(set(x) & set(y))) for (a, x), (b, y) in combinations(rows, 2))
        assert got == sorted((-n, a, b, a * n, b * n) for a, b, n in shared if n > 5)[:top]
    assert spark.conf.get(demand.BATCH_BYTES) == before


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_best_pairs_drop_nothing_that_is_among_the_best(monkeypatch, share):
    monkeypatch.setattr("larder.functions.kernels.HELD", 10)
    rng = np.random.default_rng(3)
    days = [np.flatnonzero(rng.random(300) < share) for _ in range(80)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in days])])
    every = np.arange(80)
    for left, right in ((every, every), (every[::2], every[1::2])):
        both = {(min(i, j), max(i, j)) for i in left.tolist() for j in right.tolist() if i != j}
        counts = [(-len(np.intersect1d(days[i], days[j])), i, j) for i, j in both]
        want = sorted(c for c in counts if c[0] < 0)
        for top in (7, None):
            i, j, n = best_pairs(starts, np.concatenate(days), 300, left, left if left is right else right, 0, top)
            assert sorted(zip((-n).tolist(), i.tolist(), j.tolist())) == want[:top]


def test_hot_sku_root_cause_equals_brute_force(make):
    data, sales = hot_sales(make)
    rng = random.Random(3)
    orders = [(f"s{0 if i % 3 == 0 else rng.randrange(40):02d}", START + timedelta(rng.randrange(-20, 120)), rng.random() < 0.5)
              for i in range(900)]
    t = {"sales": sales.select("date", "sku_id", "backorder_quantity"),
         "purchase_orders": make("sku_id string, actual_delivery_date date, on_time boolean", *orders),
         "sku_master": make("sku_id string, product_name string", *((f"s{i:02d}", "n") for i in range(40)))}
    want = {}
    for day, sku, _, _, missing in data:
        if missing:
            hits = [ok for s, d, ok in orders if s == sku and d >= day - timedelta(30)]
            seen = want.setdefault(sku, [set(), 0, 0])
            seen[0].add(day)
            seen[1] += missing * max(1, len(hits))
            seen[2] += hits.count(False)
    got = {r.sku_id: (r.num_stockout_days, r.total_backorder_units, r.supplier_delays_count)
           for r in service.stockout_root_cause(t).collect()}
    assert got == {s: (len(d), u, n) for s, (d, u, n) in want.items()}


@pytest.mark.parametrize("name", ["abc_classification", "stockout_root_cause", "sku_cooccurrence", "drop_incomplete",
                                  "policy_detail", "bom_explosion"])
def test_results_do_not_depend_on_partitions(spark, name):
    seen = set()
    for n in (1, 5, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(str, entry.queries()[name](spark, SMALL).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(seen) == 1


MODEL_QUERIES = {"profit_classifier", "classifier_metrics", "class_report", "feature_importance", "profit_regressor",
                 "regressor_metrics", "risk_alerts", "alert_actions", "high_risk_count"}
WRITING = {"query_audit", "read_csv", "read_json_records", "read_json_arrays", "write_table", "read_table", "write_csv",
           "write_json_records", "sales_summary"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_joins_all_pairs(spark):
    for name, run in entry.queries().items():
        if name in MODEL_QUERIES | WRITING:
            continue
        plan = plan_of(run(spark, SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_are_narrow_and_filtered(spark):
    plan = plan_of(entry.queries()["eoq_sql"](spark, SMALL))
    lines = [p for p in plan.splitlines() if "FileScan" in p and "lineitem" in p]
    assert len(lines) == 1 and "GreaterThanOrEqual(l_shipdate" in lines[0]
    assert "l_extendedprice" not in lines[0] and "l_orderkey" not in lines[0]
    assert "supplier.parquet" not in plan  # no join that only feeds unread columns


def test_views_join_only_for_requested_columns(spark):
    views = StarViews(spark, SMALL)
    assert "Join" not in plan_of(views.table("sales", ("date", "sku_id", "quantity_fulfilled")))
    assert "Join" not in plan_of(views.table("purchase_orders", ("supplier_id", "on_time")))
    wide = views.table("sales", ("date", "region", "category"))
    assert wide.count() == views.raw("lineitem", "l_partkey").count()


def plain_holt_winters(y, a, b, g, m=7):
    level, trend = sum(y[:m]) / m, (sum(y[m:2 * m]) - sum(y[:m])) / m / m
    season, error = [v - level for v in y[:m]], 0.0
    for i in range(m, len(y)):
        s, old = season[i % m], level
        error += (y[i] - level - trend - s) ** 2
        level = a * (y[i] - s) + (1 - a) * (old + trend)
        season[i % m] = g * (y[i] - old - trend) + (1 - g) * s
        trend = b * (level - old) + (1 - b) * trend
    return error, level, trend, season


def test_smoothing_equals_plain_loop():
    rng = np.random.default_rng(2)
    y = 50 + np.arange(80) * 0.5 + 10 * np.sin(np.arange(80) * 2 * np.pi / 7) + rng.normal(0, 2, 80)
    weights = np.array([[0.2, 0.1, 0.3], [0.9, 0.5, 0.01]])
    error, (level, trend, season) = smoothing_pass(y, weights, 7)
    for k, w in enumerate(weights):
        want = plain_holt_winters(list(y), *w)
        assert np.allclose([error[k], level[k], trend[k], *season[:, k]], [*want[:3], *want[3]])


def test_forecasters_follow_a_clean_season():
    t = np.arange(400)
    y = 200 + 0.3 * t + 40 * np.sin(2 * np.pi * t / 7)
    for made in (smooth(y[:370], 30), extend_ar(y[:370], 30)):
        assert np.abs(made["forecast"] / y[370:] - 1).max() < 0.02
    frame = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=400).date, "demand": y})
    made = fit_waves(frame[:370], frame[370:], 3, 3, 1.28)
    assert np.abs(made["forecast"] / y[370:] - 1).max() < 0.1
    assert (made["forecast_lower"] < made["forecast"]).all() and (made["forecast"] < made["forecast_upper"]).all()
    assert smooth(y[:10], 5) == {} and extend_ar(y[:10], 5) == {}


def test_short_series_keep_their_rows(make):
    rows = [(START + timedelta(i), s, "c", 5 + i % 7, 100) for s, n in (("long", 120), ("short", 12)) for i in range(n)]
    sales = make("date date, sku_id string, category string, quantity_fulfilled long, revenue_cents long", *rows)
    long = forecast.forecast({"sales": sales}, by="sku_id", holdout_days=5)
    got = long.collect()
    assert len(got) == 2 * 5 * len(forecast.FORECASTERS)
    assert all(r.status == forecast.FITTED and r.forecast is not None for r in got if r.series == "long")
    short = {r.model for r in got if r.series == "short" and r.status == forecast.TOO_SHORT and r.forecast is None}
    assert short == set(forecast.FITS)
    assert {r.points for r in forecast.forecast_ranking({"sales": sales}, by="sku_id", holdout_days=5).collect()} == {5}


def test_targets_are_three_calendar_months_ahead(spark):
    reads = {table: tuple(names.split()) for table, names in profit.READS.items()}
    tables = StarViews(spark, SMALL).tables(reads)
    by_month = {(r.entity, r.year_month): r.operating_profit for r in profit.monthly(tables, "sku_id").collect()}
    rows = profit.labelled(tables, "sku_id").collect()
    assert rows
    for r in rows:
        m = r.year_month.month - 1 + 3
        ahead = r.year_month.replace(year=r.year_month.year + m // 12, month=m % 12 + 1)
        assert by_month[r.entity, ahead] == r.target_profit


def test_split_draws_each_class_alike(make):
    rows = [(str(i), START, int(i % 10 > 0)) for i in range(400)]
    drawn = profit.mark_train(make("entity string, year_month date, target_is_profitable int", *rows)).collect()
    for label, size in ((0, 40), (1, 360)):
        assert sum(r.is_train for r in drawn if r.target_is_profitable == label) == size * 3 // 4


def test_views_keep_their_rows_for_any_columns(spark):
    views = StarViews(spark, SMALL)
    every = views.raw("supplier", "s_suppkey").count()
    assert {views.table("supplier_master", c).count() for c in (("supplier_id",), ("supplier_id", "quality_rating"), ("country", "on_time_delivery_rate"))} == {every}
    assert views.table("warehouse_master", ("warehouse_id",)).count() == views.raw("nation", "n_nationkey").count()


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from larder.functions import pin

    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
            master, applicationId = "spark://somewhere", "a"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        pin.shared_folder(Bare)
    pin.local_fallback(Bare)  # names nothing on a cluster
    with pytest.raises(ValueError):
        pin.scratch_path(Bare, "x")


def test_running_total_gives_nulls_the_grand_total(make):
    from larder.functions.running import running_total_desc

    got = running_total_desc(make("v long", (5,), (None,), (3,), (5,)), "v", "run", "all").collect()
    assert sorted((r.v or 0, r.run, r.all) for r in got) == [(0, 13, 13), (3, 13, 13), (5, 10, 13), (5, 10, 13)]


def test_series_fill_adds_empty_days(make):
    sales = make("date date, sku_id string, category string, quantity_fulfilled long, revenue_cents long",
                 (START, "a", "c", 4, 400), (START + timedelta(3), "a", "c", 2, 200))
    got = [(r.date.day, r.demand, r.revenue) for r in forecast.daily_demand({"sales": sales}, fill=True).collect()]
    assert got == [(1, 4, 4.0), (2, 0, 0.0), (3, 0, 0.0), (4, 2, 2.0)]


def test_models_learn_and_one_class_is_skipped(spark):
    reads = {table: tuple(names.split()) for table, names in profit.READS.items()}
    tables = StarViews(spark, SMALL).tables(reads)
    fitted = models.fit(tables, by="sku_id", trees=10, rounds=5)
    scores = models.classifier_metrics(models.classified(fitted)).first()
    assert scores.rows == scores.loss_found + scores.loss_missed + scores.false_alarm + scores.profit_found > 0
    alerts = models.risk_alerts(fitted)
    assert alerts.groupBy("entity").count().agg({"count": "max"}).first()[0] == 3
    assert {r.risk_level for r in alerts.collect()} <= {"HIGH RISK", "MEDIUM RISK", "LOW RISK"}
    one = models.fit(tables, rounds=3, trees=5, split="time")
    assert one.classifier is None and models.classified(one).count() == 0
    cut = max(r.year_month for r in one.marked.filter("is_train").collect())
    assert all(r.year_month > cut for r in one.marked.filter("NOT is_train").collect())
    assert models.risk_alerts(one).count() == 3


def test_classifier_works_after_an_observed_query(spark):
    query_audit(spark, {"any": lambda: spark.range(3)})
    reads = {table: tuple(names.split()) for table, names in profit.READS.items()}
    fitted = models.fit(StarViews(spark, SMALL).tables(reads), by="sku_id", trees=3, regress=False)
    assert models.classified(fitted).count() > 0


def test_audit_goes_on_after_a_failure(spark, tmp_path):
    good = spark.range(5)
    log = query_audit(spark, {"good": lambda: good, "bad": lambda: good.select("absent"), "more": lambda: good.limit(2)},
                      str(tmp_path))
    rows = {r.query_name: r for r in log.collect()}
    assert (rows["good"].rows_returned, rows["good"].status, rows["more"].rows_returned) == (5, "SUCCESS", 2)
    assert rows["bad"].status.startswith("FAILED")
    assert spark.read.option("header", True).csv(str(tmp_path / "good")).count() == 5
    assert audit_summary(log).first().succeeded == 2


def test_nothing_touches_spark_on_import():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(entry.__file__).parent)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert re.fullmatch(r"\d+ \d+\n", out.stdout), out.stderr


def test_kernels_travel_by_value(tmp_path):
    """A worker without this package can run them."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(smooth))
    code = ("import pickle, numpy as np; f = pickle.load(open('f', 'rb'));"
            "print(len(f(np.arange(50.0), 3)['forecast']))")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout == "3\n", out.stderr


def test_a_hot_part_is_split_over_tasks(spark, tmp_path):
    """A third of the line items on one part: the join with parts is split, and the sums stay right."""
    raw = StarViews(spark, SMALL)
    line = spark.read.parquet(f"{SMALL}/lineitem.parquet").repartition(16)
    hot = F.when(F.xxhash64("l_orderkey", "l_linenumber", "l_shipdate") % 3 == 0, F.lit(1).cast("long"))
    line.withColumn("l_partkey", F.coalesce(hot, "l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    raw.raw("part", "*").write.parquet(f"{tmp_path}/part.parquet")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.files.maxPartitionBytes": "64KB", "spark.sql.files.openCostInBytes": "0",
    }
    run = entry.queries()["monthly_profitability"]
    plain = sorted(map(str, run(spark, str(tmp_path)).collect()))
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = run(spark, str(tmp_path))
        split = sorted(map(str, df.collect()))
        assert "skew=true" in plan_of(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert split == plain


def test_running_total_of_a_hot_value_over_many_ranges(make):
    """Half of the rows tie, so their value lies in several ranges; NULLs and zeros lie behind."""
    from larder.functions.running import running_total_desc

    rng = random.Random(5)
    values = [50] * 400 + [rng.randrange(100) for _ in range(300)] + [None] * 60 + [0] * 60
    df = make("v long, k long", *((v, i) for i, v in enumerate(values)))
    got = running_total_desc(df.repartition(7), "v", "run", "all")
    whole = sum(v or 0 for v in values)
    want = {v: sum(x for x in values if x is not None and x >= v) for v in set(values) - {None}}
    rows = got.collect()
    assert got.columns == ["v", "k", "run", "all"] and sorted(r.k for r in rows) == list(range(len(values)))
    assert all((r.run, r.all) == (want.get(r.v, whole), whole) for r in rows)
    spread = got.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    got.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = running_total_desc(df, "v", "run", "all").collect()
    finally:
        got.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    assert all((r.run, r.all) == (want.get(r.v, whole), whole) for r in rows)
    assert running_total_desc(df.limit(0), "v", "run", "all").collect() == []


def test_running_total_refuses_negative_values(make):
    from larder.functions.running import running_total_desc

    with pytest.raises(Exception, match="is negative"):
        running_total_desc(make("v long", (1,), (-1,)), "v", "run", "all").collect()


def test_moving_average_terms_follow_shocks():
    """Daily changes that are shocks, and part of the shock before: three lags alone miss what the residuals tell."""
    rng = np.random.default_rng(4)
    shocks = rng.normal(size=900)
    w = shocks + 0.8 * np.r_[0, shocks[:-1]]
    y = np.zeros(len(w) + 8)
    for i, change in enumerate(w):
        y[i + 8] = change + y[i + 7] + y[i + 1] - y[i]

    def plain(y):
        w = np.diff(y)
        w = w[7:] - w[:-7]
        past = np.stack([w[8 - k:len(w) - k] for k in (1, 7, 8)], axis=1)
        weights = np.linalg.lstsq(past, w[8:], rcond=None)[0]
        return y[-1] + y[-7] - y[-8] + sum(c * w[-k] for c, k in zip(weights, (1, 7, 8)))

    cuts = range(700, 900)
    errors = np.array([[extend_ar(y[:n], 1)["forecast"][0] - y[n], plain(y[:n]) - y[n]] for n in cuts])
    mine, theirs = (errors**2).mean(axis=0)
    assert mine < 0.9 * theirs


def test_audit_runs_side_by_side_and_stops_what_hangs(spark, tmp_path):
    import threading

    both = threading.Barrier(2, timeout=30)  # passes only if two queries are built at the same time

    def met():
        both.wait()
        return spark.range(4)

    def sleeping(parts):
        import time

        for part in parts:
            time.sleep(600)
            yield part

    def hanging():
        return spark.range(0, 2, 1, 2).mapInPandas(sleeping, "id long")

    log = query_audit(spark, {"one": met, "stuck": hanging, "two": met, "last": lambda: spark.range(7)}, str(tmp_path), at_once=3, limit_sec=15)
    rows = log.collect()
    assert [r.query_name for r in rows] == ["one", "stuck", "two", "last"]
    assert [(r.rows_returned, r.status) for r in rows if r.query_name != "stuck"] == [(4, "SUCCESS"), (4, "SUCCESS"), (7, "SUCCESS")]
    assert rows[1].status == "FAILED: stopped after 15 seconds" and rows[1].rows_returned == 0
    assert spark.range(3).count() == 3  # the session's own jobs are in no cancelled group
    with pytest.raises(ValueError):
        query_audit(spark, {}, at_once=0)
    assert query_audit(spark, {}).count() == 0


def broken_trend(days, bend=None, seed=3):
    t = np.arange(days)
    slope = 0.004 * t if bend is None else 0.004 * np.minimum(t, bend) - 0.002 * np.maximum(t - bend, 0)
    wave = 0.2 * np.sin(2 * np.pi * t / 7)
    demand = np.expm1(4 + slope + wave + np.random.default_rng(seed).normal(0, 0.05, days))
    return pd.DataFrame({"date": pd.date_range("2022-01-01", periods=days).date, "demand": demand})


def test_a_broken_trend_is_followed():
    frame = broken_trend(500, 250)
    train, test = frame[:440], frame[440:]
    real = test["demand"].to_numpy()
    error = {n: np.abs(fit_waves(train, test, 3, 0, 1.28, n)["forecast"] / real - 1).mean() for n in (0, 25)}
    assert error[25] < 0.15 and error[25] < error[0] / 3
    made = fit_waves(train, test, 3, 0, 1.28, 25)
    assert np.all(made["forecast_lower"] < made["forecast"]) and np.all(made["forecast"] < made["forecast_upper"])


def test_the_band_holds_its_share_and_a_straight_trend_keeps_its_line():
    inside = []
    for seed in range(20):
        frame = broken_trend(400, None, seed)
        made = fit_waves(frame[:370], frame[370:], 3, 0, NormalDist().inv_cdf(0.9), 25)
        real = frame["demand"].to_numpy()[370:]
        inside.append(np.mean((made["forecast_lower"] <= real) & (real <= made["forecast_upper"])))
    assert 0.7 <= np.mean(inside) <= 0.9  # of 0.8
    line = [fit_waves(f[:370], f[370:], 3, 0, 1.28, n)["forecast"] for f in (broken_trend(400),) for n in (0, 25)]
    assert np.abs(line[1] / line[0] - 1).max() < 0.05


def test_sparse_weights_meet_their_conditions():
    rng = np.random.default_rng(5)
    h, sigma = rng.normal(size=(200, 12)), 0.5
    y = h @ np.array([3.0, 0, 0, -2.0] + [0] * 8) + rng.normal(0, sigma, 200)
    gram, target = h.T @ h, h.T @ y
    weights = sparse_weights(gram, target, sigma)
    penalty = sigma * np.sqrt(2 * np.log(12)) * np.sqrt(np.diag(gram))
    left = target - gram @ weights
    kept = weights != 0
    assert kept[[0, 3]].all() and kept.sum() < 6
    assert np.allclose(left[kept], np.sign(weights[kept]) * penalty[kept], atol=1e-3) and np.all(np.abs(left[~kept]) <= penalty[~kept] + 1e-6)
    assert not sparse_weights(np.zeros((3, 3)), np.zeros(3), 1.0).any()


def test_series_fitted_side_by_side_equal_those_fitted_alone():
    rng = np.random.default_rng(5)
    ys = [rng.poisson(3, n).astype(float) for n in (5, 200, 120, 14, 121)]
    for y, made in zip(ys, smooth_all(ys, [9] * 5)):
        alone = smooth(y, 9)
        assert made.keys() == alone.keys() and all(np.allclose(made[c], alone[c], rtol=1e-12) for c in made)
    given = [(np.arange(len(y)), y, len(y) + np.arange(9)) for y in ys]
    for one, made in zip(given, waves_all(given, 3, 3, 1.28)):
        alone = waves_all([one], 3, 3, 1.28)[0]
        assert made.keys() == alone.keys() and all(np.allclose(made[c], alone[c], rtol=1e-9) for c in made)


def sparse_sales(make):
    days = {"a": (0, 3, 200, 210), "b": (5, 12), "c": (0, 100, 130, 131, 139, 190)}
    rows = [(START + timedelta(d), s, "x", d + 1, 100 * d) for s, own in days.items() for d in own]
    return days, {"sales": make("date date, sku_id string, category string, quantity_fulfilled long, revenue_cents long", *rows)}


def test_plain_forecasts_fill_only_the_days_they_read(make):
    days, t = sparse_sales(make)
    filled = forecast.demand_series(t["sales"], "sku_id", True, newest=20)
    assert {(r.series, r.date) for r in filled.collect()} == {
        (s, START + timedelta(d)) for s, own in days.items() for d in range(max(own[0], own[-1] - 19), own[-1] + 1)}
    whole = forecast.split(forecast.demand_series(t["sales"], "sku_id", True), 60)
    want = {tuple(r) for r in forecast.plain(whole, forecast.PLAIN).collect()}
    got = {tuple(r) for r in forecast.forecast(t, models=forecast.BASELINES, by="sku_id", holdout_days=60, fill=True).collect()}
    assert got == want and len(got) == 3 * (60 + 8 + 60)


def test_fits_fill_empty_days_and_agree_with_plain_forecasts(make):
    _, t = sparse_sales(make)
    for fill in (True, False):
        models = [*forecast.BASELINES, forecast.SMOOTHING]
        got = forecast.forecast(t, models=models, by="sku_id", holdout_days=60, fill=fill).collect()
        plain = forecast.forecast(t, models=forecast.BASELINES, by="sku_id", holdout_days=60, fill=fill).collect()
        assert sorted(map(str, (r for r in got if r.model != forecast.SMOOTHING))) == sorted(map(str, plain))
        assert {r.status for r in got if r.series == "b"} == {"series too short"}


def test_days_are_sorted_before_empty_ones_are_added(make):
    days, t = sparse_sales(make)
    filled = forecast.daily_demand(t, by="sku_id", fill=True)
    assert [(r.series, r.date) for r in filled.collect()] == [
        (s, START + timedelta(d)) for s, own in days.items() for d in range(own[0], own[-1] + 1)]
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Sort [")  # the tree is printed from the result down


def test_smoothing_ends_runs_early_and_finds_the_same_weights():
    from larder.functions.kernels import smoothing_runs

    def plain(y, weights):
        a, b, g = weights
        level, season = y[:7].mean(), list(y[:7] - y[:7].mean())
        trend, error = (y[7:14].mean() - level) / 7, 0.0
        for i in range(7, len(y)):
            short = y[i] - level - trend - season[i % 7]
            level, trend = level + trend + a * short, trend + a * b * short
            season[i % 7] += g * short
            error += short ** 2
        return error, level, trend, season

    rng = np.random.default_rng(5)
    ys = [np.where(rng.random(n) < 0.05, rng.integers(1, 9, n), 0).astype(float) for n in (190, 160)] + [1e6 + 50 * np.sin(np.arange(150) / 3) + rng.normal(0, 5, 150)]
    axis = [0.01, 0.05, 0.1, 0.2, 0.4, 0.7]
    for y, made in zip(ys, smooth_all(ys, [9] * 3)):
        points, width = [(a, b, g) for b in axis for a in axis for g in axis], 0.1 / 3
        for turn in range(4):
            found = [plain(y, p) for p in points]
            at = int(np.argmin([x[0] for x in found]))
            around = [np.clip(x + width * np.linspace(-1, 1, 5), 0.001, 0.999) for x in points[at]]
            best, points, width = found[at], [(a, b, g) for b in around[1] for a in around[0] for g in around[2]], width / 3
        _, level, trend, season = best
        assert np.allclose(made["forecast"], [level + k * trend + season[(len(y) + k - 1) % 7] for k in range(1, 10)], rtol=1e-7)
    weights = np.array([[0.1, 0.1, 0.1], [0.7, 0.7, 0.7]])
    bound = plain(ys[0], weights[0])[0]
    errors, (level, _, _) = smoothing_runs(ys[:1], np.zeros(2, int), weights, 7, np.array([bound * 1.001]))
    assert np.isclose(errors[0], bound) and np.isinf(errors[1]) and np.isnan(level[1])


def test_series_of_one_length_share_their_waves():
    rng = np.random.default_rng(6)
    given = [(np.arange(n), rng.integers(0, 9, n).astype(float), np.arange(n, n + 5)) for n in (300, 200, 300)]
    given.append((np.delete(np.arange(300), 17), rng.integers(0, 9, 299).astype(float), np.arange(300, 305)))
    known = {}
    made = waves_all(given, 3, 2, 1.28, known=known)
    assert sorted(known) == [200, 300]  # a series that lacks a day shares nothing
    for one, own in zip(given, made):
        alone = waves_all([one], 3, 2, 1.28)[0]
        assert all(np.allclose(own[c], alone[c], rtol=1e-6) for c in alone)
