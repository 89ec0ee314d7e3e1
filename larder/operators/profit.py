"""Monthly profit per company, category or SKU, and the features a risk model reads.

One row per entity and month. Windows run by entity over its months (tens to hundreds of rows).
Feature steps are plain DataFrame transforms, so they chain with ``df.transform``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.functions.columns import money, month_start, ratio, rounded
from larder.functions.report import dollars, key_values, with_percent
from larder.plans.operator import Tables, operator

READS = dict(
    sales="date sku_id category quantity_ordered quantity_fulfilled backorder_quantity unit_price_cents revenue_cents",
    sku_master="sku_id unit_cost_cents carrying_cost_rate",
)
LAGGED = {"revenue": "revenue", "gross_margin_pct": "gross_margin", "fill_rate": "fill_rate",
          "stockout_cost": "stockout_cost"}
ROLLED = {"revenue": "revenue", "operating_profit": "profit", "operating_margin_pct": "margin"}
CHANGED = {"revenue": "revenue", "operating_profit": "profit", "fill_rate": "fill_rate"}
RATIOS = {"cogs": "cogs", "stockout_cost": "stockout", "carrying_cost": "carrying"}
# Not features: identifiers, targets, and the figures the target is made of.
NOT_FEATURES = {"entity", "year_month", "target_profit", "target_is_profitable", "operating_profit",
                "is_profitable", "gross_profit"}


def half_even(value: Column, digits: int) -> Column:
    return F.bround(F.round(value, 9), digits)


def months_of(entity: str = "entity") -> WindowSpec:
    return Window.partitionBy(entity).orderBy("year_month")


def month_away(column: str, months: int) -> Column:
    """The entity's value so many calendar months later (negative: earlier); NULL if it has no row there."""
    number = F.year("year_month") * 12 + F.month("year_month")
    return F.first(column).over(Window.partitionBy("entity").orderBy(number).rangeBetween(months, months))


def monthly(t: Tables, by: str | None = None) -> DataFrame:
    """Month sums and profit per entity."""
    return _named(_monthly(t, by))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entity", F.col("entity").cast("string"))


def _monthly(t: Tables, by: str | None = None) -> DataFrame:
    """``monthly`` with the entity as it stands in sales, not yet as text.

    SKUs shrink to a row per month before they meet their cost, so a hot SKU is summed map-side; their key stays
    a bare column, so that a shuffle by SKU serves the join, both sums and the windows. A SKU and month is hardly ever
    more than a sale, so for wider entities each sale meets its cost and is summed map-side to the entity's months.
    """
    entity = F.lit("ALL") if by is None else F.col(by)
    price, lost = F.col("unit_price_cents"), F.col("backorder_quantity")
    whole = ("revenue_cents", "quantity_fulfilled", "quantity_ordered", "backorder_quantity", "stockout_cents", "prices", "priced", "rows")
    sums = t["sales"].select(
        "sku_id", entity.alias("entity"), month_start("date").alias("year_month"), *whole[:4], (lost * price).alias("stockout_cents"),
        price.alias("prices"), price.isNotNull().cast("long").alias("priced"), F.lit(1).cast("long").alias("rows"))
    if by == "sku_id":
        sums = sums.groupBy("sku_id", "entity", "year_month").agg(*(F.sum(c).alias(c) for c in whole))
    cost = F.col("unit_cost_cents")
    goods = F.col("quantity_fulfilled") * cost
    rows = sums.join(t["sku_master"], "sku_id", "left").groupBy("entity", "year_month").agg(
        *(F.sum(c).alias(c) for c in whole[:-1]),
        F.sum(goods).alias("cogs_cents"), F.sum(cost * F.col("rows")).alias("costs"),
        F.sum(F.when(cost.isNotNull(), F.col("rows"))).alias("costed"),
        rounded(F.sum(goods * F.col("carrying_cost_rate") / 12) / 100).alias("carrying_cost"),
    )
    rows = rows.select(
        "entity", "year_month", money("revenue_cents").alias("revenue"), "quantity_fulfilled", "quantity_ordered",
        "backorder_quantity", F.round(ratio("costs", "costed") / 100, 6).alias("unit_cost"),
        F.round(ratio("prices", "priced") / 100, 6).alias("unit_price"), money("cogs_cents").alias("cogs"),
        money(F.col("revenue_cents") - F.col("cogs_cents")).alias("gross_profit"),
        money("stockout_cents").alias("stockout_cost"), "carrying_cost",
    )
    rows = rows.withColumns({
        "gross_margin_pct": half_even(F.try_divide(F.col("gross_profit"), F.col("revenue")) * 100, 2),
        "fill_rate": half_even(ratio("quantity_fulfilled", "quantity_ordered") * 100, 2),
        "operating_profit": F.round(F.col("gross_profit") - F.col("carrying_cost") - F.col("stockout_cost"), 2),
    })
    return rows.withColumns({
        "operating_margin_pct": half_even(F.try_divide(F.col("operating_profit"), F.col("revenue")) * 100, 2),
        "is_profitable": (F.col("operating_profit") > 0).cast("int"),
    })


def lags_of(lags: tuple[int, ...] = (1, 2, 3)) -> dict[str, Column]:
    return {f"{name}_lag_{k}": month_away(c, -k) for k in lags for c, name in LAGGED.items()}


def rolling_of(size: int = 3) -> dict[str, Column]:
    number = F.year("year_month") * 12 + F.month("year_month")
    w = Window.partitionBy("entity").orderBy(number).rangeBetween(1 - size, 0)  # calendar months, of those with a row
    return {f"{name}_rolling_{size}m": F.avg(c).over(w) for c, name in ROLLED.items()}


def before_of() -> dict[str, Column]:
    return {f"_{name}_before": month_away(c, -1) for c, name in CHANGED.items()}


def changes_from_before() -> dict[str, Column]:
    return {f"{name}_mom_change": F.round(F.try_divide(F.col(c) - F.col(f"_{name}_before"), F.col(f"_{name}_before")) * 100, 6)
            for c, name in CHANGED.items()}


def targets_of(horizon: int = 3) -> dict[str, Column]:
    return {name: month_away(c, horizon) for c, name in TARGETS.items()}


def add_lags(rows: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return rows.withColumns(lags_of(lags))


def add_rolling(rows: DataFrame, size: int = 3) -> DataFrame:
    means = rolling_of(size)
    return rows.withColumns(means).withColumns({c: F.round(c, 6) for c in means})


def add_changes(rows: DataFrame) -> DataFrame:
    before = before_of()
    return rows.withColumns(before).withColumns(changes_from_before()).drop(*before)


def add_calendar(rows: DataFrame) -> DataFrame:
    quarter = F.quarter("year_month")
    return rows.withColumns({"month": F.month("year_month"), "quarter": quarter, "is_q4": (quarter == 4).cast("int")})


def add_cost_ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        f"{name}_to_revenue_ratio": half_even(F.try_divide(F.col(c), F.col("revenue")) * 100, 2)
        for c, name in RATIOS.items()
    })


def median_stockout(point_in_time: bool = False) -> Column:
    entity = months_of().rowsBetween(Window.unboundedPreceding, 0) if point_in_time else Window.partitionBy("entity")
    return F.percentile("stockout_cost", F.lit(0.5)).over(entity)


def add_risk_flags(rows: DataFrame, point_in_time: bool = False, median: Column | None = None) -> DataFrame:
    """``point_in_time`` takes the median of the months so far, not of all months. ``median`` is it, if it is known."""
    median = median_stockout(point_in_time) if median is None else median

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return rows.withColumns({
        "low_fill_rate_flag": flag(F.col("fill_rate") < 90),
        "high_stockout_flag": flag(F.col("stockout_cost") > median),
        "declining_revenue_flag": flag(F.col("revenue_mom_change") < -5),
    })


TARGETS = {"operating_profit": "target_profit", "is_profitable": "target_is_profitable"}


def features(t: Tables, by: str | None = None, point_in_time: bool = False, horizon: int | None = None) -> DataFrame:
    """All features, and with ``horizon`` the targets (NULL where that month has no row); months that
    lack any feature are dropped."""
    rows = _monthly(t, by)
    targets = targets_of(horizon) if horizon is not None else {}
    lags, means, before = lags_of(), rolling_of(), before_of()
    # Windows in one step, so that they share one sort; months without all lags go before anything is rounded.
    rows = rows.withColumns({**targets, **lags, **means, **before, "_median": median_stockout(point_in_time)}).na.drop("any", subset=list(lags))
    rows = rows.withColumns({c: F.round(c, 6) for c in means}).withColumns(changes_from_before()).drop(*before)
    for step in (add_calendar, add_cost_ratios):
        rows = rows.transform(step)
    rows = add_risk_flags(rows, median=F.col("_median")).drop("_median")
    return _named(rows.na.drop("any", subset=[c for c in rows.columns if c not in TARGETS.values()]))


def with_target(rows: DataFrame, horizon: int = 3) -> DataFrame:
    """Profit and its sign ``horizon`` calendar months later."""
    return rows.withColumns(targets_of(horizon))


def labelled(t: Tables, by: str | None = None, horizon: int = 3, point_in_time: bool = False) -> DataFrame:
    """Features of the months whose target month has a row."""
    return features(t, by, point_in_time, horizon).na.drop(subset=list(TARGETS.values()))


def mark_train(rows: DataFrame, share: float = 0.75, seed: int = 42, mode: str = "hash") -> DataFrame:
    """Adds ``is_train``.

    ``hash`` draws ``share`` of each class, the rows of the least hashes of their key: the same on every
    run. Ranks need no global sort: a class is counted by the first bits of the hash, which tells the
    bucket where its share ends, and only that bucket's rows are ranked. ``time`` trains on the earlier months
    only, so that nothing from the future leaks in.
    """
    if mode == "hash":
        key = F.concat_ws("|", F.lit(str(seed)), "entity", F.date_format("year_month", "yyyy-MM"))
        label = "target_is_profitable"
        drawn = rows.withColumn("_draw", F.md5(key)).withColumn("_bucket", F.substring("_draw", 1, 3))
        counts = drawn.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))  # 4,096 buckets a class
        in_class = Window.partitionBy(label)
        before = F.sum("_n").over(in_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        wanted = F.round(F.sum("_n").over(in_class) * share).cast("long")
        limits = counts.select(label, "_bucket", (wanted - F.coalesce(before, F.lit(0))).alias("_left"), "_n")
        placed = drawn.join(limits, [label, "_bucket"])
        cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
        # Rows of other buckets get a window group of their own key, so none of them is sorted together.
        group = F.when(cut, F.col("_bucket")).otherwise(F.col("_draw"))
        rank = F.row_number().over(Window.partitionBy(label, group).orderBy("_draw"))
        return placed.withColumn("is_train", F.when(cut, rank <= F.col("_left")).otherwise(F.col("_left") >= F.col("_n"))).drop("_draw", "_bucket", "_left", "_n")
    months = rows.select("year_month").distinct()  # bounded by the calendar
    cut = months.agg(F.element_at(
        F.array_sort(F.collect_list("year_month")), F.ceil(F.count("year_month") * share).cast("int"))).scalar()
    return rows.withColumn("is_train", F.col("year_month") <= cut)


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in NOT_FEATURES and c != "is_train"]


def standard_scores(rows: DataFrame, names: list[str], digits: int | None = None) -> DataFrame:
    """Each column less its mean, over its population deviation; zero where it does not vary."""
    ends = rows.agg(F.struct(
        *(F.avg(c).alias(f"{c}_mean") for c in names), *(F.stddev_pop(c).alias(f"{c}_sd") for c in names)
    )).scalar()

    def score(c: str) -> Column:
        value = F.coalesce(F.try_divide(F.col(c) - F.col("_ends")[f"{c}_mean"], F.col("_ends")[f"{c}_sd"]), F.lit(0.0))
        return value if digits is None else F.round(value, digits)

    # Held in one column: the subquery then stands in the plan once, not once per feature.
    return rows.withColumn("_ends", ends).withColumns({c: score(c) for c in names}).drop("_ends")


# Operators.


@operator(**READS)
def monthly_profitability(t: Tables, *, by: str | None = None) -> DataFrame:
    """Month sums and profit per entity."""
    return monthly(t, by)


@operator(**READS)
def lag_features(t: Tables, *, by: str | None = None) -> DataFrame:
    """Four figures of the three months before."""
    rows = add_lags(monthly(t, by))
    return rows.select("entity", "year_month", *(c for c in rows.columns if "_lag_" in c))


@operator(**READS)
def rolling_features(t: Tables, *, by: str | None = None) -> DataFrame:
    """Means over three months, fewer at the start."""
    rows = add_rolling(monthly(t, by))
    return rows.select("entity", "year_month", *(c for c in rows.columns if "_rolling_" in c))


@operator(**READS)
def mom_change(t: Tables, *, by: str | None = None) -> DataFrame:
    """Change against the month before in percent; NULL from zero."""
    rows = add_changes(monthly(t, by))
    return rows.select("entity", "year_month", *(c for c in rows.columns if c.endswith("_mom_change")))


@operator(**READS)
def calendar_features(t: Tables, *, by: str | None = None) -> DataFrame:
    """Month, quarter and whether it is the last quarter."""
    return add_calendar(monthly(t, by)).select("entity", "year_month", "month", "quarter", "is_q4")


@operator(**READS)
def cost_ratios(t: Tables, *, by: str | None = None) -> DataFrame:
    """Costs in percent of revenue."""
    rows = add_cost_ratios(monthly(t, by))
    return rows.select("entity", "year_month", *(c for c in rows.columns if c.endswith("_ratio")))


@operator(**READS)
def risk_flags(t: Tables, *, by: str | None = None, point_in_time: bool = False) -> DataFrame:
    """Low fill rate, stockout cost above the median, falling revenue."""
    rows = add_risk_flags(add_changes(monthly(t, by)), point_in_time)
    return rows.select("entity", "year_month", *(c for c in rows.columns if c.endswith("_flag")))


@operator(**READS)
def drop_incomplete(t: Tables, *, by: str | None = None, point_in_time: bool = False) -> DataFrame:
    """The full feature table."""
    return features(t, by, point_in_time)


@operator(**READS)
def horizon_target(t: Tables, *, by: str | None = None, horizon: int = 3) -> DataFrame:
    """Entity, month, and the profit to predict."""
    return labelled(t, by, horizon).select("entity", "year_month", "target_profit", "target_is_profitable")


@operator(**READS)
def train_test_sample(t: Tables, *, by: str | None = None, horizon: int = 3, share: float = 0.75, seed: int = 42,
                      mode: str = "hash") -> DataFrame:
    """Which rows train and which test."""
    rows = mark_train(labelled(t, by, horizon), share, seed, mode)
    return rows.select("entity", "year_month", "target_is_profitable", "is_train")


@operator(**READS)
def standardize(t: Tables, *, by: str | None = None, digits: int | None = None) -> DataFrame:
    """The features as standard scores."""
    rows = features(t, by)
    names = feature_names(rows)
    return standard_scores(rows, names, digits).select("entity", "year_month", *names)


@operator(**READS)
def profit_summary(t: Tables, *, as_of: date, by: str | None = None, horizon: int = 3) -> DataFrame:
    """Months, profitable and not, and means, as text."""
    one = monthly(t, by).agg(
        F.min("year_month").alias("a"), F.max("year_month").alias("b"), F.count(F.lit(1)).alias("n"),
        F.sum("is_profitable").alias("good"), F.avg("operating_profit").alias("profit"),
        F.avg("operating_margin_pct").alias("margin"),
    )
    return key_values(
        one,
        Analysis_Date=F.lit(as_of), Forecast_Horizon=F.lit(f"{horizon} months ahead"),
        Model_Type=F.lit("Random Forest + Gradient Boosting"),
        Historical_Period=F.concat_ws(" to ", F.date_format("a", "yyyy-MM"), F.date_format("b", "yyyy-MM")),
        Total_Months_Analyzed=F.col("n"), Profitable_Months=F.col("good"), Loss_Months=F.col("n") - F.col("good"),
        Average_Monthly_Profit=dollars(F.col("profit")), Average_Operating_Margin=with_percent(F.col("margin")),
    )
