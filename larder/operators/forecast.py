"""Demand forecasts per series, their scores, and the tables made from them.

A series is the whole company, a category or a SKU. Every forecaster turns a split series into
long rows ``(series, date, model, actual, forecast)``, so that scoring is one aggregation.
A series has one row per day, a few thousand at most: windows by series hold one series in memory, the fits
below ``TOGETHER`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.functions.columns import money, ratio
from larder.functions.kernels import SEASON, extend_ar, last_mean, smooth_all, waves_all
from larder.functions.report import key_values, with_percent
from larder.plans.operator import Tables, operator

# Model names, horizon and target.
NAIVE, SMOOTHING, SEASONAL_AR, TREND_FOURIER = "Naive", "Exp_Smoothing", "Seasonal_AR", "Trend_Fourier"
FITTED, TOO_SHORT = "ok", "series too short"
HOLDOUT_DAYS = 90
TOGETHER = 1024  # series fitted side by side
TARGET_ACCURACY = 75

SALES = "date sku_id category quantity_fulfilled revenue_cents"


def of_series() -> WindowSpec:
    return Window.partitionBy("series")


def moving_average_name(rows: int) -> str:
    return f"MA_{rows}day"


def daily_sums(sales: DataFrame, by: str | None = None) -> DataFrame:
    """Demand and revenue in cents per series and day with sales."""
    series = F.lit("ALL") if by is None else F.col(by).cast("string")
    return sales.groupBy(series.alias("series"), "date").agg(
        F.sum("quantity_fulfilled").alias("demand"), F.sum("revenue_cents").alias("revenue_cents")
    )


def demand_series(sales: DataFrame, by: str | None = None, fill: bool = False, newest: int | None = None, ordered: bool = False) -> DataFrame:
    """Demand and revenue per series and day; ``fill`` adds days without sales as zero, if ``newest`` is given only
    among the newest days of a series. ``ordered`` sorts by series and day."""
    daily = daily_sums(sales, by)
    if fill:  # each day also stands for the empty days up to the next one, so sales are read once
        after = F.lead("date").over(of_series().orderBy("date"))
        daily = daily.withColumn("upto", F.coalesce(F.date_sub(after, 1), F.col("date")))
    begin = F.col("date")
    if fill and newest is not None:
        daily = daily.withColumn("begin", F.date_sub(F.max("date").over(of_series()), newest - 1)).filter("upto >= begin")
        begin = F.greatest("date", "begin")
    if ordered:  # before the empty days are added: they stand in order behind the day they follow
        daily = daily.orderBy("series", "date")
    if fill:
        spread = daily.withColumn("day", F.explode(F.sequence(begin, F.col("upto"))))
        sold = F.col("day") == F.col("date")
        daily = spread.select("series", F.col("day").alias("date"), *(
            F.when(sold, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("demand", "revenue_cents")))
    return daily.select("series", "date", "demand", money("revenue_cents").alias("revenue"))


def split(series: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """Marks the last ``holdout_days`` of each series as test rows."""
    last = F.max("date").over(of_series())
    return series.withColumn("is_test", F.col("date") > F.date_sub(last, holdout_days))


def _long(rows: DataFrame, *more: str) -> DataFrame:
    """Long rows from ``made``, a struct of model, forecast and more."""
    value = F.col("made.forecast")
    return rows.select("series", "date", "made.model", F.col("demand").alias("actual"), value,
                       F.when(value.isNull(), TOO_SHORT).otherwise(FITTED).alias("status"), *(f"made.{c}" for c in more))


def plain(rows: DataFrame, windows: Mapping[str, int]) -> DataFrame:
    """Forecasts by the mean of the last rows before the test, so many for each model; all in one pass."""
    train = (~F.col("is_test")).cast("int")
    newest_first = of_series().orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("age", F.sum(train).over(newest_first))

    def mean(window: int) -> Column:
        recent = F.when(~F.col("is_test") & (F.col("age") <= window), F.col("demand"))
        return ratio(F.sum(recent).over(of_series()), F.count(recent).over(of_series()))

    made = F.array(*(F.struct(F.lit(m).alias("model"), mean(n).alias("forecast")) for m, n in windows.items()))
    return _long(ranked.withColumn("made", made).filter("is_test").withColumn("made", F.explode("made")))


# Fits of many series side by side: their days from the first one on, demand, and the days to forecast.
Fit = Callable[[Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]], list[dict[str, np.ndarray]]]
BANDS = ("forecast_lower", "forecast_upper")


def _fitted(daily: DataFrame, fits: Mapping[str, Fit], holdout_days: int, fill: bool, more: Sequence[str] = ()) -> DataFrame:
    """A row per series and test day, with what each model made of it as ``made``, a list in the order of the models.

    A series travels as the list of its days with sales; empty days are filled in where it is fitted. A model gives
    every test row; where the series is too short for it, the forecast is NULL.
    """
    columns = ("forecast", *more)
    values = [f"{c}_{k}" for k in range(len(fits)) for c in columns]
    schema = "series string, days array<int>, actual array<bigint>, " + ", ".join(f"`{c}` array<double>" for c in values)
    sold = F.struct(F.unix_date("date").alias("day"), "demand")
    # Few bytes and much work: Spark would put them into few tasks by their size.
    tasks = 2 * daily.sparkSession.sparkContext.defaultParallelism
    lists = daily.filter("date is not null").repartition(tasks, "series").groupBy("series").agg(F.sort_array(F.collect_list(sold)).alias("sold")).select(
        "series", F.col("sold.day").alias("days"), F.col("sold.demand").alias("demand"))

    def parted(days: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if fill:
            whole = np.zeros(days[-1] - days[0] + 1)
            whole[days - days[0]] = demand
            days, demand = np.arange(days[0], days[-1] + 1), whole
        cut = int(np.searchsorted(days, days[-1] - holdout_days, side="right"))
        return days[:cut], demand[:cut], days[cut:], demand[cut:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), TOGETHER):
                part = frame.iloc[start:start + TOGETHER]
                split_up = [parted(np.asarray(d), np.asarray(q, float)) for d, q in zip(part["days"], part["demand"])]
                given = [(days - days[0] if len(days) else days, y, ahead - days[0] if len(days) else ahead) for days, y, ahead, _ in split_up]
                made = {"series": part["series"].to_numpy(), "days": [x[2] for x in split_up],
                        "actual": [[None if np.isnan(v) else int(v) for v in x[3]] for x in split_up]}
                for k, fit in enumerate(fits.values()):
                    found = fit(given)
                    for c in columns:
                        made[f"{c}_{k}"] = [f.get(c) for f in found]
                yield pd.DataFrame(made)

    rows = lists.mapInPandas(run, schema)
    at = F.posexplode("days").alias("at", "day")
    rows = rows.select("series", "actual", *values, at)

    def value(name: str) -> Column:
        return F.nanvl(F.get(name, F.col("at")), F.lit(None).cast("double"))

    made = F.array(*(F.struct(F.lit(m).alias("model"), *(value(f"{c}_{k}").alias(c) for c in columns)) for k, m in enumerate(fits)))
    return rows.select("series", F.date_from_unix_date("day").alias("date"), F.get("actual", F.col("at")).alias("demand"), made.alias("made"))


def smoothing_fit(season: int = SEASON, weights: tuple[float, ...] | None = None) -> Fit:
    """Additive trend and season; the three weights are stated or minimise the one-step squared error."""
    return lambda given: smooth_all([y for _, y, _ in given], [len(ahead) for *_, ahead in given], season, weights)


def seasonal_ar_fit(season: int = SEASON) -> Fit:
    """Autoregression with moving-average terms on the series differenced by a day and by a season, carried back to levels."""
    return lambda given: [extend_ar(y, len(ahead), season) for _, y, ahead in given]


def waves_fit(weekly: int = 3, yearly: int = 10, level: float = 0.8) -> Fit:
    """Log demand on a trend that may break, and weekly and yearly waves, with a band around the forecast."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    known: dict = {}  # a copy in each task
    return lambda given: waves_all(given, weekly, yearly, z, known=known)


def mean_fit(window: int) -> Fit:
    """The mean of the last rows, as ``plain`` has it, for series that are fitted anyway."""
    return lambda given: [last_mean(y, len(ahead), window) for _, y, ahead in given]


PLAIN: dict[str, int] = {NAIVE: 1, moving_average_name(7): 7, moving_average_name(30): 30}
FITS: dict[str, Fit] = {SMOOTHING: smoothing_fit(), SEASONAL_AR: seasonal_ar_fit(), TREND_FOURIER: waves_fit()}
FORECASTERS = (*PLAIN, *FITS)
BASELINES = (NAIVE, moving_average_name(7), moving_average_name(30))


def forecasts(sales: DataFrame, by: str | None, models: Sequence[str], holdout_days: int, fill: bool, shared: bool = False) -> DataFrame:
    """Forecasts of the test rows in long form; ``shared`` keeps the rows for which every model has one, as they alone compare models."""
    if any(m in FITS for m in models):
        points = _fitted(daily_sums(sales, by), {m: FITS[m] if m in FITS else mean_fit(PLAIN[m]) for m in models}, holdout_days, fill)
        if shared:
            points = points.filter(F.forall("made", lambda x: x["forecast"].isNotNull()))
        return _long(points.withColumn("made", F.explode("made")))
    windows = {m: PLAIN[m] for m in models}
    # A filled series has a row for every day, so no model reads further back than its window before the test.
    rows = split(demand_series(sales, by, fill, newest=holdout_days + max(windows.values())), holdout_days)
    long = plain(rows, windows)
    return common(long) if shared else long


def common(long: DataFrame) -> DataFrame:
    """The rows of those series and days for which every model has a forecast: only they compare models."""
    point = Window.partitionBy("series", "date")
    return long.withColumn("_missing", F.count_if(F.col("forecast").isNull()).over(point)).filter("_missing = 0").drop("_missing")


# Scoring, on any table of (series, date, model, actual, forecast).


def score(long: DataFrame, *keys: str) -> DataFrame:
    """MAE, RMSE, MAPE, bias and accuracy per model; zero actuals stay out of MAPE and are counted.
    ``points`` are the rows with a forecast."""
    error = F.col("forecast") - F.col("actual")
    share = F.try_divide(F.abs(error), F.abs(F.col("actual").cast("double"))) * 100
    mape = F.round(F.avg(share), 2)
    return long.groupBy(*keys, "model").agg(
        F.round(F.avg(F.abs(error)), 2).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
        mape.alias("mape"), F.round(F.avg(error), 2).alias("bias"),
        F.round(100 - F.avg(share), 2).alias("forecast_accuracy"),
        F.count("forecast").alias("points"), F.count_if((F.col("actual") == 0) & F.col("forecast").isNotNull()).alias("zero_actuals"),
    )


def rank_models(scores: DataFrame, target: float = TARGET_ACCURACY) -> DataFrame:
    """Models by MAPE (one row per model, a handful), the gain over Naive and whether the target is met."""
    everything = Window.partitionBy()
    base = F.max(F.when(F.col("model") == NAIVE, F.col("mape"))).over(everything)
    return scores.withColumns({
        "rank": F.row_number().over(Window.orderBy(F.asc_nulls_last("mape"), "model")),
        "gain_over_naive": F.round(base - F.col("mape"), 2),
        "target_met": F.col("forecast_accuracy") >= target,
    }).orderBy("rank")


def widen(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per series and day with the forecast and error of each model."""
    picks = [F.max(F.when(F.col("model") == m, F.col("forecast"))).alias(f"forecast_{m}") for m in models]
    wide = long.groupBy("series", "date", "actual").agg(*picks)
    errors = {f"error_{m}": F.col("actual") - F.col(f"forecast_{m}") for m in models}
    return wide.withColumns(errors).orderBy("series", "date")


def summarize(long: DataFrame, ranked: DataFrame, as_of: date, target: float = TARGET_ACCURACY) -> DataFrame:
    """Best model against Naive, as text."""
    top = F.col("rank") == 1

    def best(name: str) -> Column:
        return F.max(F.when(top, F.col(name)))

    naive_mape = F.max(F.when(F.col("model") == NAIVE, F.col("mape")))
    one = ranked.agg(
        F.count(F.lit(1)).alias("n"), best("model").alias("model"), best("mape").alias("mape"),
        best("forecast_accuracy").alias("accuracy"), naive_mape.alias("naive"), best("gain_over_naive").alias("gain"),
    )
    days = long.agg(F.count_distinct("date")).scalar()
    return key_values(
        one,
        Analysis_Date=F.lit(as_of), Forecast_Horizon=F.format_string("%d days", days), Models_Evaluated=F.col("n"),
        Best_Model=F.col("model"), Best_Model_MAPE=with_percent(F.col("mape")),
        Best_Model_Accuracy=with_percent(F.col("accuracy")), Target_Accuracy=F.lit(f"{target:g}%"),
        Target_Met=F.when(F.col("accuracy") >= target, "Yes").otherwise("No"),
        **{"Baseline_(Naive)_MAPE": with_percent(F.col("naive"))},
        Improvement_vs_Baseline=F.format_string("%.2f pp", "gain"),
    )


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, empty ones included."""
    span = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    ends = span.select(F.struct("low", "high")).scalar()
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    placed = values.filter(F.col(column).isNotNull()).withColumn("_ends", ends).select(column, "_ends.low", "_ends.high")
    bucket = F.least(F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("low"), width)), F.lit(0)), F.lit(bins - 1))
    counted = placed.groupBy((bucket + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.filter("low is not null").select("low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.round(F.col("low") + (F.col("bin") - 1) * width, 4).alias("bin_start"),
        F.round(F.col("low") + F.col("bin") * width, 4).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


# Operators over sales.


@operator(sales=SALES)
def daily_demand(t: Tables, *, by: str | None = None, fill: bool = False) -> DataFrame:
    """Demand and revenue per series and day."""
    return demand_series(t["sales"], by, fill, ordered=True)


@operator(sales=SALES)
def holdout_split(t: Tables, *, by: str | None = None, holdout_days: int = HOLDOUT_DAYS, fill: bool = False) -> DataFrame:
    """The daily series with its last days marked as test rows."""
    return split(demand_series(t["sales"], by, fill), holdout_days)


@operator(sales=SALES)
def forecast(t: Tables, *, models: Sequence[str] = FORECASTERS, by: str | None = None,
             holdout_days: int = HOLDOUT_DAYS, fill: bool = False, digits: int | None = None) -> DataFrame:
    """Forecasts of the held-out days by the named models."""
    long = forecasts(t["sales"], by, models, holdout_days, fill)
    return long if digits is None else long.withColumn("forecast", F.round("forecast", digits))


@operator(sales=SALES)
def smoothed(t: Tables, *, weights: tuple[float, float, float], by: str | None = None, holdout_days: int = HOLDOUT_DAYS,
             fill: bool = False, digits: int | None = None) -> DataFrame:
    """Holt-Winters with stated weights of level, trend and season."""
    made = _fitted(daily_sums(t["sales"], by), {SMOOTHING: smoothing_fit(weights=weights)}, holdout_days, fill)
    long = _long(made.withColumn("made", F.explode("made")))
    return long if digits is None else long.withColumn("forecast", F.round("forecast", digits))


@operator(sales=SALES)
def forecast_band(t: Tables, *, by: str | None = None, holdout_days: int = HOLDOUT_DAYS, fill: bool = False) -> DataFrame:
    """The trend-and-waves forecast with its lower and upper band."""
    made = _fitted(daily_sums(t["sales"], by), {TREND_FOURIER: waves_fit()}, holdout_days, fill, BANDS)
    return _long(made.withColumn("made", F.explode("made")), *BANDS)


@operator(sales=SALES)
def forecast_metrics(t: Tables, *, models: Sequence[str] = FORECASTERS, by: str | None = None,
                     holdout_days: int = HOLDOUT_DAYS, fill: bool = False, per_series: bool = False) -> DataFrame:
    """Scores per model, over all series or per series."""
    return score(forecasts(t["sales"], by, models, holdout_days, fill), *(["series"] if per_series else []))


@operator(sales=SALES)
def forecast_ranking(t: Tables, *, models: Sequence[str] = FORECASTERS, by: str | None = None,
                     holdout_days: int = HOLDOUT_DAYS, fill: bool = False) -> DataFrame:
    """Models ranked by MAPE on the rows that all of them forecast."""
    return rank_models(score(forecasts(t["sales"], by, models, holdout_days, fill, shared=True)))


@operator(sales=SALES)
def forecast_summary(t: Tables, *, as_of: date, models: Sequence[str] = FORECASTERS, by: str | None = None,
                     holdout_days: int = HOLDOUT_DAYS, fill: bool = False) -> DataFrame:
    """Headline of the comparison as text."""
    long = forecasts(t["sales"], by, models, holdout_days, fill, shared=True)
    return summarize(long, rank_models(score(long)), as_of)


@operator(sales=SALES)
def forecast_wide(t: Tables, *, models: Sequence[str] = FORECASTERS, by: str | None = None,
                  holdout_days: int = HOLDOUT_DAYS, fill: bool = False) -> DataFrame:
    """Forecasts and errors side by side."""
    return widen(forecasts(t["sales"], by, models, holdout_days, fill), models)


@operator(sales=SALES)
def error_histogram(t: Tables, *, model: str = NAIVE, bins: int = 30, by: str | None = None,
                    holdout_days: int = HOLDOUT_DAYS, fill: bool = False) -> DataFrame:
    """Histogram of one model's errors."""
    long = forecasts(t["sales"], by, [model], holdout_days, fill)
    return histogram(long.select((F.col("actual") - F.col("forecast")).alias("error")), "error", bins)
