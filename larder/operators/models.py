"""Profit models on Spark ML: loss classifier, profit regressor, their scores, and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import labels
from larder.functions.columns import banded, percent
from larder.functions.pin import pinned, scratch_path
from larder.operators import profit
from larder.plans.operator import Tables, operator


@dataclass(frozen=True)
class ProfitModels:
    """Fitted models with the table they were fitted on. ``classifier`` is None for a single class."""

    rows: DataFrame  # all features, before the target
    marked: DataFrame  # rows with target and is_train
    names: list[str]
    classifier: PipelineModel | None
    regressor: PipelineModel | None


def _pipeline(names: list[str], model: RandomForestClassifier | GBTRegressor) -> Pipeline:
    gather = VectorAssembler(inputCols=names, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[gather, scale, model])


def _stored(model: PipelineModel) -> PipelineModel:
    """The model written to the shared folder and read back: without its training summary, which
    holds the session and cannot be sent to executors once the session has observed a query."""
    path = scratch_path(SparkSession.getActiveSession(), "classifier")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fit(t: Tables, *, by: str | None = None, horizon: int = 3, split: str = "hash", seed: int = 42, trees: int = 100,
        forest_depth: int = 10, rounds: int = 100, boost_depth: int = 5, step: float = 0.1,
        classify: bool = True, regress: bool = True, point_in_time: bool = False) -> ProfitModels:
    """Fits both models on the months of every entity.

    The feature table is pinned once: the trees pass over it many times.
    """
    everything = pinned(profit.features(t, by, point_in_time, horizon))
    targets = list(profit.TARGETS.values())
    rows, names = everything.drop(*targets), profit.feature_names(everything)
    marked = profit.mark_train(everything.na.drop(subset=targets), seed=seed, mode=split)
    train = pinned(marked.filter("is_train"))
    classifier = regressor = None
    if classify:
        sizes = train.groupBy("target_is_profitable").count()
        if sizes.count() > 1:  # one class teaches nothing
            share = F.broadcast(sizes)  # two rows: one per class
            total, classes = sizes.agg(F.sum("count")).scalar(), F.lit(2.0)
            weighed = train.join(share, "target_is_profitable").withColumn("weight", total / (classes * F.col("count")))
            forest = RandomForestClassifier(
                labelCol="target_is_profitable", featuresCol="features", weightCol="weight", numTrees=trees,
                maxDepth=forest_depth, minInstancesPerNode=2, seed=seed, probabilityCol="probability")
            classifier = _stored(_pipeline(names, forest).fit(weighed))
    if regress:
        boost = GBTRegressor(labelCol="target_profit", featuresCol="features", maxIter=rounds, maxDepth=boost_depth,
                             stepSize=step, seed=seed)
        regressor = _pipeline(names, boost).fit(train)
    return ProfitModels(rows, marked, names, classifier, regressor)


def loss_probability() -> Column:
    return vector_to_array("probability")[0]


def classified(models: ProfitModels) -> DataFrame:
    """Test rows with label, prediction and probability of loss; no rows for a single class."""
    test = models.marked.filter(~F.col("is_train"))
    if models.classifier is None:
        none = test.filter(F.lit(False))
        found = none.withColumns({"prediction": F.lit(0), "loss_probability": F.lit(0.0)})
    else:
        found = models.classifier.transform(test).withColumn("loss_probability", loss_probability())
    return found.select("entity", "year_month", F.col("target_is_profitable").alias("label"),
                        F.col("prediction").cast("int").alias("prediction"), "loss_probability")


def classifier_metrics(predicted: DataFrame) -> DataFrame:
    """Confusion counts, accuracy, and precision and recall of finding losses (label 0)."""
    def both(label: int, prediction: int) -> Column:
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))

    counts = predicted.agg(
        F.count(F.lit(1)).alias("rows"), both(0, 0).alias("loss_found"), both(0, 1).alias("loss_missed"),
        both(1, 0).alias("false_alarm"), both(1, 1).alias("profit_found"),
    )
    found = F.col("loss_found")
    return counts.select(
        "*", percent(found + F.col("profit_found"), "rows").alias("accuracy_pct"),
        percent(found, found + F.col("false_alarm")).alias("loss_precision_pct"),
        percent(found, found + F.col("loss_missed")).alias("loss_recall_pct"),
    )


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 in percent, and support, of loss (0) and profit (1)."""
    both = predicted.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "label", "prediction")
    hit = F.count_if((F.col("label") == F.col("class")) & (F.col("prediction") == F.col("class")))
    counts = both.groupBy("class").agg(
        hit.alias("hit"), F.count_if(F.col("prediction") == F.col("class")).alias("named"), F.count_if(F.col("label") == F.col("class")).alias("support"))
    return counts.select(
        "class", percent("hit", "named").alias("precision_pct"), percent("hit", "support").alias("recall_pct"),
        percent(F.col("hit") * 2, F.col("named") + F.col("support")).alias("f1_pct"), "support")


def feature_importance(spark: SparkSession, models: ProfitModels, top: int | None = None) -> DataFrame:
    """Importance per feature (a fixed list of names), greatest first; all zero without classifier."""
    weights = [0.0] * len(models.names)
    if models.classifier is not None:
        weights = models.classifier.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(models.names, weights)), "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


def predicted_profit(models: ProfitModels) -> DataFrame:
    """Test rows with actual and predicted profit."""
    test = models.marked.filter(~F.col("is_train"))
    return models.regressor.transform(test).select(
        "entity", "year_month", F.col("target_profit").alias("actual"), F.col("prediction").alias("predicted")
    )


def regressor_metrics(predicted: DataFrame) -> DataFrame:
    """MAE, RMSE, R2 and MAPE."""
    error = F.col("predicted") - F.col("actual")
    share = F.abs(F.try_divide(error, F.col("actual"))) * 100
    spread = F.var_pop("actual") * F.count("actual")
    return predicted.agg(
        F.round(F.avg(F.abs(error)), 2).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(error * error), spread), 4).alias("r2"), F.round(F.avg(share), 2).alias("mape"),
    )


def margin_rule(predicted: Column, revenue: Column, scale: float = 30) -> Column:
    """Loss probability without classifier: certain below zero, none from a margin of ``scale`` percent."""
    margin = F.when(revenue > 0, predicted / revenue * 100).otherwise(F.lit(0.0))
    return F.when(predicted < 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - margin / scale))


def alerts_from(scored: DataFrame) -> DataFrame:
    """Risk level and reasons for rows with ``predicted`` and ``loss`` (a probability)."""
    level = banded(F.col("loss"), labels.RISK_BANDS, labels.RISK_REST)
    return scored.select(
        "entity", F.date_format("year_month", "yyyy-MM").alias("month"),
        F.col("operating_profit").alias("current_profit"), F.col("predicted").alias("predicted_profit_3m_ahead"),
        (F.col("loss") * 100).alias("loss_probability"), level.alias("risk_level"), "fill_rate", "stockout_cost",
        F.col("operating_margin_pct").alias("operating_margin"),
    )


def newest(rows: DataFrame, last: int) -> DataFrame:
    """The last months of each entity."""
    by_month = Window.partitionBy("entity").orderBy(F.desc("year_month"))
    return rows.withColumn("age", F.row_number().over(by_month)).filter(F.col("age") <= last).drop("age")


def persisted(rows: DataFrame) -> DataFrame:
    """The plainest prediction: profit stays as it is. Without a fit, so every figure made of it can be checked."""
    now = F.col("operating_profit")
    return rows.withColumns({"predicted": now, "prediction": F.col("is_profitable"), "loss": margin_rule(now, F.col("revenue"))})


def risk_alerts(models: ProfitModels, last: int = 3) -> DataFrame:
    """Predicted profit and risk of the last months of each entity."""
    recent = newest(models.rows, last)
    scored = models.regressor.transform(recent).withColumnRenamed("prediction", "predicted").drop("raw", "features")
    if models.classifier is not None:
        scored = models.classifier.transform(scored).withColumn("loss", loss_probability())
    else:
        scored = scored.withColumn("loss", margin_rule(F.col("predicted"), F.col("revenue")))
    return alerts_from(scored).orderBy("entity", "month")


def alert_actions(alerts: DataFrame, low_fill: float = 90, high_stockout: float = 50000,
                  low_margin: float = 10) -> DataFrame:
    """What to do about alerts above low risk, as a list of reasons."""
    reasons = (
        F.when(F.col("fill_rate") < low_fill, F.format_string(
            "Fill rate is low (%.1f%%) - improve inventory", "fill_rate")),
        F.when(F.col("stockout_cost") > high_stockout, F.format_string(
            "High stockout costs ($%,.0f) - fix supplier issues", "stockout_cost")),
        F.when(F.col("operating_margin") < low_margin, F.format_string(
            "Low margin (%.1f%%) - reduce costs", "operating_margin")),
    )
    urgent = alerts.filter(F.col("risk_level") != labels.RISK_REST)
    return urgent.select("entity", "month", "risk_level", F.array_compact(F.array(*reasons)).alias("actions"))


def high_risk_count(alerts: DataFrame) -> DataFrame:
    """Alerts per level that the dashboard shows."""
    return alerts.agg(*(
        F.count_if(F.col("risk_level") == level).alias(level.lower().replace(" ", "_"))
        for level in (labels.RISK_BANDS[0][1], labels.RISK_BANDS[1][1], labels.RISK_REST)
    ))


# The same tables for the prediction that profit stays as it is.


@operator(**profit.READS)
def persistent_alerts(t: Tables, *, by: str | None = None, last: int = 3) -> DataFrame:
    """Alerts of the last months of each entity."""
    return alerts_from(persisted(newest(profit.features(t, by), last)))


@operator(**profit.READS)
def persistent_actions(t: Tables, *, by: str | None = None, last: int = 3) -> DataFrame:
    """What to do about them, joined to one text."""
    actions = alert_actions(alerts_from(persisted(newest(profit.features(t, by), last))))
    return actions.withColumn("actions", F.concat_ws("; ", "actions"))


@operator(**profit.READS)
def persistent_risk_count(t: Tables, *, by: str | None = None, last: int = 3) -> DataFrame:
    """Alerts per level."""
    return high_risk_count(alerts_from(persisted(newest(profit.features(t, by), last))))


def _judged(t: Tables, by: str | None, horizon: int) -> DataFrame:
    return persisted(profit.labelled(t, by, horizon)).select(
        F.col("target_is_profitable").alias("label"), "prediction", F.col("target_profit").alias("actual"), "predicted")


@operator(**profit.READS)
def persistent_classes(t: Tables, *, by: str | None = None, horizon: int = 3) -> DataFrame:
    """Scores of the class that stays as it is."""
    return classifier_metrics(_judged(t, by, horizon))


@operator(**profit.READS)
def persistent_report(t: Tables, *, by: str | None = None, horizon: int = 3) -> DataFrame:
    """Its scores by class."""
    return class_report(_judged(t, by, horizon))


@operator(**profit.READS)
def persistent_errors(t: Tables, *, by: str | None = None, horizon: int = 3) -> DataFrame:
    """Errors of the profit that stays as it is."""
    return regressor_metrics(_judged(t, by, horizon))
