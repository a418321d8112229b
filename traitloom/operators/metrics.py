"""Accuracy of predictions, ensembles, and normalised effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitloom.functions import mean_squared_error, pearson, share

SCENARIO = ["population", "phenotype", "ratio", "sample"]


def metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation (null if either side is constant) and mean squared error; NaN and null
    predictions or targets are left out; a group without a row left has nulls; repeated rows count each."""
    usable = predictions.withColumn("predicted", F.nanvl(F.col("predicted").cast("double"), F.lit(None).cast("double")))
    return usable.groupBy(*(by or [*SCENARIO, "model"])).agg(
        pearson("actual", "predicted").alias("pearson"), mean_squared_error("actual", "predicted").alias("mse")
    )


def ensemble(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean prediction of the members for each key; a member that is NaN or null is left out, null if none is
    left. Keys may be null; an empty table gives no rows."""
    member = F.nanvl(F.col("predicted").cast("double"), F.lit(None).cast("double"))
    return predictions.groupBy(*keys).agg(F.first("actual").alias("actual"), F.avg(member).alias("predicted")).withColumn("model", F.lit("ensemble"))


def metric_distribution(scores: DataFrame, by: list[str], values: tuple[str, ...] = ("pearson", "mse")) -> DataFrame:
    """Count, least, quartiles, most and mean of each metric; nulls are left out, a metric without values has no row."""
    long = scores.unpivot(by, list(values), "metric", "value").where("value IS NOT NULL")
    q = F.percentile("value", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    return long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high"), F.avg("value").alias("mean")).select(
        *by, "metric", "n", "low", *(F.col("q")[k].alias(f"q{n}") for k, n in enumerate((25, 50, 75))), "high", "mean"
    )


def normalise_effects(effects: DataFrame, by: list[str]) -> DataFrame:
    """Absolute effects as shares of their sum over the markers of a scenario and model; null if all are 0. Null
    effects stay null; other columns are passed on."""
    total = F.sum(F.abs("effect")).over(Window.partitionBy(*by))
    return effects.withColumn("effect", share(F.abs("effect"), total))


def ensemble_effect(effects: DataFrame, scenario: list[str]) -> DataFrame:
    """Mean of the normalised effects over the models of a scenario that have effects; a marker that a model does not
    list counts as 0 there. No rows for a scenario without any."""
    normal = normalise_effects(effects, [*scenario, "model"])
    models = normal.groupBy(*scenario).agg(F.countDistinct("model").alias("models"))
    return normal.groupBy(*scenario, "marker").agg(F.sum("effect").alias("total")).join(models, scenario).select(
        *scenario, F.lit("ensemble").alias("model"), "marker", (F.col("total") / F.col("models")).alias("effect")
    )
