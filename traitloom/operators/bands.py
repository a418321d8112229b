"""Mean effects, their decile bands on the genome, and the strongest links between markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.functions import padded, share

DECILES = [k / 10 for k in range(1, 10)]


def mean_effects(effects: DataFrame) -> DataFrame:
    """Mean absolute effect of each marker, in all (population null, overall 1) and in each population (overall 0), in one
    pass. Null effects are left out (null if a marker has no other), repeated rows count each, an empty table gives no rows."""
    sets = [["phenotype", "model", "marker"], ["population", "phenotype", "model", "marker"]]
    absolute = effects.select("population", "phenotype", "model", "marker", F.abs("effect").alias("effect"))
    out = absolute.groupingSets([[F.col(c) for c in s] for s in sets], "population", "phenotype", "model", "marker")
    return out.agg(F.grouping("population").alias("overall"), F.avg("effect").alias("effect"))


def band_levels(means: DataFrame, by: list[str], value: str = "effect") -> DataFrame:
    """``level`` 1 to 10: one more than the number of deciles of the group that the value reaches. Equal values share a
    level; if all are equal it is 10. A null value has no level; null keys are a group; other columns are passed on."""
    deciles = means.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(q) for q in DECILES))).alias("_q"))
    deciles = deciles.select(*(F.col(c).alias(f"_{c}") for c in by), "_q")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    level = 1 + F.size(F.filter("_q", lambda t: F.col(value) >= t))
    return means.join(deciles, same).select(*means.columns, level.alias("level"))


def colour(bands: DataFrame) -> DataFrame:
    """Band label: red for the ensemble, blue for a model, and the level; null without a level. Replaces ``colour``."""
    return bands.withColumn("colour", F.concat(F.when(F.col("model") == "ensemble", "red").otherwise("blue"), F.col("level").cast("string")))


def locate(bands: DataFrame, markers: DataFrame, pad: int = 0) -> DataFrame:
    """Bands with their marker's chromosome and region, widened by ``pad``; markers without a place are left out,
    one with several places has a row for each."""
    start, end = padded(F.col("start"), F.col("end"), pad)
    place = markers.select(F.col("name").alias("marker"), F.concat(F.lit("chr"), F.col("chromosome").cast("int").cast("string")).alias("chromosome"), start.alias("start"), end.alias("end"))
    return bands.join(place, "marker")


def mean_interactions(interactions: DataFrame, by: list[str]) -> DataFrame:
    """Mean value of each ordered pair, the pseudo-marker ``factor`` and null markers left out; null values count nothing."""
    real = interactions.where((F.col("from") != "factor") & (F.col("to") != "factor"))
    return real.groupBy(*by, "from", "to").agg(F.avg("value").alias("value"))


def top_interactions(means: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """Pairs at or above the quantile of their group, as shares of the sum of those kept (null if that is 0). Ties at the cut
    all stay; a group with a null key, and a null value, are left out."""
    cut = means.groupBy(*by).agg(F.percentile("value", F.lit(quantile)).alias("_cut"))
    kept = means.join(cut, by).where("value >= _cut").drop("_cut")
    return kept.withColumn("value", share(F.col("value"), F.sum("value").over(Window.partitionBy(*by))))


def links(pairs: DataFrame, markers: DataFrame, pad: int = 0, width: float = 1.0) -> DataFrame:
    """Pairs with both markers' places: blue between chromosomes, red inside one; ``width`` divides the line width."""
    start, end = padded(F.col("start"), F.col("end"), pad)

    def side(name):
        return markers.select(
            F.col("name").alias(name),
            F.concat(F.lit("chr"), F.col("chromosome").cast("int").cast("string")).alias(f"chromosome_{name}"),
            start.alias(f"start_{name}"),
            end.alias(f"end_{name}"),
        )

    found = pairs.join(side("from"), "from").join(side("to"), "to")
    colour_ = F.when(F.col("chromosome_from") != F.col("chromosome_to"), "blue").otherwise("red")
    return found.withColumn("colour", colour_).withColumn("line_width", F.col("value") / width)
