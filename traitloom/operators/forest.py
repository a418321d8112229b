"""Random forests as tables: fit, importance, and pairwise interactions from root-to-leaf paths."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.session import delete_at_end, materialise, new_path


def fit(rows: DataFrame, trees: int, depth: int = 5, features: str = "all", share: float = 1.0, seed: int = 1) -> RandomForestRegressionModel:
    """Fit on the rows whose fold is train; ``rows``: x (array), y. Spark's depth ends at 30."""
    train = rows.where(F.col("fold") == "train").select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    return RandomForestRegressor(numTrees=trees, maxDepth=min(depth, 30), featureSubsetStrategy=features, subsamplingRate=share, minInstancesPerNode=1, seed=seed).fit(train)


def nodes(model: RandomForestRegressionModel, spark: SparkSession) -> DataFrame:
    """The trees as a table: tree, node, left, right (-1 in a leaf), feature, threshold, gain, cover, value.

    The model is saved in the shared folder, which all executors reach."""
    path = new_path(spark, "forest")
    model.write().overwrite().save(path)
    delete_at_end(spark, path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["gain"].alias("gain"),
        n["impurityStats"][0].alias("cover"),
        n["prediction"].alias("value"),
    )


def importance(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, importance): gain weighted by cover, as shares of each tree and then of all; trees without a split count
    nothing."""
    inner = table.where("left >= 0").groupBy(*by, "tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("g"))
    total = inner.groupBy(*by, "tree").agg(F.sum("g").alias("t"))
    each = inner.join(total, [*by, "tree"]).groupBy(*by, "feature").agg(F.sum(F.try_divide("g", "t")).alias("g"))
    every = each.withColumn("_k", F.lit(0)).groupBy(*by, "_k").agg(F.sum("g").alias("all_"))
    return each.withColumn("_k", F.lit(0)).join(every, [*by, "_k"]).select(*by, "feature", F.try_divide("g", "all_").alias("importance"))


def leaf_paths(table: DataFrame, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tree, leaf, value, conditions): for each leaf one condition a feature on its path: feature, low < x <= high, and
    z, the share of the cover that goes the leaf's way at the feature's splits. One join a level, written before the next;
    ends where no node is left."""
    keys = [*by, "tree"]
    at = table.where("node = 0").select(*keys, "node", F.array().cast("array<struct<feature:int,low:double,high:double,z:double>>").alias("path"))
    inf, done = float("inf"), None
    child = table.select(*keys, F.col("node").alias("child"), F.col("cover").alias("child_cover"))
    for level in range(depth + 1):
        here = at.join(table, [*keys, "node"])
        leaves = here.where("left < 0").select(*keys, F.col("node").alias("leaf"), "value", "path")
        done = leaves if done is None else done.unionByName(leaves)
        steps = here.where("left >= 0").select(
            *keys, "path", "feature", "cover",
            F.explode(F.array(
                F.struct(F.col("left").alias("child"), F.lit(-inf).alias("low"), F.col("threshold").alias("high")),
                F.struct(F.col("right").alias("child"), F.col("threshold").alias("low"), F.lit(inf).alias("high")),
            )).alias("s"),
        ).select(*keys, "path", "feature", "cover", "s.*")
        step = F.struct(F.col("feature").cast("int").alias("feature"), "low", "high", (F.col("child_cover") / F.col("cover")).alias("z"))
        at = steps.join(child, [*keys, "child"]).select(*keys, F.col("child").alias("node"), F.concat("path", F.array(step)).alias("path"))
        at = materialise(at, f"paths-{level}")
        if at.isEmpty():
            break
    merged = done.select(*keys, "leaf", "value", F.explode("path").alias("p")).groupBy(*keys, "leaf", "value", "p.feature").agg(
        F.max("p.low").alias("low"), F.min("p.high").alias("high"), F.product("p.z").alias("z")
    )
    return merged.groupBy(*keys, "leaf", "value").agg(F.array_sort(F.collect_list(F.struct("feature", "low", "high", "z"))).alias("conditions"))


def interactions(paths: DataFrame, rows: DataFrame, trees: int, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, value): sum over rows of the absolute interaction of features i < j, halved as in a symmetric matrix.

    For a row and leaf, o says whether a condition is met; the pair's index is the leaf's value times
    (o_i - z_i)(o_j - z_j) times the integral over t of the product of z(1 - t) + o t over the other conditions, which
    Gauss-Legendre nodes give exactly. Pairs that share no path are 0 and have no row. ``rows``: by, id, x; a row meets its trees one by one.
    """
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-depth // 2)))
    x_of = lambda c: F.element_at("x", c["feature"] + 1)
    asked = rows.select(*by, "id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    met = asked.join(paths, [*by, "tree"]).select(
        *by, "id", "tree", "leaf", "value",
        F.transform("conditions", lambda c: F.struct(c["feature"].alias("f"), ((x_of(c) > c["low"]) & (x_of(c) <= c["high"])).cast("double").alias("o"), c["z"].alias("z"))).alias("c"),
    )
    pairs = met.select(*by, "id", "value", "c", F.posexplode("c").alias("pi", "a")).select(*by, "id", "value", "c", "pi", "a", F.posexplode("c").alias("pj", "b")).where("pi < pj")
    gain = (F.col("a.o") - F.col("a.z")) * (F.col("b.o") - F.col("b.z"))

    def rest(t: float) -> Column:
        others = F.filter("c", lambda c: (c["f"] != F.col("a.f")) & (c["f"] != F.col("b.f")))
        return F.aggregate(others, F.lit(1.0), lambda s, c: s * (c["z"] * (1 - t) + c["o"] * t))

    integral = sum((rest(float((p + 1) / 2)) * float(w / 2) for p, w in zip(points, weights)), F.lit(0.0))
    each = pairs.where(gain != 0).select(*by, "id", F.col("a.f").alias("i"), F.col("b.f").alias("j"), (F.col("value") * gain * integral).alias("v"))
    by_row = each.groupBy(*by, "id", "i", "j").agg((F.sum("v") / trees / 2).alias("v"))
    return by_row.groupBy(*by, "i", "j").agg(F.sum(F.abs("v")).alias("value"))
