"""The whole study: scenarios, fits, ensemble, metrics, effects, interactions, and the report of where on the genome the
models look."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitloom.functions import whole
from traitloom.operators import bands, explain, forest, gradient, grove, kernel, linear, matrices, metrics, scenarios
from traitloom.session import materialise

KEYS = ["scenario_id", "population", "phenotype", "ratio", "sample"]
PREDICTED = [*KEYS, "id", "fold", "model", "actual", "predicted"]
EFFECT = "scenario_id string, population string, phenotype string, ratio double, sample int, model string, marker string, effect double"
LINK = "scenario_id string, population string, phenotype string, ratio double, sample int, model string, from string, to string, value double"


@dataclass
class Results:
    """Predictions of both folds, metrics of the test fold, effects (of members and the ensemble), and marker interactions."""

    predictions: DataFrame
    metrics: DataFrame
    effects: DataFrame
    interactions: DataFrame


def training_rows(spark: SparkSession, geno: DataFrame, pheno: DataFrame, study: scenarios.Study, only: list[str] | None = None) -> DataFrame:
    """Scenario keys, id, fold, y, the marker vector x and the scaled one z of every usable individual.

    Markers are scaled over the individuals that a scenario uses, in both folds: those with a target of its population and
    phenotype. An individual's vectors are written once, with the list of its scenarios; a row a scenario is made of it
    only where the table is read.
    """
    usable, grid = scenarios.complete(geno, pheno), scenarios.grid(spark, study)
    if only is not None:
        grid = grid.where(F.col("scenario_id").isin(only))
        usable = usable.join(F.broadcast(grid.select("population", "phenotype").distinct()), ["population", "phenotype"])
    kept = usable.select("id", "population", "phenotype").distinct()
    scaled = matrices.standardise(geno.join(kept, ["id", "population"]), ["population", "phenotype"])
    both = matrices.vector_columns(scaled, {"x": "dosage", "z": "z"}, ["id", "population", "phenotype"])
    parts = F.collect_list(F.struct("scenario_id", "ratio", "sample", "fold")).alias("_in")
    listed = scenarios.split(usable, grid).groupBy("id", "population", "phenotype", "y").agg(parts)
    people = materialise(listed.join(both, ["id", "population", "phenotype"]), "people")
    return people.select("id", "population", "phenotype", "y", "x", "z", F.inline("_in"))


def kernel_widths(rows: DataFrame) -> dict[str, tuple[int, float, float]]:
    """Markers of each scenario, and its two kernel widths: one over the mean squared distance of all its individuals, and
    one over the markers times the variance of its training dosages. A width without variance is 1. Tasks send a few
    numbers a marker."""

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(["scenario_id", "train"], sort=False):
                x = np.stack(part["x"].to_numpy())
                held[key] = held.get(key, 0) + np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])
        for (name, train), (n, s, q) in held.items():
            yield pd.DataFrame({"scenario_id": name, "train": train, "pos": np.arange(len(n), dtype=np.int32), "n": n, "s": s, "q": q})

    whole_ = rows.where(whole("x")).select("scenario_id", (F.col("fold") == "train").alias("train"), "x")
    cells = whole_.mapInPandas(partial, "scenario_id string, train boolean, pos int, n double, s double, q double")
    own = lambda c: F.sum(F.when(F.col("train"), F.col(c)))
    per = cells.groupBy("scenario_id", "pos").agg(*(F.sum(c).alias(c) for c in "nsq"), *(own(c).alias(f"t{c}") for c in "nsq"))
    spread = lambda n, s, q: q / n - (s / n) * (s / n)
    told = per.groupBy("scenario_id").agg(
        F.count("*").alias("p"), F.sum(spread(*(F.col(c) for c in "nsq"))).alias("v"), spread(*(F.sum(f"t{c}") for c in "nsq")).alias("t")
    )
    return {r.scenario_id: (r.p, 1 / (2 * r.v) if r.v and r.v > 1e-12 else 1.0, 1 / (r.p * r.t) if r.t and r.t > 1e-12 else 1.0) for r in told.collect()}


def _tagged(told: DataFrame, model: str) -> DataFrame:
    return told.withColumn("model", F.lit(model)).withColumnRenamed("y", "actual").select(*PREDICTED)


def forests(rows: DataFrame, sizes: scenarios.Sizes) -> tuple[DataFrame, DataFrame]:
    """Predictions of each scenario's forest, and the node table of all, grown together."""
    nodes = grove.grow(rows, sizes.trees, sizes.depth, sizes.tree_share)
    return _tagged(grove.predict(rows, nodes), "RF"), nodes


def fit_models(rows: DataFrame, study: scenarios.Study) -> dict[str, dict]:
    """Models of each kind and scenario that score vectors of raw dosages: RKHS, SVR, MLP."""
    sizes, train = study.sizes, rows.where("fold = 'train'")
    if not {"RKHS", "SVR", "MLP"} & {*study.models}:
        return {}
    widths = kernel_widths(rows)
    gamma = lambda w: {"scale": w[2], "auto": 1 / w[0]}.get(sizes.gamma, sizes.gamma)
    out = {}
    if "RKHS" in study.models:
        out["RKHS"] = kernel.fit_kernel_ridge(rows, {k: kernel.RandomFeatures(w[0], sizes.features, w[1]) for k, w in widths.items()})
    if "SVR" in study.models:
        maps = {k: kernel.kernel_map(sizes.kernel, w[0], sizes.features, gamma(w), sizes.degree, sizes.constant) for k, w in widths.items()}
        width = max((w[0] for w in widths.values()), default=0) if sizes.kernel == "linear" else sizes.features
        out["SVR"] = gradient.fit_svr(train, maps, width, sizes.epsilon, sizes.cost)
    if "MLP" in study.models and widths:
        out["MLP"] = gradient.fit_network(train, max(w[0] for w in widths.values()), sizes.hidden, sizes.dropout, sizes.rate, sizes.decay, sizes.epochs, sizes.batch)
    return out


def explained_effects(rows: DataFrame, models: dict, count: int | None, sizes: scenarios.Sizes) -> DataFrame:
    """(scenario_id, pos, effect): sum of the absolute values of a scenario's explained test rows against sampled training rows:
    layer-wise attributions of networks, sampled Shapley values of other models."""
    width = max((len(r.x) for r in rows.select("x").limit(1).collect()), default=0)
    asked = scenarios.sample_rows(rows.where("fold = 'test'"), count, ["scenario_id"])
    back = scenarios.sample_rows(rows.where("fold = 'train'"), sizes.background, ["scenario_id"], seed="background")
    if all(isinstance(m, gradient.Network) for m in models.values()):
        phi = explain.rescaled_attributions(asked, back, models, ["scenario_id"])
        return explain.attribution_sums(phi, ["scenario_id", "pos"]).drop("mean_phi")
    phi = explain.sampled_shapley(asked, back, lambda x, key: models[key[0]].forward(x), width, sizes.permutations, ["scenario_id"])
    return explain.attribution_sums(phi, ["scenario_id", "pos"]).drop("mean_phi")


def run(spark: SparkSession, geno: DataFrame, pheno: DataFrame, study: scenarios.Study, only: list[str] | None = None) -> Results:
    """Predictions of every model and the ensemble, their metrics on test rows, effects of the ``explained`` models and the
    ensemble, and the forests' marker interactions, of the scenarios named by ``only`` or all. Individuals with a missing dosage
    or target are left out."""
    rows = training_rows(spark, geno, pheno, study, only)
    place = rows.select(*KEYS).distinct()
    names = geno.select("pos", "marker").distinct()
    sizes, parts, effects = study.sizes, [], []
    links = spark.createDataFrame([], LINK)

    def located(found: DataFrame, model: str) -> DataFrame:
        return found.join(names, "pos").join(place, "scenario_id").select(*KEYS, F.lit(model).alias("model"), "marker", "effect")

    scaled = rows.drop("x").withColumnRenamed("z", "x")
    for name, solve in (("rrBLUP", linear.ridge), ("BayesB", linear.spike_slab)):
        if name not in study.models:
            continue
        fits = materialise(solve(scaled, name), f"fits-{name}")
        parts.append(linear.predict(scaled, fits).select(*PREDICTED))
        if name in study.explained:
            effects.append(located(fits, name))
    for name, models in fit_models(rows, study).items():
        parts.append(_tagged(gradient.predict(rows, models), name))
        if name in study.explained and models:
            effects.append(located(explained_effects(rows, models, study.explain_rows.get(name), sizes), name))
    if "RF" in study.models and not rows.where("fold = 'train'").isEmpty():
        told, nodes = forests(rows, sizes)
        parts.append(told)
        if "RF" in study.explained:
            effects.append(located(forest.importance(nodes, ("scenario_id",)).withColumnRenamed("feature", "pos").withColumnRenamed("importance", "effect"), "RF"))
            asked = scenarios.sample_rows(rows.where("fold = 'test'"), study.explain_rows.get("RF"), ["scenario_id"])
            pairs = forest.interactions(forest.leaf_paths(nodes, sizes.depth, ("scenario_id",)), asked, sizes.trees, sizes.depth, ("scenario_id",))
            end = lambda at, to: names.select(F.col("pos").alias(at), F.col("marker").alias(to))
            links = pairs.join(end("i", "from"), "i").join(end("j", "to"), "j").join(place, "scenario_id").select(*KEYS, F.lit("RF").alias("model"), "from", "to", "value")
    members = reduce(DataFrame.unionByName, parts) if parts else rows.limit(0).withColumns({"model": F.lit(""), "predicted": F.col("y"), "actual": F.col("y")}).select(*PREDICTED)
    members = materialise(members, "predictions")
    told = members.unionByName(metrics.ensemble(members, [*KEYS, "id", "fold"]).select(*PREDICTED))
    scores = metrics.metrics(told.where("fold = 'test'"), [*KEYS, "model"])
    found = reduce(DataFrame.unionByName, effects) if effects else spark.createDataFrame([], EFFECT)
    found = materialise(found, "effects")
    return Results(told, scores, found.unionByName(metrics.ensemble_effect(found, KEYS).select(*found.columns)), links)


TABLES = ("predictions", "metrics", "effects", "interactions")


def run_resumable(spark: SparkSession, geno: DataFrame, pheno: DataFrame, study: scenarios.Study, path: str, together: int = 16) -> Results:
    """``run`` that a lost driver does not set back: scenarios are done ``together`` at a time, and what is done is kept in ``path``.

    A group's tables are written to folders named after its scenarios, a mark of its scenarios last. A new start with the
    same path skips marked scenarios and writes the folders of others anew, so no row comes twice, whatever ``together`` is then.
    Give another study or other data another path.
    """
    marks = f"{path}/done"
    files = spark._jvm.org.apache.hadoop.fs.Path(marks)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    done = {r.scenario_id for r in spark.read.parquet(marks).select("scenario_id").collect()} if there else set()
    left = sorted(r.scenario_id for r in scenarios.grid(spark, study).select("scenario_id").collect() if r.scenario_id not in done)
    for at in range(0, len(left), together):
        names = left[at : at + together]
        group = hashlib.md5("\n".join(names).encode()).hexdigest()
        results = run(spark, geno, pheno, study, names)
        for table in TABLES:
            getattr(results, table).write.mode("overwrite").parquet(f"{path}/{table}/run={group}")
        spark.createDataFrame([(n,) for n in names], "scenario_id string").write.mode("overwrite").parquet(f"{marks}/run={group}")
    finished = F.broadcast(spark.read.parquet(marks).select("run").distinct())  # a row a group
    return Results(*(spark.read.parquet(f"{path}/{t}").join(finished, "run").drop("run") for t in TABLES))


def trait_report(spark: SparkSession, geno: DataFrame, pheno: DataFrame, markers: DataFrame, study: scenarios.Study, pad: int = 100_000) -> DataFrame:
    """Located decile bands of every model's mean absolute effects, in all populations (null) and in each."""
    effects = run(spark, geno, pheno, study).effects
    banded = bands.colour(bands.band_levels(bands.mean_effects(effects), ["overall", "population", "phenotype", "model"]))
    return bands.locate(banded, markers, pad)


def rank_links(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k strongest links of each group, for display; ties in the order of their markers."""
    order = Window.partitionBy(*by).orderBy(F.desc("value"), "from", "to")
    return pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")
