"""One query for each operator of the engine, over the driver's tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions import mean_squared_error, relu
from traitloom.operators import bands, explain, forest, gradient, grove, kernel, linear, matrices, metrics, regions, scenarios
from traitloom.plans import fixtures as fx
from traitloom.plans import study as st
from traitloom.plans.sql import with_parts
from traitloom.session import delete_at_end, materialise, new_path
from traitloom.sources import append, read_chromosomes, read_markers, read_regions, read_wide, wide_predictions, write_table

STUDY = scenarios.Study(("P0", "P1", "P2", "P3", "P4"), ("DTA", "PLH"), (0.8, 0.5), 2)
FITTED = scenarios.Study(STUDY.populations, STUDY.phenotypes, (0.8,), 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_parts(sql, *parts) if parts else sql
        return f

    return register


def _split(spark, sf, study=STUDY):
    return scenarios.split(scenarios.complete(fx.geno(spark, sf), fx.pheno(spark, sf)), scenarios.grid(spark, study))


def _rows(spark, sf, study=FITTED):
    """Split rows with raw dosage vectors."""
    return _split(spark, sf, study).join(matrices.vectors(fx.geno(spark, sf)), ["id", "population"])


# ---------------------------------------------------------------- sources and reshaping


@query("SELECT id, population, marker, dosage FROM geno", "geno")
def geno_long(spark, sf):
    return fx.geno(spark, sf).select("id", "population", "marker", "dosage")


@query("SELECT id, " + ", ".join(f"max(CASE WHEN marker = 'm{k:02}' THEN dosage END) AS m{k:02}" for k in range(64)) + " FROM geno GROUP BY id", "geno")
def geno_wide_pivot(spark, sf):
    return fx.geno(spark, sf).groupBy("id").pivot("marker", [f"m{k:02}" for k in range(64)]).agg(F.first("dosage"))


@query("SELECT id, population, phenotype, y FROM usable", "usable")
def pheno_dropna(spark, sf):
    return scenarios.complete(fx.geno(spark, sf), fx.pheno(spark, sf)).select("id", "population", "phenotype", "y")


@query("SELECT scen.*, model FROM scen, (VALUES ('rrBLUP'), ('BayesB'), ('RKHS'), ('RF'), ('SVR'), ('MLP')) m(model) WHERE EXISTS (SELECT 1 FROM embeddings)", "scen")
def scenario_grid(spark, sf):
    """Scenarios of the populations that the table holds, for every model."""
    there = fx.geno(spark, sf).select("population").distinct()
    return scenarios.with_models(scenarios.grid(spark, STUDY).join(there, "population", "left_semi"), STUDY)


@query("SELECT scenario_id, id, y, fold FROM split", "split")
def train_test_split(spark, sf):
    return _split(spark, sf).select("scenario_id", "id", "y", "fold")


@query("SELECT scenario_id, id, y, CASE WHEN fold = 'train' THEN y END AS y_known FROM split", "split")
def masked_target(spark, sf):
    return _split(spark, sf).select("scenario_id", "id", "y", F.when(F.col("fold") == "train", F.col("y")).alias("y_known"))


@query("SELECT scenario_id, id FROM split WHERE fold = 'test' QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY md5(concat_ws(':', 'explain', CAST(id AS VARCHAR))), id) <= 10", "split")
def sample_rows(spark, sf):
    return scenarios.sample_rows(_split(spark, sf).where("fold = 'test'"), 10, ["scenario_id"]).select("scenario_id", "id")


@query("SELECT scenario_id, count(*) FILTER (WHERE fold = 'test') AS n_test, count(*) FILTER (WHERE fold = 'test') AS n_explain FROM split GROUP BY scenario_id", "split")
def resolve_all(spark, sf):
    return scenarios.resolve_all(_split(spark, sf), None)


# ---------------------------------------------------------------- matrices

_CONSTANT = "SELECT id, population, pos, marker, dosage FROM geno UNION ALL SELECT DISTINCT id, population, 99, 'm99', 1 FROM geno"


@query(
    f"""SELECT id, population, marker, round(coalesce((dosage - m) / nullif(s, 0) / sqrt(p), -1), 9) AS z
    FROM ({_CONSTANT}) g JOIN (SELECT population, marker, avg(dosage) AS m, stddev_samp(dosage) AS s FROM ({_CONSTANT}) GROUP BY ALL) USING (population, marker)
    JOIN (SELECT population, count(DISTINCT marker) AS p FROM ({_CONSTANT}) GROUP BY ALL) USING (population)""",
    "geno",
)
def standardise_markers(spark, sf):
    geno = fx.geno(spark, sf)
    constant = geno.select("id", "population").distinct().select("id", "population", F.lit(99).alias("pos"), F.lit("m99").alias("marker"), F.lit(1).alias("dosage"))
    return matrices.standardise(geno.unionByName(constant), ["population"]).select("id", "population", "marker", F.round("z", 9).alias("z"))


@query("SELECT a.population, CAST(a.pos AS INT) AS i, CAST(b.pos AS INT) AS j, CAST(sum(a.dosage * b.dosage) AS DOUBLE) AS v FROM geno a JOIN geno b ON a.id = b.id AND a.pos <= b.pos GROUP BY ALL", "geno")
def gram_markers(spark, sf):
    return matrices.gram(matrices.vectors(fx.geno(spark, sf)), "population")


@query(
    """SELECT scenario_id, CAST(pos AS INT) AS pos, count(*) AS n, CAST(sum(dosage) AS DOUBLE) AS sx, round(sum(y), 6) AS sy, CAST(sum(dosage * dosage) AS DOUBLE) AS sxx,
    round(sum(dosage * y), 6) AS sxy, round(sum(y * y), 4) AS syy FROM split JOIN geno USING (id) WHERE fold = 'train' GROUP BY scenario_id, pos""",
    "split",
)
def sufficient_stats(spark, sf):
    cells = linear.sufficient_statistics(_rows(spark, sf, STUDY)).withColumn("p", F.lit(64))
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
    total = cells.where("i >= p").groupBy("scenario_id").agg(at(65, 65).alias("n"), at(64, 65).alias("sy"), at(64, 64).alias("syy"))
    own = cells.where("i < p").groupBy("scenario_id", F.col("i").alias("pos")).agg(
        F.max(F.when(F.col("j") == 65, F.col("v"))).alias("sx"), F.max(F.when(F.col("j") == F.col("i"), F.col("v"))).alias("sxx"), F.max(F.when(F.col("j") == 64, F.col("v"))).alias("sxy")
    )
    return own.join(total, "scenario_id").select("scenario_id", "pos", F.col("n").cast("long").alias("n"), "sx", F.round("sy", 6).alias("sy"), "sxx", F.round("sxy", 6).alias("sxy"), F.round("syy", 4).alias("syy"))


_D = """dist AS (SELECT a.population, a.id AS i, b.id AS j, CAST(sum((a.dosage - b.dosage) * (a.dosage - b.dosage)) AS DOUBLE) AS d
    FROM geno a JOIN geno b ON a.marker = b.marker AND a.population = b.population AND a.id <= b.id GROUP BY ALL)"""


@query(f"SELECT * FROM (WITH {_D} SELECT * FROM dist)", "geno")
def pairwise_distance(spark, sf):
    return matrices.distances(fx.geno(spark, sf), ["population"])


@query(
    f"""SELECT * FROM (WITH {_D} SELECT population, i, j, round(exp(-d / (sum(CASE WHEN i < j THEN 2 * d ELSE 0 END) OVER w / power(count(*) FILTER (WHERE i = j) OVER w, 2))), 9) AS k FROM dist WINDOW w AS (PARTITION BY population))""",
    "geno",
)
def gaussian_kernel(spark, sf):
    return matrices.kernel_pairs(fx.geno(spark, sf), ["population"]).select("population", "i", "j", F.round("k", 9).alias("k"))


@query("SELECT scenario_id, round(1 / (count(DISTINCT marker) * var_pop(dosage)), 9) AS gamma FROM split JOIN geno USING (id) WHERE fold = 'train' GROUP BY scenario_id", "split")
def kernel_gamma_scale(spark, sf):
    train = _split(spark, sf).where("fold = 'train'").select("scenario_id", "id")
    return matrices.gamma_scale(train.join(fx.geno(spark, sf), "id"), ["scenario_id"]).select("scenario_id", F.round("gamma", 9).alias("gamma"))


# ---------------------------------------------------------------- metrics and ensembles


def _rounded(df, *columns, places=6):
    return df.select(*(F.round(c, places).alias(c) if c in columns else c for c in df.columns))


@query("SELECT population, phenotype, ratio, sample, model, round(pearson, 6) AS pearson, round(mse, 5) AS mse FROM scores", "scores")
def metrics_by_model(spark, sf):
    return _rounded(_rounded(metrics.metrics(fx.predictions(spark, sf)), "pearson"), "mse", places=5)


@query("SELECT population, phenotype, CAST(NULL AS DOUBLE) AS pearson, round(avg((actual - 7) * (actual - 7)), 5) AS mse FROM lines GROUP BY population, phenotype", "lines")
def metrics_zero_variance(spark, sf):
    """A constant prediction, and a model that predicts nothing but NaN beside it."""
    some = fx.predictions(spark, sf).where("model = 'RF'")
    rows = some.withColumn("predicted", F.lit(7.0)).unionByName(some.withColumn("predicted", F.lit(float("nan"))))
    return _rounded(metrics.metrics(rows, ["population", "phenotype"]), "mse", places=5)


@query(
    """SELECT population, phenotype, model, metric, count(*) AS n, round(min(value), 5) AS low, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS q50,
    round(quantile_cont(value, 0.75), 5) AS q75, round(max(value), 5) AS high, round(avg(value), 5) AS mean
    FROM (SELECT population, phenotype, model, 'pearson' AS metric, pearson AS value FROM scores UNION ALL SELECT population, phenotype, model, 'mse', mse FROM scores) WHERE value IS NOT NULL GROUP BY ALL""",
    "scores",
)
def metric_distribution(spark, sf):
    scores = metrics.metrics(fx.predictions(spark, sf))
    return _rounded(metrics.metric_distribution(scores, ["population", "phenotype", "model"]), "low", "q25", "q50", "q75", "high", "mean", places=5)


def _ensemble(spark, sf):
    return metrics.ensemble(fx.predictions(spark, sf), [*fx.LINE_KEYS, "population", "phenotype", "ratio", "sample"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, sample, round(actual, 9) AS actual, round(predicted, 9) AS predicted FROM mean_preds", "mean_preds")
def ensemble_prediction(spark, sf):
    return _rounded(_ensemble(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "sample", "actual", "predicted"), "actual", "predicted", places=9)


@query(
    """SELECT population, phenotype, ratio, sample, 'ensemble' AS model, round(covar_pop(actual, predicted) / nullif(stddev_pop(actual) * stddev_pop(predicted), 0), 6) AS pearson,
    round(avg((actual - predicted) * (actual - predicted)), 5) AS mse FROM mean_preds GROUP BY ALL
    UNION ALL SELECT population, phenotype, ratio, sample, model, round(pearson, 6), round(mse, 5) FROM scores""",
    "mean_preds",
    "scores",
)
def ensemble_metrics(spark, sf):
    all_ = metrics.metrics(_ensemble(spark, sf)).unionByName(metrics.metrics(fx.predictions(spark, sf)))
    return _rounded(_rounded(all_, "pearson"), "mse", places=5)


@query("SELECT sample, population, model, marker, round(abs(effect) / sum(abs(effect)) OVER (PARTITION BY population, phenotype, model), 10) AS effect FROM effects", "effects")
def effect_normalise(spark, sf):
    out = metrics.normalise_effects(fx.effects(spark, sf), ["population", "phenotype", "model"])
    return out.select("sample", "population", "model", "marker", F.round("effect", 10).alias("effect"))


_ENSEMBLE = """SELECT population, phenotype, 'ensemble' AS model, marker, round(sum(e) / any_value(models), 9) AS effect FROM (
    SELECT population, phenotype, model, marker, abs(effect) / sum(abs(effect)) OVER (PARTITION BY population, phenotype, model) AS e FROM effects)
    JOIN (SELECT population, phenotype, count(DISTINCT model) AS models FROM effects GROUP BY ALL) USING (population, phenotype) GROUP BY population, phenotype, marker"""


@query(_ENSEMBLE, "effects")
def ensemble_effect(spark, sf):
    return _rounded(metrics.ensemble_effect(fx.effects(spark, sf), ["population", "phenotype"]), "effect", places=9)


# ---------------------------------------------------------------- bands and links


def _means(spark, sf):
    return _rounded(bands.mean_effects(fx.effects(spark, sf)), "effect", places=9)


@query("SELECT phenotype, model, marker, effect FROM means WHERE overall = 1", "means")
def effect_mean_overall(spark, sf):
    return _means(spark, sf).where("overall = 1").select("phenotype", "model", "marker", "effect")


@query("SELECT population, phenotype, model, marker, effect FROM means WHERE overall = 0", "means")
def effect_mean_population(spark, sf):
    return _means(spark, sf).where("overall = 0").select("population", "phenotype", "model", "marker", "effect")


BY = ["overall", "population", "phenotype", "model"]


def _bands(spark, sf):
    return bands.colour(bands.band_levels(_means(spark, sf), BY))


@query("SELECT overall, population, phenotype, model, marker, effect, level, colour FROM bands", "bands")
def effect_bands(spark, sf):
    return _bands(spark, sf).select(*BY, "marker", "effect", "level", "colour")


@query(
    f"""SELECT * FROM (WITH ens AS ({_ENSEMBLE}), m AS (SELECT population, phenotype, model, marker, round(avg(abs(effect)), 9) AS effect, CAST(grouping(population) AS TINYINT) AS overall
        FROM ens GROUP BY GROUPING SETS ((phenotype, model, marker), (population, phenotype, model, marker))),
      d AS (SELECT overall, population, quantile_cont(effect, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM m GROUP BY ALL)
      SELECT m.*, CAST(1 + len(list_filter(q, lambda t: m.effect >= t)) AS INT) AS level, concat('red', 1 + len(list_filter(q, lambda t: m.effect >= t))) AS colour
      FROM m JOIN d ON m.overall = d.overall AND m.population IS NOT DISTINCT FROM d.population)""",
    "effects",
)
def effect_bands_ensemble(spark, sf):
    """The ensemble's bands, which are red."""
    means = _rounded(bands.mean_effects(ensemble_effect(spark, sf)), "effect", places=9)
    return bands.colour(bands.band_levels(means, BY)).select(*BY, "marker", "effect", "level", "colour")


@query("SELECT overall, population, phenotype, model, marker, 10 AS level FROM means", "means")
def effect_bands_ties(spark, sf):
    same = _means(spark, sf).withColumn("effect", F.lit(0.25))
    return bands.band_levels(same, BY).select(*BY, "marker", "level")


@query('SELECT overall, population, phenotype, model, marker, level, colour, chromosome, start, "end" FROM located', "located")
def marker_bands_located(spark, sf):
    return bands.locate(_bands(spark, sf), fx.markers(spark, sf), 100_000).select(*BY, "marker", "level", "colour", "chromosome", "start", "end")


def _interactions(spark, sf):
    geno = fx.geno(spark, sf)
    name = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 2, "0"))
    pairs = matrices.gram(matrices.vectors(geno), "population").where("i < j").select("population", name("i").alias("from"), name("j").alias("to"), F.col("v").alias("value"))
    factor = pairs.where("to = 'm63'").select("population", "from", F.lit("factor").alias("to"), (F.col("value") + 1000).alias("value"))
    return pairs.unionByName(factor)


@query('SELECT population, "from", "to", value FROM inter_means', "inter_means")
def interaction_mean(spark, sf):
    return bands.mean_interactions(_interactions(spark, sf), ["population"])


def _top(spark, sf):
    return bands.top_interactions(bands.mean_interactions(_interactions(spark, sf), ["population"]), ["population"], 0.98)


@query('SELECT population, "from", "to", round(value, 9) AS value FROM inter_top', "inter_top")
def interaction_top(spark, sf):
    return _rounded(_top(spark, sf), "value", places=9)


_LINKS = """SELECT t.population, t."from", t."to", concat('chr', a.chromosome) AS chromosome_from, CAST(a.start AS BIGINT) AS start_from, CAST(a."end" AS BIGINT) AS end_from,
    concat('chr', b.chromosome) AS chromosome_to, CAST(b.start AS BIGINT) AS start_to, CAST(b."end" AS BIGINT) AS end_to, round(value, 9) AS value,
    CASE WHEN a.chromosome <> b.chromosome THEN 'blue' ELSE 'red' END AS colour, round(value / 0.01, 6) AS line_width
    FROM inter_top t JOIN markers a ON t."from" = a.name JOIN markers b ON t."to" = b.name"""


def _links(spark, sf):
    return bands.links(_top(spark, sf), fx.markers(spark, sf), width=0.01)


@query(_LINKS, "inter_top", "markers")
def interaction_links(spark, sf):
    return _rounded(_rounded(_links(spark, sf), "value", places=9), "line_width")


@query(f'SELECT population, "from", "to", value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY population ORDER BY value DESC, "from", "to") AS rank FROM ({_LINKS})) WHERE rank <= 5', "inter_top", "markers")
def interaction_top_links(spark, sf):
    links = _rounded(_links(spark, sf), "value", places=9)
    return st.rank_links(links, ["population"], 5).select("population", "from", "to", "value", "rank")


# ---------------------------------------------------------------- regions


def _high(spark, sf):
    return bands.locate(_bands(spark, sf), fx.markers(spark, sf), 0).where("overall = 1 AND level >= 8").select("model", "marker", "level", "chromosome", "start", "end")


_HIGH = """SELECT model, marker, level, concat('chr', m.chromosome) AS chromosome, CAST(m.start AS BIGINT) AS start, CAST(m."end" AS BIGINT) AS "end"
    FROM bands b JOIN markers m ON b.marker = m.name WHERE overall = 1 AND level >= 8"""


@query(
    f"""SELECT h.*, g.start AS known_start, g."end" AS known_end, g.name AS known_name, g.gene_id AS known_gene_id FROM ({_HIGH}) h JOIN genes g
    ON h.chromosome = g.chromosome AND h.start <= g."end" AND h."end" >= g.start""",
    "bands", "markers", "genes",
)
def regions_overlap(spark, sf):
    return regions.overlaps(_high(spark, sf), fx.genes(spark, sf)).drop("known_chromosome", "known_class")


@query(
    f"""SELECT h.* FROM ({_HIGH}) h WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE h.chromosome = g.chromosome AND h.start <= g."end" AND h."end" >= g.start)""",
    "bands", "markers", "genes",
)
def regions_novel(spark, sf):
    """High bands that meet no known region."""
    return regions.novel(_high(spark, sf), fx.genes(spark, sf), ["model", "marker"])


@query(
    """SELECT marker, chromosome, start, "end" FROM (SELECT name AS marker, concat('chr', m.chromosome) AS chromosome, m.start, m."end" FROM markers m) r
    WHERE NOT EXISTS (SELECT 1 FROM chrom c WHERE c.chromosome = r.chromosome AND r.start >= c.start AND r."end" <= c."end")""",
    "markers", "chrom",
)
def markers_out_of_bounds(spark, sf):
    place = fx.markers(spark, sf).select(F.col("name").alias("marker"), F.concat(F.lit("chr"), F.col("chromosome").cast("string")).alias("chromosome"), "start", "end")
    return regions.out_of_bounds(place, fx.chromosomes(spark)).select("marker", "chromosome", "start", "end")


@query("SELECT gene_id, class, coalesce(colour, 'grey') AS colour FROM genes LEFT JOIN (VALUES ('Brand#11', 'red'), ('Brand#22', 'green'), ('Brand#3', 'blue')) p(class, colour) USING (class)", "genes")
def gene_colour(spark, sf):
    palette = spark.createDataFrame([("Brand#11", "red"), ("Brand#22", "green"), ("Brand#3", "blue")], "class string, colour string")
    return regions.coloured(fx.genes(spark, sf), palette).select("gene_id", "class", "colour")


# ---------------------------------------------------------------- fits


@query(
    """SELECT scenario_id, round((b3 * (a77 + 1) - b7 * a37) / ((a33 + 1) * (a77 + 1) - a37 * a37), 6) AS effect_3, round((b7 * (a33 + 1) - b3 * a37) / ((a33 + 1) * (a77 + 1) - a37 * a37), 6) AS effect_7
    FROM (SELECT scenario_id, regr_sxx(u, u) AS a33, regr_sxx(w, w) AS a77, regr_sxy(u, w) AS a37, regr_sxy(y, u) AS b3, regr_sxy(y, w) AS b7
    FROM (SELECT scenario_id, s.id, any_value(y) AS y, max(CASE WHEN pos = 3 THEN dosage END)::DOUBLE AS u, max(CASE WHEN pos = 7 THEN dosage END)::DOUBLE AS w
    FROM split s JOIN geno g ON s.id = g.id WHERE fold = 'train' GROUP BY scenario_id, s.id) GROUP BY scenario_id)""",
    "split",
)
def ridge_two_marker(spark, sf):
    two = matrices.vectors(fx.geno(spark, sf).where("pos IN (3, 7)"))
    fits = linear.fit(linear.sufficient_statistics(_split(spark, sf).join(two, ["id", "population"])), "rrBLUP", penalty=1.0)
    return fits.groupBy("scenario_id").agg(*(F.round(F.max(F.when(F.col("pos") == k, F.col("effect"))), 6).alias(f"effect_{n}") for k, n in enumerate((3, 7))))


_FITTED = "SELECT DISTINCT scenario_id, true AS ok FROM split WHERE ratio = 0.8 AND sample = 1"


@query(_FITTED, "split")
def ridge_fit_certificate(spark, sf):
    """The gradient of the penalised fit, recomputed from the individuals, is 0."""
    rows = _rows(spark, sf).cache()
    fits = linear.fit(linear.sufficient_statistics(rows), "rrBLUP").cache()
    left = linear.predict(rows, fits).where("fold = 'train'").select("scenario_id", "id", (F.col("actual") - F.col("predicted")).alias("e"))
    slope = left.join(fx.geno(spark, sf).select("id", "pos", "dosage"), "id").groupBy("scenario_id", "pos").agg(F.sum(F.col("dosage") * F.col("e")).alias("g"))
    gap = F.abs(F.col("g") - F.col("penalty") * F.col("effect"))
    return slope.join(fits, ["scenario_id", "pos"]).groupBy("scenario_id").agg((F.max(gap) < 1e-6 * (1 + F.max(F.abs("g")))).alias("ok"))


def _wide_rows(spark, sf):
    """Few individuals with many markers: the table turned over, its places as 64 individuals of each population and its rows as
    their markers, so that the markers grow with the table. A fifth of the individuals is left out of the fit."""
    turned = fx.geno(spark, sf).select("population", F.col("pos").cast("long").alias("id"), F.col("id").alias("pos"), "dosage")
    rows = matrices.vectors(turned, keys=["population", "id"])
    y = F.aggregate(F.transform(F.slice("x", 1, 7), lambda v, k: v * ((k * 37) % 11 - 5)), F.lit(0.0), lambda s, v: s + v) + (F.col("id") * 7919) % 101 / 3
    rows = rows.select(F.col("population").alias("scenario_id"), "id", F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("fold"), y.alias("y"), "x")
    return materialise(rows, "wide-rows")


def _centred_cells(rows, fits):
    """(scenario_id, pos, xr, xx) of the training rows: products of each centred marker with the residuals and with itself, by joins.
    Only the residuals are broadcast, a number an individual."""
    train = rows.where("fold = 'train'")
    told = linear.predict(train, fits, wide=True).select("scenario_id", "id", (F.col("actual") - F.col("predicted")).alias("r"))
    cells = train.select("scenario_id", "id", F.posexplode("x").alias("pos", "x")).join(F.broadcast(told), ["scenario_id", "id"])
    return cells.groupBy("scenario_id", "pos").agg(F.sum(F.col("x") * F.col("r")).alias("xr"), (F.var_pop("x") * F.count("*")).alias("xx"))


_POPULATIONS = "SELECT DISTINCT population AS scenario_id, true AS ok FROM geno"


@query(_POPULATIONS, "geno")
def ridge_dual_certificate(spark, sf):
    """More markers than individuals: the gradient of the penalised fit, recomputed from the individuals, is 0."""
    rows = _wide_rows(spark, sf)
    fits = materialise(linear.ridge(rows), "fits")
    gap = F.abs(F.col("xr") - F.col("penalty") * F.col("effect"))
    return _centred_cells(rows, fits).join(fits.hint("merge"), ["scenario_id", "pos"]).groupBy("scenario_id").agg((F.max(gap) < 1e-6 * (1 + F.max(F.abs("xr")))).alias("ok"))


@query(_POPULATIONS, "geno")
def spike_slab_blocks_certificate(spark, sf):
    """More markers than individuals: one more update of any marker, from the residuals, changes nothing."""
    rows = _wide_rows(spark, sf)
    fits = materialise(linear.spike_slab(rows, most=0), "fits")
    variance = F.col("noise") / (F.col("xx") + 1 / F.col("penalty"))
    mean = variance / F.col("noise") * (F.col("xr") + F.col("xx") * F.col("effect"))
    logit = float(np.log(0.1 / 0.9)) + 0.5 * F.log(variance / (F.col("penalty") * F.col("noise"))) + mean * mean / (2 * variance)
    again = 1 / (1 + F.exp(-logit))
    worst = F.greatest(F.abs(again * mean - F.col("effect")), F.abs(again - F.col("inclusion")))
    return _centred_cells(rows, fits).join(fits.hint("merge"), ["scenario_id", "pos"]).groupBy("scenario_id").agg((F.max(worst) < 1e-5).alias("ok"))


_B = "((pos * 37) % 11 - 5) / 10.0::DOUBLE"


@query(f"SELECT scenario_id, id, round(1.5 + sum({_B} * dosage), 6) + 0 AS predicted FROM split JOIN geno USING (id) GROUP BY scenario_id, id", "split")
def ridge_predict(spark, sf):
    """Predictions of both folds from given effects."""
    rows = _rows(spark, sf, STUDY)
    pos = F.col("pos")
    fits = rows.select("scenario_id").distinct().select("scenario_id", F.lit("rrBLUP").alias("model"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"), F.lit(1.5).alias("intercept")).withColumn("effect", ((pos * 37) % 11 - 5) / 10)
    return linear.predict(rows, fits).select("scenario_id", "id", (F.round("predicted", 6) + 0).alias("predicted"))


@query(_FITTED, "split")
def spike_slab_fit_certificate(spark, sf):
    """One more update of any marker changes nothing."""
    cells = linear.sufficient_statistics(_rows(spark, sf)).cache()
    fits = linear.fit(cells, "BayesB", linear.spike_slab_solution)

    def check(key, g, f):
        import numpy as np
        import pandas as pd

        xx, xy, *_ = linear.centred(g)
        f = f.sort_values("pos")
        alpha = f["inclusion"].to_numpy()
        mu = f["effect"].to_numpy() / np.maximum(alpha, 1e-300)
        again = [linear.spike_slab_step(k, alpha, mu, xx, xy, f["noise"].iloc[0], f["penalty"].iloc[0], 0.1) for k in range(len(alpha))]
        worst = max(max(abs(a * m - alpha[k] * mu[k]), abs(a - alpha[k])) for k, (a, m) in enumerate(again))
        return pd.DataFrame({"scenario_id": [key[0]], "ok": [bool(worst < 1e-7)]})

    return cells.groupBy("scenario_id").cogroup(fits.groupBy("scenario_id")).applyInPandas(check, "scenario_id string, ok boolean")


def _kernel_rows(spark, sf):
    """Rows of every scenario, and the width of its kernel: one over the mean distance in its population."""
    geno, split = fx.geno(spark, sf), _split(spark, sf, FITTED)
    rows = materialise(split.join(matrices.vectors(geno), ["id", "population"]), "kernel-rows")
    spread = geno.groupBy("population", "marker").agg(F.var_pop("dosage").alias("v")).groupBy("population").agg((1 / (2 * F.sum("v"))).alias("gamma"))
    return rows, {r.scenario_id: r.gamma for r in rows.select("scenario_id", "population").distinct().join(spread, "population").collect()}


def _system_holds(rows, weights, gammas):
    train = rows.where("fold = 'train'")
    told = kernel.blup_predict(train, weights, gammas)
    gap = F.abs(F.col("predicted") + F.col("penalty") * F.col("alpha") - F.col("y"))
    both = train.select("scenario_id", "id", "y").join(weights.join(told, ["scenario_id", "id"], "left"), ["scenario_id", "id"], "left")
    return both.groupBy("scenario_id").agg(F.coalesce(F.max(F.coalesce(gap, F.lit(1.0))) < 1e-6, F.lit(False)).alias("ok"))


@query(_FITTED, "split")
def kernel_blup_certificate(spark, sf):
    """(K + penalty) alpha = y - mean holds in every row; each scenario is solved by its size."""
    rows, gammas = _kernel_rows(spark, sf)
    return _system_holds(rows, materialise(kernel.blup(rows, gammas), "weights"), gammas)


@query(_FITTED, "split")
def kernel_blup_blocks_certificate(spark, sf):
    """The same of the solution by conjugate gradients over blocks of individuals."""
    rows, gammas = _kernel_rows(spark, sf)
    return _system_holds(rows, materialise(kernel.blup_in_blocks(rows, gammas), "weights"), gammas)


#: Sizes of the models in queries over all scenarios; the defaults of ``Sizes`` are those of a real study.
SMALL = scenarios.Sizes(trees=10, depth=4, hidden=8, rate=0.005, epochs=20, features=64, permutations=1, background=3)


def _raw_rows(spark, sf):
    return materialise(_rows(spark, sf), "study-rows")


def _forest(spark, sf):
    rows = _raw_rows(spark, sf)
    return rows, st.forests(rows, SMALL)[1]


@query()
def forest_importance(spark, sf):
    return forest.importance(_forest(spark, sf)[1], ("scenario_id",))


@query(
    """SELECT population, CAST(pos AS INT) AS feature, round(sum(g / t) / any_value(all_), 9) AS importance FROM (
      SELECT population, pos, tree, g, sum(g) OVER (PARTITION BY population, tree) AS t, count(DISTINCT tree) OVER (PARTITION BY population) AS all_
      FROM (SELECT population, pos, pos % 4 AS tree, count(*) * var_pop(dosage) AS g FROM geno GROUP BY ALL)) GROUP BY population, pos""",
    "geno",
)
def forest_importance_nodes(spark, sf):
    """Importance from a node table that SQL can make too: four trees a population, a split a marker that gains its variance."""
    split = fx.geno(spark, sf).groupBy("population", F.col("pos").alias("feature")).agg(F.count("*").alias("cover"), F.var_pop("dosage").alias("gain"))
    nodes = split.select("population", (F.col("feature") % 4).alias("tree"), F.col("feature").alias("node"), F.lit(1).alias("left"), "feature", "gain", "cover")
    out = forest.importance(nodes.unionByName(nodes.withColumn("left", F.lit(-1))), ("population",))  # leaves count nothing
    return out.select("population", F.col("feature").cast("int").alias("feature"), F.round("importance", 9).alias("importance"))


def _best(rows: str, by: str) -> str:
    """The first threshold of the first marker that lowers the variance of each group most."""
    return f"""SELECT {by}, pos, th FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, pos, th) AS k FROM (
        SELECT {by}, pos, th, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / n, 9) AS gain FROM (
          SELECT {by}, pos, th, sum(y) AS s, count(*) AS n, sum(y) FILTER (WHERE dosage <= th) AS sl, count(*) FILTER (WHERE dosage <= th) AS nl
          FROM {rows} r JOIN geno g ON r.id = g.id, (VALUES (0.5::DOUBLE), (1.5::DOUBLE)) t(th) GROUP BY {by}, pos, th) WHERE nl > 0 AND nl < n)) WHERE k = 1 AND gain > 0"""


def _sided(rows: str, splits: str, by: str, to: str) -> str:
    """The rows with the side of their group's split; rows of groups that are not split stay on the left."""
    on = " AND ".join(f"r.{c} = s.{c}" for c in by.split(", "))
    return f"""SELECT r.*, CASE WHEN g.dosage > s.th THEN 1 ELSE 0 END AS {to} FROM {rows} r LEFT JOIN ({splits}) s ON {on} LEFT JOIN geno g ON g.id = r.id AND g.pos = s.pos"""


@query(
    f"""SELECT * FROM (WITH here AS (SELECT scenario_id, id, y, fold FROM split WHERE ratio = 0.8 AND sample = 1),
      one AS ({_sided("here", _best("(SELECT * FROM here WHERE fold = 'train')", "scenario_id"), "scenario_id", "a")}),
      two AS ({_sided("one", _best("(SELECT * FROM one WHERE fold = 'train')", "scenario_id, a"), "scenario_id, a", "b")})
      SELECT scenario_id, id, round(p, 6) AS predicted FROM two JOIN (SELECT scenario_id, a, b, avg(y) AS p FROM two WHERE fold = 'train' GROUP BY ALL) USING (scenario_id, a, b))""",
    "split",
)
def forest_small_values(spark, sf):
    """Predictions of a tree of two levels on all training rows, of every scenario, which SQL can grow too."""
    rows = _raw_rows(spark, sf)
    told = grove.predict(rows, grove.grow(rows, 1, 2, bootstrap=False))
    return told.select("scenario_id", "id", F.round("predicted", 6).alias("predicted"))


@query()
def forest_interactions(spark, sf):
    rows, nodes = _forest(spark, sf)
    asked = scenarios.sample_rows(rows.where("fold = 'test'"), 10, ["scenario_id"])
    return forest.interactions(forest.leaf_paths(nodes, SMALL.depth, ("scenario_id",)), asked, SMALL.trees, SMALL.depth, ("scenario_id",))


def _svr(spark, sf, kind):
    rows = _raw_rows(spark, sf)
    train = rows.where("fold = 'train'")
    maps = {k: kernel.kernel_map(kind, w[0], 64, w[2], 2, 1.0) for k, w in st.kernel_widths(rows).items()}
    models = gradient.fit_svr(train, maps, 64)
    near = {k: bool(0.5 * float(g[:-1] @ g[:-1]) + abs(float(g[-1])) * 100 <= 1e-4 * v) for k, (v, g, _) in gradient.svr_passes(train, models, 0.5, 1.0).items()}
    told = gradient.predict(rows, models).groupBy("scenario_id").agg((F.count("predicted") == F.count("*")).alias("all_"))
    found = spark.createDataFrame(list(near.items()), "scenario_id string, near boolean")
    return told.join(found, "scenario_id").select("scenario_id", (F.col("all_") & F.col("near")).alias("ok"))


@query(_FITTED, "split")
def svr_poly_objective(spark, sf):
    """As ``svr_objective``, with the polynomial kernel of degree 2."""
    return _svr(spark, sf, "poly")


@query(_FITTED, "split")
def svr_objective(spark, sf):
    """Gaussian-kernel regression of every scenario. ok: at the fit, a new pass over the rows finds a gradient so small that
    the objective, which bends by 1 at least along each weight, is within a ten-thousandth of its least value; and every
    row, in both folds, is predicted."""
    return _svr(spark, sf, "rbf")


@query(_FITTED, "split")
def mlp_fit(spark, sf):
    """Network of every scenario. ok: its error on the training rows, from a forward pass of its own in column functions, is
    below half the targets' variance, the error of the best constant."""
    rows = _raw_rows(spark, sf).where("fold = 'train'")
    nets = gradient.fit_network(rows, 64, hidden=8, rate=0.005, epochs=30)
    weights = spark.createDataFrame([(k, n.w1.tolist(), n.b1.tolist(), n.w2.tolist(), n.b2) for k, n in nets.items()], "scenario_id string, w1 array<array<double>>, b1 array<double>, w2 array<double>, b2 double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    inner = F.zip_with(F.transform("w1", lambda w: dot(w, F.col("x"))), "b1", lambda a, b: relu(a + b))
    told = rows.join(weights, "scenario_id").withColumn("predicted", dot(inner, F.col("w2")) + F.col("b2"))
    return told.groupBy("scenario_id").agg((mean_squared_error("y", "predicted") < 0.5 * F.var_pop("y")).alias("ok"))


_NET_W1 = [[((k * (7 + 6 * h)) % 11 - 5) / 10 for k in range(64)] for h in range(2)]
_NET_B1, _NET_W2, _NET_B2 = [0.0317, -0.4683], [0.8, -0.6], 0.25


def _net():
    return gradient.Network(np.array(_NET_W1), np.array(_NET_B1), np.array(_NET_W2), _NET_B2)


_HIDDEN = """SELECT id, h, sum(((pos * (7 + 6 * h)) % 11 - 5) / 10.0::DOUBLE * dosage * {t}) + CASE h WHEN 0 THEN 0.0317::DOUBLE ELSE -0.4683::DOUBLE END AS a
    FROM geno, (VALUES (0), (1)) n(h) {more} GROUP BY id, h{by}"""


@query(f"SELECT id, round(0.25 + sum(greatest(a, 0) * CASE h WHEN 0 THEN 0.8::DOUBLE ELSE -0.6::DOUBLE END), 6) AS predicted FROM ({_HIDDEN.format(t='1', more='', by='')}) GROUP BY id", "geno")
def mlp_forward(spark, sf):
    return matrices.vectors(fx.geno(spark, sf)).select("id", F.round(_net().scorer("x"), 6).alias("predicted"))


# ---------------------------------------------------------------- explanations


@query(f"SELECT id, marker, round({_B} * (dosage - m), 9) + 0 AS phi FROM geno JOIN (SELECT population, marker, avg(dosage) AS m FROM geno GROUP BY ALL) USING (population, marker)", "geno")
def linear_shapley(spark, sf):
    geno = fx.geno(spark, sf)
    effects = geno.select("marker", "pos").distinct().select("marker", (((F.col("pos") * 37) % 11 - 5) / 10).alias("effect"))
    return explain.linear_shapley(geno, effects, ["population"]).select("id", "marker", (F.round("phi", 9) + 0).alias("phi"))


@query("SELECT DISTINCT population, id, true AS ok FROM geno", "geno")
def sampled_shapley_efficiency(spark, sf):
    """The values of a row add up to its score less the mean score of the background, whatever the model."""
    net = _net()
    rows = materialise(matrices.vectors(fx.geno(spark, sf)), "vectors")
    back = scenarios.sample_rows(rows, 3, ["population"], seed="background")
    phi = explain.sampled_shapley(rows, back, lambda x, key: net.forward(x), 64, 2, ["population"]).groupBy("population", "id").agg(F.sum("phi").alias("sum"))
    base = back.groupBy("population").agg(F.avg(net.scorer("x")).alias("base"))
    gap = F.abs(F.col("sum") - (net.scorer("x") - F.col("base")))
    return rows.join(base, "population").join(phi, ["population", "id"]).select("population", "id", (gap < 1e-9).alias("ok"))


@query(
    f"""SELECT id, CAST(pos AS INT) AS pos, round(dosage * avg(g), 9) + 0 AS phi FROM (
      SELECT geno.id, pos, dosage, step, sum(CASE WHEN a > 0 THEN CASE h WHEN 0 THEN 0.8::DOUBLE ELSE -0.6::DOUBLE END ELSE 0 END * ((pos * (7 + 6 * h)) % 11 - 5) / 10.0::DOUBLE) AS g
      FROM geno JOIN (SELECT id, h, step, a FROM ({_HIDDEN.format(t="(step - 0.5::DOUBLE) / 5", more=", range(1, 6) s(step)", by=", step").replace("SELECT id, h,", "SELECT id, h, step,")})) USING (id) GROUP BY geno.id, pos, dosage, step) GROUP BY id, pos, dosage""",
    "geno",
)
def integrated_gradients(spark, sf):
    grad = explain.network_gradient(np.array(_NET_W1), np.array(_NET_B1), np.array(_NET_W2))
    phi = explain.integrated_gradients(matrices.vectors(fx.geno(spark, sf)), grad, F.transform("x", lambda v: F.lit(0.0)), 5, [])
    return phi.select("id", F.col("pos").cast("int").alias("pos"), (F.round("phi", 9) + 0).alias("phi"))


_UNITS = _HIDDEN.format(t="1", more="", by="")
_SLOPE = "CASE WHEN abs(u.a - z.a) < 1e-12 THEN CASE WHEN u.a > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (greatest(u.a, 0) - greatest(z.a, 0)) / (u.a - z.a) END"


@query(
    f"""SELECT * FROM (WITH units AS ({_UNITS}), back AS (SELECT population, id AS zid FROM (SELECT population, id, dense_rank() OVER (PARTITION BY population ORDER BY id) AS k FROM geno) WHERE k <= 2 GROUP BY ALL),
      slopes AS (SELECT b.population, u.id, b.zid, u.h, {_SLOPE} AS m FROM (SELECT DISTINCT population, id FROM geno) p JOIN back b USING (population) JOIN units u ON u.id = p.id JOIN units z ON z.id = b.zid AND z.h = u.h)
      SELECT x.population, x.id, CAST(x.pos AS INT) AS pos, round(sum(m * CASE h WHEN 0 THEN 0.8::DOUBLE ELSE -0.6::DOUBLE END * ((x.pos * (7 + 6 * h)) % 11 - 5) / 10.0::DOUBLE * (x.dosage - z.dosage)) / 2 + 1e-9, 6) + 0 AS phi
      FROM slopes s JOIN geno x ON x.id = s.id JOIN geno z ON z.id = s.zid AND z.pos = x.pos GROUP BY x.population, x.id, x.pos)""",
    "geno",
)
def network_attributions(spark, sf):
    """Layer-wise attributions of a given network against two rows of each population."""
    rows = materialise(matrices.vectors(fx.geno(spark, sf)), "vectors")
    firsts = F.array_sort(F.collect_set("id"))
    back = rows.join(F.broadcast(rows.groupBy("population").agg(F.slice(firsts, 1, 2).alias("_ids"))), "population").where(F.array_contains("_ids", F.col("id")))
    nets = {r.population: _net() for r in rows.select("population").distinct().collect()}
    return explain.rescaled_attributions(rows, back, nets, ["population"]).withColumn("phi", F.round(F.col("phi") + 1e-9, 6) + 0)


@query(f"SELECT population, marker, round(sum(abs({_B} * (dosage - m))), 6) AS effect, round(avg({_B} * (dosage - m)), 6) + 0 AS mean_phi FROM geno JOIN (SELECT population, marker, avg(dosage) AS m FROM geno GROUP BY ALL) USING (population, marker) GROUP BY population, marker", "geno")
def attribution_sums(spark, sf):
    geno = fx.geno(spark, sf)
    effects = geno.select("marker", "pos").distinct().select("marker", (((F.col("pos") * 37) % 11 - 5) / 10).alias("effect"))
    out = explain.attribution_sums(explain.linear_shapley(geno, effects, ["population"]), ["population", "marker"])
    return out.select("population", "marker", F.round("effect", 6).alias("effect"), (F.round("mean_phi", 6) + 0).alias("mean_phi"))


@query(
    """SELECT dst, round(sum(h) + any_value(dst % 7), 6) AS h FROM (SELECT pos % 4 AS relation, id AS dst, sum(exp(dosage * 0.5 + pos * 0.01::DOUBLE) * dosage * (pos + 1) * 0.1::DOUBLE) / sum(exp(dosage * 0.5 + pos * 0.01::DOUBLE)) AS h FROM geno GROUP BY ALL) GROUP BY dst""",
    "geno",
)
def attention_aggregate(spark, sf):
    geno = fx.geno(spark, sf)
    edges = geno.select((F.col("pos") % 4).alias("relation"), F.col("marker").alias("src"), F.col("id").alias("dst"), (F.col("dosage") * 0.5 + F.col("pos") * 0.01).alias("score"), (F.col("dosage") * (F.col("pos") + 1) * 0.1).alias("message"))
    skip = geno.select(F.col("id").alias("dst")).distinct().withColumn("skip", (F.col("dst") % 7).cast("double"))
    return _rounded(explain.attention_sum(edges, skip), "h")


_SCORED = """SELECT pos % 4 AS relation, marker AS src, id AS dst, population, dosage, pos,
    CASE WHEN r > 0 THEN r ELSE 0.2::DOUBLE * r END AS score FROM (SELECT *, dosage - (id % 3) - 0.5::DOUBLE + pos * 0.01::DOUBLE AS r FROM geno)"""


def _edges(spark, sf):
    geno = fx.geno(spark, sf)
    edges = geno.select((F.col("pos") % 4).alias("relation"), F.col("marker").alias("src"), F.col("id").alias("dst"), "population", "pos", (F.col("dosage") - 0.5 + F.col("pos") * 0.01).alias("from_src"), (-(F.col("id") % 3)).cast("double").alias("from_dst"), (F.col("dosage") * 0.25 - 0.3).alias("message"))
    return explain.attention_scores(edges)


@query(f"SELECT relation, src, dst, round(score, 9) + 0 AS score FROM ({_SCORED})", "geno")
def attention_scores(spark, sf):
    return _edges(spark, sf).select("relation", "src", "dst", (F.round("score", 9) + 0).alias("score"))


@query(
    f"""SELECT population AS graph, round(avg(CASE WHEN h > 0 THEN h ELSE exp(h) - 1 END) + 1.5, 6) AS predicted FROM (
      SELECT population, dst, sum(h) AS h FROM (SELECT population, relation, dst, sum(exp(score) * (dosage * 0.25::DOUBLE - 0.3::DOUBLE)) / sum(exp(score)) AS h FROM ({_SCORED}) GROUP BY ALL) GROUP BY ALL) GROUP BY population""",
    "geno",
)
def graph_readout(spark, sf):
    """One prediction a population: attention sums of its individuals, exponential-linear units, and their mean."""
    edges = _edges(spark, sf)
    nodes = explain.attention_sum(edges, edges.select("dst").distinct().withColumn("skip", F.lit(0.0)))
    out = explain.decoded(nodes.join(edges.select("dst", F.col("population").alias("graph")).distinct(), "dst"), 1.5)
    return out.select("graph", F.round("predicted", 6).alias("predicted"))


@query(
    """SELECT * FROM (WITH e AS (SELECT pos % 2 AS r, pos AS src, id AS dst FROM geno WHERE dosage > 0),
      n(r, k, i, j) AS (SELECT * FROM range(2) a(r), range(2) b(k), range(2) c(i), range(2) d(j)),
      w AS (SELECT *, ((r * 8 + k * 4 + i * 2 + j) * 5 % 7 - 3) / 10.0::DOUBLE AS ws, ((r * 8 + k * 4 + i * 2 + j) * 3 % 11 - 5) / 10.0::DOUBLE AS wd FROM n),
      sv AS (SELECT DISTINCT pos AS src, j, CASE j WHEN 0 THEN pos * 0.1::DOUBLE ELSE (pos % 7) * 0.2::DOUBLE END AS v FROM geno, range(2) d(j)),
      dv AS (SELECT DISTINCT id AS dst, j, CASE j WHEN 0 THEN (id % 3)::DOUBLE ELSE (id % 5) * 0.1::DOUBLE END AS v FROM geno, range(2) d(j)),
      m AS (SELECT r, k, i, src, sum(ws * v) AS m FROM w JOIN sv USING (j) GROUP BY ALL), t AS (SELECT r, k, i, dst, sum(wd * v) AS t FROM w JOIN dv USING (j) GROUP BY ALL),
      s AS (SELECT r, k, src, dst, sum((((r * 4 + k * 2 + i) * 7 % 5 - 2) / 2.0::DOUBLE + 0.1::DOUBLE) * CASE WHEN m + t > 0 THEN m + t ELSE 0.2::DOUBLE * (m + t) END) AS s FROM e JOIN m USING (r, src) JOIN t USING (r, k, i, dst) GROUP BY ALL),
      h AS (SELECT r, k, i, dst, sum(exp(s) * m) / sum(exp(s)) AS h FROM s JOIN m USING (r, k, src) GROUP BY ALL),
      o AS (SELECT dst, k * 2 + i AS c, sum(h) AS h FROM h GROUP BY ALL),
      own AS (SELECT dst, c, sum(((c * 2 + j) % 5 - 2) / 4.0::DOUBLE * v) AS h FROM dv, range(4) x(c) GROUP BY ALL)
      SELECT dst AS node, CAST(c AS INT) AS unit, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 8) + 0 AS h FROM (SELECT own.dst, own.c, own.h + coalesce(o.h, 0) AS v FROM own LEFT JOIN o ON o.dst = own.dst AND o.c = own.c))""",
    "geno",
)
def attention_layer(spark, sf):
    """One layer of two heads and two relations over the vectors of markers and individuals, with given weights."""
    geno, half = fx.geno(spark, sf), range(2)
    at = lambda r, k, i, j: r * 8 + k * 4 + i * 2 + j
    weights = [
        (r, k, [[(at(r, k, i, j) * 5 % 7 - 3) / 10 for j in half] for i in half], [[(at(r, k, i, j) * 3 % 11 - 5) / 10 for j in half] for i in half], [((r * 4 + k * 2 + i) * 7 % 5 - 2) / 2 + 0.1 for i in half])
        for r in half for k in half
    ]
    given = spark.createDataFrame(weights, "relation int, head int, w_src array<array<double>>, w_dst array<array<double>>, a array<double>")
    pos, who = F.col("pos"), F.col("id")
    sources = geno.select(pos.alias("node")).distinct().select("node", F.array(F.col("node") * 0.1, (F.col("node") % 7) * 0.2).alias("h"))
    targets = geno.select(who.alias("node")).distinct().select("node", F.array((F.col("node") % 3).cast("double"), (F.col("node") % 5) * 0.1).alias("h"))
    edges = geno.where("dosage > 0").select((pos % 2).alias("relation"), pos.alias("src"), who.alias("dst"))
    skip = [[((c * 2 + j) % 5 - 2) / 4 for j in half] for c in range(4)]
    out = explain.attention_layer(edges, sources, targets, given, skip)
    return out.select("node", F.posexplode("h").alias("unit", "h")).withColumn("h", F.round("h", 8) + 0)


# ---------------------------------------------------------------- sources, from files that hold the tables


def _text_file(df, name, sep="\t"):
    """The table as one text file of a given name, and its folder."""
    spark = df.sparkSession
    folder = new_path(spark, "source")
    df.coalesce(1).write.option("header", True).option("sep", sep).csv(f"{folder}/written")
    delete_at_end(spark, folder)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(place(f"{folder}/written")) if f.getPath().getName().startswith("part-"))
    files.rename(part, place(f"{folder}/{name}"))
    return folder


@query("SELECT id, population, marker, CAST(pos AS INT) AS pos, CAST(dosage AS DOUBLE) AS dosage FROM geno", "geno")
def source_wide_genotypes(spark, sf):
    """A wide table, one column a marker and a target at the end, written as text and read back long."""
    wide = geno_wide_pivot(spark, sf).join(fx.pheno(spark, sf).where("phenotype = 'DTA'").select("id", "population", F.col("y").alias("DTA")), "id")
    folder = _text_file(wide.select("id", "population", *(f"m{k:02}" for k in range(64)), "DTA"), "genotypes.csv", ",")
    geno, _ = read_wide(spark, f"{folder}/genotypes.csv", 1)
    return geno.withColumn("id", F.col("id").cast("long"))


@query("SELECT id, population, 'DTA' AS phenotype, round(y, 9) AS y FROM pheno WHERE phenotype = 'DTA'", "pheno")
def source_wide_targets(spark, sf):
    wide = geno_wide_pivot(spark, sf).join(fx.pheno(spark, sf).where("phenotype = 'DTA'").select("id", "population", F.col("y").alias("DTA")), "id")
    folder = _text_file(wide.select("id", "population", *(f"m{k:02}" for k in range(64)), "DTA"), "genotypes.csv", ",")
    _, pheno = read_wide(spark, f"{folder}/genotypes.csv", 1)
    return pheno.select(F.col("id").cast("long").alias("id"), "population", "phenotype", F.round("y", 9).alias("y"))


@query("SELECT name, chromosome, CAST(start AS BIGINT) AS start, CAST(middle AS BIGINT) AS middle, CAST(\"end\" AS BIGINT) AS \"end\" FROM markers", "markers")
def source_markers(spark, sf):
    return read_markers(spark, _text_file(fx.markers(spark, sf), "marker_info.csv", ",") + "/marker_info.csv")


@query("SELECT chromosome, CAST(0 AS BIGINT) AS start, max(\"end\") AS \"end\", 'W1' AS population FROM genes GROUP BY chromosome", "genes")
def source_chromosomes(spark, sf):
    """Bounds of the chromosomes; the file's name says whose they are."""
    bounds = fx.genes(spark, sf).groupBy("chromosome").agg(F.lit(0).alias("0"), F.max("end").alias("Location"))
    return read_chromosomes(spark, _text_file(bounds, "chrom_W1.bed") + "/*.bed")


@query("SELECT chromosome, start, \"end\", name, class, CAST(NULL AS VARCHAR) AS population, 'genes' AS gene_set FROM genes", "genes")
def source_regions(spark, sf):
    known = fx.genes(spark, sf).select("chromosome", "start", "end", F.col("name").alias("ZmGene"), F.col("class").alias("pheno"))
    return read_regions(spark, _text_file(known, "genes.tsv") + "/*.tsv", "genes")


@query("SELECT chromosome, start, \"end\", name, class, 'W1' AS population, 'QTL' AS gene_set FROM genes", "genes")
def source_regions_qtl(spark, sf):
    """The second header dialect, of one population by the file's name."""
    known = fx.genes(spark, sf).select(F.col("chromosome").alias("Chromosome"), "start", "end", F.col("name").alias("Name"), F.col("class").alias("pheno"))
    return read_regions(spark, _text_file(known, "QTL_W1.tsv") + "/*.tsv", "QTL")


@query("SELECT chromosome, start, \"end\", name, class, CAST(NULL AS VARCHAR) AS population, 'branching' AS gene_set FROM genes", "genes")
def source_regions_colour(spark, sf):
    """The third header dialect, whose classes stand under the name of a colour."""
    known = fx.genes(spark, sf).select(F.col("chromosome").alias("Chromosome"), "start", "end", F.col("name").alias("Name"), F.col("class").alias("colour"))
    return read_regions(spark, _text_file(known, "branching.tsv") + "/*.tsv", "branching")


# ---------------------------------------------------------------- sinks, read back


def _written(df, form="parquet", by=None, **options):
    """The table as a later job finds it."""
    spark = df.sparkSession
    path = new_path(spark, "sink")
    write_table(df, path, form, by, **options)
    delete_at_end(spark, path)
    reader = spark.read.schema(df.schema)
    return reader.parquet(path) if form == "parquet" else reader.option("header", True).option("sep", "," if form == "csv" else "\t").csv(path)


@query(ORACLE_SQL["metrics_by_model"])
def sink_metrics(spark, sf):
    return _written(metrics_by_model(spark, sf), "csv")


@query(ORACLE_SQL["marker_bands_located"])
def sink_bands(spark, sf):
    return _written(marker_bands_located(spark, sf), "tsv", ["phenotype", "model"]).select(*BY, "marker", "level", "colour", "chromosome", "start", "end")


@query(ORACLE_SQL["interaction_links"])
def sink_interactions(spark, sf):
    return _written(interaction_links(spark, sf), by=["population"])


@query(
    f"""SELECT id, population, phenotype, ratio, sample, y AS actual, round(1.5 + sum({_B} * dosage), 6) + 0 AS "rrBLUP", round(1.5 - sum({_B} * dosage), 6) + 0 AS "BayesB"
    FROM (SELECT * FROM split WHERE fold = 'test') s JOIN geno USING (id, population) GROUP BY id, population, phenotype, ratio, sample, y""",
    "split",
)
def sink_predictions_wide(spark, sf):
    """Test predictions of two models, one column a model."""
    return _written(wide_predictions(_two_models(spark, sf), ["rrBLUP", "BayesB"], "test"))


def _two_models(spark, sf):
    rows = _rows(spark, sf, STUDY)
    pos, sign = F.col("pos"), F.when(F.col("model") == "rrBLUP", 1).otherwise(-1)
    fits = rows.select("scenario_id").distinct().select("scenario_id", F.explode(F.array(F.lit("rrBLUP"), F.lit("BayesB"))).alias("model"), F.lit(1.5).alias("intercept"))
    fits = fits.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("effect", sign * ((pos * 37) % 11 - 5) / 10)
    return linear.predict(rows, fits).withColumn("predicted", F.round("predicted", 6) + 0)


@query(
    f"""SELECT id, population, phenotype, ratio, sample, y AS actual, round(1.5 + sum({_B} * dosage), 6) + 0 AS "rrBLUP", round(1.5 - sum({_B} * dosage), 6) + 0 AS "BayesB"
    FROM (SELECT * FROM split WHERE fold = 'train') s JOIN geno USING (id, population) GROUP BY id, population, phenotype, ratio, sample, y""",
    "split",
)
def sink_predictions_wide_train(spark, sf):
    return _written(wide_predictions(_two_models(spark, sf), ["rrBLUP", "BayesB"], "train"), order=["id"])


@query("SELECT population, phenotype, model, marker, sample, round(effect, 9) + 0 AS effect FROM effects", "effects")
def sink_effects(spark, sf):
    """Effects, written as there are some; a table without rows is not written."""
    found = fx.effects(spark, sf).withColumn("effect", F.round("effect", 9) + 0)
    if write_table(found.limit(0), new_path(spark, "sink"), skip_empty=True):
        raise AssertionError("an empty result was written")
    return _written(found, by=["model"], skip_empty=True).select("population", "phenotype", "model", "marker", "sample", "effect")


@query(
    """SELECT population, marker, effect, CAST(NULL AS VARCHAR) AS note FROM effects WHERE model = 'click' UNION ALL
    SELECT population, marker, NULL, 'later' FROM effects WHERE model <> 'click'""",
    "effects",
)
def append_results(spark, sf):
    """Later results added to earlier ones that have other columns."""
    all_ = fx.effects(spark, sf)
    return append(all_.where("model = 'click'").select("population", "marker", "effect"), all_.where("model <> 'click'").select("marker", "population", F.lit("later").alias("note")))


# ---------------------------------------------------------------- end to end


def _sweep(spark, sf):
    study = replace(FITTED, sizes=SMALL, explain_rows={}, explained=())
    return st.run(spark, fx.geno(spark, sf), fx.pheno(spark, sf), study)


@query()
def sweep_metrics(spark, sf):
    """All models and their ensemble on all scenarios; accuracy on the test rows."""
    return _sweep(spark, sf).metrics


@query(
    """SELECT scenario_id, model, fold, count(*) AS n, count(y) AS n_predicted, round(sum(y), 6) AS actual FROM split,
    (VALUES ('rrBLUP'), ('BayesB'), ('RKHS'), ('RF'), ('SVR'), ('MLP'), ('ensemble')) m(model) WHERE ratio = 0.8 AND sample = 1 GROUP BY ALL""",
    "split",
)
def sweep_predictions(spark, sf):
    """Every model and the ensemble predict every row of every scenario, in both folds."""
    told = _sweep(spark, sf).predictions.groupBy("scenario_id", "model", "fold")
    return told.agg(F.count("*").alias("n"), F.count("predicted").alias("n_predicted"), F.round(F.sum("actual"), 6).alias("actual"))


@query()
def sweep_effects(spark, sf):
    """Effects of all six models and the ensemble, Shapley values of three rows a scenario included."""
    study = replace(FITTED, sizes=SMALL, explain_rows=dict.fromkeys(("RKHS", "RF", "SVR", "MLP"), 3), explained=FITTED.models)
    return st.run(spark, fx.geno(spark, sf), fx.pheno(spark, sf), study).effects


@query()
def sweep_interactions(spark, sf):
    """Marker pairs of the forests of all scenarios."""
    study = replace(FITTED, sizes=SMALL, explain_rows={"RF": 10}, models=("RF",), explained=("RF",))
    return st.run(spark, fx.geno(spark, sf), fx.pheno(spark, sf), study).interactions


@query()
def trait_report(spark, sf):
    study = replace(FITTED, sizes=SMALL, models=("rrBLUP", "BayesB", "RF", "MLP"), explain_rows={"RF": 3, "MLP": 3})
    return st.trait_report(spark, fx.geno(spark, sf), fx.pheno(spark, sf), fx.markers(spark, sf), study)
