"""Nulls, repeated rows, empty tables and clashing columns of the study operators."""

import pytest
from pyspark.sql import functions as F

from traitloom.operators import bands, explain, forest, kernel, linear, matrices, metrics, regions, scenarios
from traitloom.sources import append, write_table

GENO = "id long, population string, pos int, marker string, dosage int"
REGION = "key long, chromosome string, start long, end long"


def test_regions_with_nulls_repeats_and_clashes(spark):
    left = spark.createDataFrame([(1, "c", 5, 9), (None, "c", 5, 9), (2, None, 1, 2), (3, "c", 9, 5), (4, "c", 50, 60), (4, "c", 50, 60)], REGION).withColumn("_low", F.lit(1))
    right = spark.createDataFrame([(7, "c", 8, 8), (7, "c", 8, 8), (8, None, 0, 99)], REGION)
    assert sorted(str(r.key) for r in regions.overlaps(left, right, 4).collect()) == ["1", "1", "None", "None"]
    assert sorted(r.key for r in regions.novel(left, right, ["key"]).collect()) == [2, 3, 4, 4]
    bounds = spark.createDataFrame([("c", 0, 55), ("c", 0, 100), ("c", 0, 100)], "chromosome string, start long, end long")
    out = regions.out_of_bounds(left, bounds)
    assert [r.key for r in out.collect()] == [2] and out.columns == left.columns
    palette = spark.createDataFrame([("x", "red"), ("x", "blue"), (None, "green")], "class string, colour string")
    shown = regions.coloured(spark.createDataFrame([("x", 1), (None, 2)], "class string, colour int"), palette).collect()
    assert sorted((str(r["class"]), r.colour) for r in shown) == [("None", "grey"), ("x", "blue")]
    for none in (regions.overlaps(left.limit(0), right), regions.overlaps(left, right.limit(0)), regions.novel(left.limit(0), right, ["key"])):
        assert none.count() == 0
    assert regions.novel(left, right.limit(0), ["key"]).count() == 6 == regions.out_of_bounds(left, bounds.limit(0)).count()


def test_callers_columns_survive(spark):
    geno = spark.createDataFrame([(i, "P", k, f"m{k}", (i + k) % 3) for i in range(6) for k in range(2)], GENO)
    dressed = geno.withColumns({c: F.lit(7) for c in ("m", "s", "p", "rank")})
    assert {(r.m, r.s, r.p) for r in matrices.standardise(dressed, ["population"]).collect()} == {(7, 7, 7)}
    pheno = geno.select("id", "population").distinct().select("*", F.lit("T").alias("phenotype"), F.col("id").cast("double").alias("y"), F.lit(7).alias("rank"))
    split = scenarios.split(pheno, scenarios.grid(spark, scenarios.Study(("P",), ("T",), (0.5,))))
    assert {r["rank"] for r in split.collect()} == {7} and split.where("fold = 'train'").count() == 3
    assert {r["rank"] for r in scenarios.sample_rows(pheno, 2, ["population"]).collect()} == {7}


def test_repeated_and_missing_cells_of_a_vector(spark):
    geno = spark.createDataFrame([(1, "P", 1, "b", 2), (1, "P", 0, "a", 1), (1, "P", 1, "b", 0), (2, "P", 0, "a", None), (2, "P", 1, "b", 1)], GENO)
    assert {r.id: r.x for r in matrices.vectors(geno).collect()} == {1: [1.0, 0.0], 2: [None, 1.0]}


@pytest.mark.parametrize("empty", [True, False])
def test_null_effects_and_empty_tables(spark, empty):
    effects = spark.createDataFrame([("P", "T", "x", "m1", None), ("P", "T", "x", "m2", -2.0), (None, "T", "x", "m2", 1.0)], "population string, phenotype string, model string, marker string, effect double")
    effects = effects.limit(0) if empty else effects
    means = bands.mean_effects(effects)
    levels = bands.colour(bands.band_levels(means, ["overall", "population", "phenotype", "model"])).collect()
    share = metrics.normalise_effects(effects, ["model"]).collect()
    if empty:
        assert not levels and not share and metrics.ensemble_effect(effects, ["population"]).count() == 0
    else:
        assert {(r.marker, r.overall, r.effect) for r in levels if r.population == "P"} == {("m1", 0, None), ("m2", 0, 2.0)}
        assert [r.effect for r in share if r.marker == "m1"] == [None] and sum(r.effect or 0 for r in share) == 1


def test_fits_of_nothing(spark):
    rows = spark.createDataFrame([], "scenario_id string, id long, fold string, x array<double>, y double")
    cells = linear.sufficient_statistics(rows)
    assert linear.fit(cells, "rrBLUP").count() == linear.predict(rows, linear.fit(cells, "rrBLUP")).count() == 0
    assert kernel.fit_kernel_ridge(rows, {}) == {}
    nodes = spark.createDataFrame([], "tree int, node int, left int, right int, feature int, threshold double, gain double, cover double, value double")
    paths = forest.leaf_paths(nodes, 3)
    assert forest.importance(nodes).count() == paths.count() == forest.interactions(paths, rows, 2, 3).count() == 0
    edges = spark.createDataFrame([], "relation string, src long, dst long, from_src double, from_dst double, message double")
    assert explain.attention_sum(explain.attention_scores(edges), edges.select("dst").withColumn("skip", F.lit(0.0))).count() == 0
    assert matrices.distances(spark.createDataFrame([], GENO), ["population"]).count() == 0


def test_sink_in_order_and_appended(spark, tmp_path):
    frame = spark.range(500).select((F.col("id") * 37 % 500).alias("id"), F.lit("a").alias("note")).repartition(7)
    assert write_table(frame, str(tmp_path / "sorted"), order=["id"])
    found = [r.id for f in sorted((tmp_path / "sorted").glob("part-*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert found == list(range(500))
    both = append(frame.select("id"), frame.limit(2).select("note", "id"))
    assert both.count() == 502 and both.where("note IS NULL").count() == 500 and both.columns == ["id", "note"]


def test_a_constant_column_has_no_spread_in_any_partitions(spark):
    """25 rows of 7, or 49 of 1, in each partition: merged, their means are off in the last place."""
    told = spark.range(0, 100, 1, 4).select(F.lit("a").alias("model"), F.col("id").cast("double").alias("actual"), F.lit(7.0).alias("predicted"))
    both = told.union(told.select(F.lit("b"), "predicted", "actual"))
    assert {r.model: r.pearson for r in metrics.metrics(both, ["model"]).collect()} == {"a": None, "b": None}
    ids = spark.range(0, 196, 1, 4)
    geno = ids.select("id", F.lit("P").alias("population"), F.lit(0).alias("pos"), F.lit("m").alias("marker"), F.lit(1).alias("dosage"))
    assert {r.z for r in matrices.standardise(geno, ["population"]).collect()} == {-1.0}
    assert [r.gamma for r in matrices.gamma_scale(geno, ["population"]).collect()] == [None]
