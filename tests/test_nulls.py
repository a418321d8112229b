"""Vectors that are missing or hold a null, in every operator that stacks them."""

import numpy as np
from pyspark.sql import functions as F

from traitloom.operators import explain, gradient, kernel, linear, matrices
from traitloom.plans import study

SCHEMA = "scenario_id string, id long, fold string, x array<double>, y double"
ROWS = [("s", 1, "train", [1.0, 0.0], 1.0), ("s", 2, "train", [0.0, 2.0], 3.0), ("s", 3, "train", [2.0, 1.0], 2.0)]
ODD = [("s", 4, "train", None, 9.0), ("s", 5, "train", [None, 1.0], 9.0), ("s", 6, "train", [5.0, 5.0], None), ("other", 7, "test", [1.0, 1.0], 1.0)]


def test_scores_are_null_and_fits_leave_out(spark):
    rows = spark.createDataFrame(ROWS + ODD, SCHEMA)
    net = gradient.Network(np.eye(2), np.zeros(2), np.array([1.0, -1.0]), 0.5)
    told = {r.id: (r.predicted, r.own, r.g) for r in gradient.predict(rows, {"s": net}).withColumns({"own": net.scorer("x"), "g": explain.network_gradient(net.w1, net.b1, net.w2)("x")}).collect()}
    assert told[1][:2] == (1.5, 1.5) and told[4] == told[5] == (None, None, None) and told[7][0] is None and told[7][1] == 0.5
    features = {r.id: r.x for r in kernel.with_features(rows, {"s": kernel.RandomFeatures(2, 3, 1.0)}).collect()}
    assert len(features[1]) == 3 and features[4] is features[5] is features[7] is None
    cells = {(r.scenario_id, r.i, r.j): r.v for r in matrices.gram(rows, "scenario_id").collect()}
    assert cells["s", 0, 0] == 1 + 4 + 25 and cells["other", 0, 1] == 1
    clean = linear.fit(linear.sufficient_statistics(spark.createDataFrame(ROWS, SCHEMA)), "m").toPandas()
    odd = linear.fit(linear.sufficient_statistics(rows), "m").toPandas()
    np.testing.assert_allclose(clean.sort_values("pos")["effect"], odd.sort_values("pos")["effect"])
    widths = study.kernel_widths(rows)
    x = np.array([r[3] for r in ROWS] + [[5.0, 5.0]])
    assert widths["s"][0] == 2 and abs(widths["s"][1] - 1 / (2 * x.var(0).sum())) < 1e-9 and abs(widths["s"][2] - 1 / (2 * x.var())) < 1e-9
    assert widths["other"] == (2, 1.0, 1.0)


def test_scaling_is_over_the_individuals_of_a_scenario(spark):
    """An individual without a target has no part in the scaled markers."""
    from traitloom.operators import scenarios

    x = [0, 2, 1, 2, 9]
    geno = spark.createDataFrame([(i, "P", 0, "m", v) for i, v in enumerate(x)], "id long, population string, pos int, marker string, dosage int")
    pheno = spark.createDataFrame([(i, "P", t, None if i == 4 or (t == "B" and i == 0) else float(i)) for i in range(5) for t in "AB"], "id long, population string, phenotype string, y double")
    rows = study.training_rows(spark, geno, pheno, scenarios.Study(("P",), ("A", "B"), (0.5,), 1)).collect()
    for phenotype, used in (("A", [0, 1, 2, 3]), ("B", [1, 2, 3])):
        mine = {r.id: r.z[0] for r in rows if r.phenotype == phenotype}
        values = np.array([x[i] for i in used], float)
        assert sorted(mine) == used
        np.testing.assert_allclose([mine[i] for i in used], (values - values.mean()) / values.std(ddof=1))


def test_distances_leave_individuals_with_nulls_out(spark):
    geno = spark.createDataFrame([(i, "P", j, None if (i, j) == (2, 1) else i + j) for i in range(4) for j in range(2)], "id long, population string, pos int, dosage int")
    pairs = {(r.i, r.j): r.d for r in matrices.distances(geno, ["population"]).collect()}
    assert pairs == {(0, 0): 0, (0, 1): 2, (0, 3): 18, (1, 1): 0, (1, 3): 8, (3, 3): 0}
    assert explain.integrated_gradients(spark.createDataFrame(ODD, SCHEMA), lambda c: F.col(c), F.transform("x", lambda v: F.lit(0.0)), 2, []).select("id").distinct().count() == 2
