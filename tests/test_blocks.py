"""Marker blocks against the solvers that hold the marker-by-marker matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom import queries
from traitloom.operators import blocks, linear
from traitloom.session import materialise


def scenarios_rows(spark, shapes, seed=1):
    """Rows of scenarios with (individuals, markers), some of the markers causal and two alike; odd rows among them."""
    draw, rows = np.random.default_rng(seed), []
    for s, (n, p) in enumerate(shapes):
        x = draw.integers(0, 3, (n, p)).astype(float)
        x[:, 1] = x[:, 0] if p > 1 else x[:, 0]
        x[:, -1] = 1.0
        y = 2 * x[:, 0] - 3 * x[:, p // 2] + draw.normal(0, 1, n)
        rows += [(f"s{s}", i, "train" if i % 5 else "test", x[i].tolist(), float(y[i]), "k") for i in range(n)]
        rows += [(f"s{s}", n, "train", x[0].tolist(), None, "k"), (f"s{s}", n + 1, "train", None, 1.0, "k"), (f"s{s}", n + 2, "train", [None] * p, 1.0, "k"), rows[-1], rows[-1]]
    rows.append(("none", 1, "train", [1.0, 2.0], None, "k"))
    return spark.createDataFrame(rows, "scenario_id string, id long, fold string, x array<double>, y double, block string").repartition(5)


def solved(fits):
    return {k: p.sort_values("pos") for k, p in fits.toPandas().groupby("scenario_id")}


@pytest.mark.parametrize("width", [None, 7])
def test_dual_ridge_equals_primal(spark, width):
    rows = scenarios_rows(spark, [(40, 90), (50, 12)])
    primal = solved(linear.fit(linear.sufficient_statistics(rows), "rrBLUP"))
    dual = solved(blocks.ridge(blocks.Blocks(rows, width)))
    assert set(primal) == set(dual) == {"s0", "s1"}
    for name, fit in primal.items():
        assert fit["pos"].tolist() == dual[name]["pos"].tolist()
        for c in ("effect", "intercept", "penalty", "noise"):
            np.testing.assert_allclose(fit[c], dual[name][c], rtol=1e-6, atol=1e-9)
    given = solved(blocks.ridge(blocks.Blocks(rows, width), penalty=2.0))
    same = solved(linear.fit(linear.sufficient_statistics(rows), "rrBLUP", penalty=2.0))
    np.testing.assert_allclose(given["s0"]["effect"], same["s0"]["effect"], rtol=1e-8, atol=1e-10)


def test_the_form_is_chosen_by_shape(spark, monkeypatch):
    """Wide scenarios by blocks, tall ones by the Gram matrix; the effects are those of either."""
    rows = scenarios_rows(spark, [(30, 80), (60, 10)])
    both = solved(linear.ridge(rows))
    primal = solved(linear.fit(linear.sufficient_statistics(rows), "rrBLUP"))
    assert set(both) == {"s0", "s1"}
    for name in both:
        np.testing.assert_allclose(both[name]["effect"], primal[name]["effect"], rtol=1e-6, atol=1e-9)
    assert linear.ridge(rows.limit(0)).count() == 0


def test_dual_of_a_hundred_thousand_markers(spark):
    """Bounded tasks: no block holds more than its cells, and predictions follow the targets."""
    n, p = 60, 100_000
    vectors = spark.range(n).select(F.lit("s").alias("scenario_id"), "id", F.lit("train").alias("fold"), F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: (F.xxhash64(k, F.col("id")) % 2 + 1).cast("double")).alias("x"))
    rows = vectors.withColumn("y", 3 * F.get("x", F.lit(5)) + F.get("x", F.lit(99_999)) + F.pmod(F.xxhash64("id"), F.lit(7)) / 10)
    held = blocks.Blocks(rows)
    assert held.table.agg(F.max(F.length("x"))).first()[0] <= 8 * blocks.CELLS and held.table.count() > 40
    fit = blocks.ridge(held, penalty=1.0).toPandas().sort_values("pos")
    assert len(fit) == p
    x = np.stack([r.x for r in rows.orderBy("id").select("x").collect()])
    y = np.array([r.y for r in rows.orderBy("id").select("y").collect()])
    xc = x - x.mean(0)
    alpha = np.linalg.solve(xc @ xc.T + np.eye(n), y - y.mean())
    np.testing.assert_allclose(fit["effect"], xc.T @ alpha, atol=1e-9)
    np.testing.assert_allclose(fit["intercept"].iloc[0], y.mean() - x.mean(0) @ (xc.T @ alpha), atol=1e-7)


@pytest.mark.parametrize("width", [8, 100])
def test_spike_slab_blocks_reach_the_fixed_point(spark, width):
    rows = scenarios_rows(spark, [(80, 16), (60, 9)], seed=3)
    one = solved(linear.fit(linear.sufficient_statistics(rows), "BayesB", linear.spike_slab_solution))
    many = solved(blocks.spike_slab(blocks.Blocks(rows, width), close=1e-9))
    for name, fit in one.items():
        np.testing.assert_allclose(fit["effect"], many[name]["effect"], atol=1e-5)
        np.testing.assert_allclose(fit["inclusion"], many[name]["inclusion"], atol=1e-5)
        np.testing.assert_allclose(fit["intercept"], many[name]["intercept"], atol=1e-4)


def test_no_rows(spark):
    held = blocks.Blocks(scenarios_rows(spark, [(10, 3)]).limit(0))
    assert blocks.ridge(held).count() == blocks.spike_slab(held).count() == 0


def sent(plan):
    """Rows of each broadcast of a plan that ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return sent(plan.executedPlan())
    if name.endswith("QueryStage"):
        return sent(plan.plan())
    kids = plan.children()
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    return own + [n for k in range(kids.size()) for n in sent(kids.apply(k))]


def test_wide_certificates_broadcast_no_markers(spark):
    """However small the files are: a row an individual or a scenario at most goes through the driver."""
    rows = materialise(scenarios_rows(spark, [(10, 400), (8, 300)]), "rows")
    cells = queries._centred_cells(rows, materialise(linear.ridge(rows), "fits"))
    assert len(cells.collect()) == 700
    assert max(sent(cells._jdf.queryExecution().executedPlan())) <= rows.count()
