"""Kernel maps, layer-wise attributions and attention layers against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import explain, gradient, kernel


@pytest.mark.parametrize("degree,constant", [(1, 0.0), (2, 1.0), (3, 0.5)])
def test_tensor_sketch_approaches_the_polynomial_kernel(degree, constant):
    draw = np.random.default_rng(degree)
    x = draw.integers(0, 3, (40, 30)).astype(float)
    exact = (0.05 * x @ x.T + constant) ** degree
    sketched = [kernel.TensorSketch(30, 1024, 0.05, degree, constant, seed)(x) for seed in range(30)]
    told = np.mean([f @ f.T for f in sketched], axis=0)
    assert np.abs(told - exact).max() < 0.05 * exact.max()
    wide = kernel.TensorSketch(30, 1 << 16, 0.05, degree, constant)(x)
    assert np.abs(wide @ wide.T - exact).max() < 0.05 * exact.max()
    with pytest.raises(ValueError):
        kernel.kernel_map("other", 3, 4, 1.0)


def test_polynomial_regression_learns_a_product(spark):
    """A target that is a product of two markers: the polynomial kernel predicts it, the linear one does not."""
    draw = np.random.default_rng(4)
    x = draw.integers(-1, 2, (400, 5)).astype(float)
    y = 3 * x[:, 0] * x[:, 1] + draw.normal(0, 0.1, 400)
    rows = spark.createDataFrame([("s", i, x[i].tolist(), float(y[i])) for i in range(400)], "scenario_id string, id long, x array<double>, y double")
    found = {}
    for name, width in (("linear", 5), ("poly", 128)):
        models = gradient.fit_svr(rows.where("id < 300"), {"s": kernel.kernel_map(name, 5, 128, 0.5, 2, 1.0)}, width, 0.1, 5.0)
        told = gradient.predict(rows.where("id >= 300"), models).select("y", "predicted").toPandas()
        found[name] = 1 - ((told["y"] - told["predicted"]) ** 2).mean() / told["y"].var()
    assert found["poly"] > 0.95 > 0.5 > found["linear"]


def network(width, hidden, seed):
    draw = np.random.default_rng(seed)
    return gradient.Network(draw.normal(0, 1, (hidden, width)), draw.normal(0, 1, hidden), draw.normal(0, 1, hidden), 0.3)


def test_layer_wise_attributions(spark):
    """They add up, equal the linear values where every unit stays active, and leave odd rows out."""
    draw = np.random.default_rng(2)
    x, nets = draw.integers(0, 3, (30, 6)).astype(float), {"a": network(6, 9, 1), "b": network(6, 9, 2)}
    nets["b"].b1 = np.full(9, 100.0)  # never off: a linear network
    rows = spark.createDataFrame([(g, i, x[i].tolist(), "k") for g in "ab" for i in range(30)] + [("a", 99, None, "k"), ("a", 98, [None] * 6, "k"), ("c", 1, x[0].tolist(), "k")], "g string, id long, x array<double>, pos string")
    back = rows.where("id < 4")
    phi = explain.rescaled_attributions(rows, back, nets, ["g"]).toPandas()
    assert set(phi["g"]) == {"a", "b"} and len(phi) == 2 * 30 * 6
    for g, net in nets.items():
        sums = phi[phi["g"] == g].groupby("id")["phi"].sum()
        np.testing.assert_allclose(sums, net.forward(x) - net.forward(x[:4]).mean(), atol=1e-9)
    mine = phi[phi["g"] == "b"].pivot(index="id", columns="pos", values="phi").to_numpy()
    np.testing.assert_allclose(mine, (nets["b"].w2 @ nets["b"].w1) * (x - x[:4].mean(0)), atol=1e-9)
    alone = explain.rescaled_attributions(rows.where("g = 'a'"), back.where("g = 'a'"), {None: nets["a"]}, [])
    assert alone.count() == 180 and explain.rescaled_attributions(rows.limit(0), back, nets, ["g"]).count() == 0


def test_attention_layers_against_dense_algebra(spark):
    """Two layers of several heads and relations, a hot target, repeated edges, nodes without edges or vectors."""
    draw = np.random.default_rng(3)
    d, wide = 4, 3
    h = {n: draw.normal(0, 1, d) for n in range(12)}
    edges = [(r, s, t) for r in (0, 1) for s in range(12) for t in (0, 1, 2) if draw.random() < 0.5] + [(0, s % 12, 5) for s in range(200)]
    weights = {(r, k): (draw.normal(0, 1, (wide, d)), draw.normal(0, 1, (wide, d)), draw.normal(0, 1, wide)) for r in (0, 1) for k in (0, 1)}

    def layer(h, concat, skip, active):
        out = {}
        for t in h:
            total = 0
            for r in (0, 1):
                heads = []
                for k in (0, 1):
                    ws, wd, a = weights[r, k]
                    mine = [s for r_, s, t_ in edges if (r_, t_) == (r, t)]
                    z = np.array([ws @ h[s] + wd @ h[t] for s in mine]).reshape(-1, wide)
                    e = np.exp(np.where(z > 0, z, 0.2 * z) @ a) if mine else np.zeros(0)
                    heads.append((e[:, None] * np.array([ws @ h[s] for s in mine]).reshape(-1, wide)).sum(0) / e.sum() if mine else None)
                if heads[0] is not None:
                    total = total + (np.concatenate(heads) if concat else np.mean(heads, axis=0))
            v = skip @ h[t] + total
            out[t] = np.where(v > 0, v, np.expm1(v)) if active else v
        return out

    node = lambda h: spark.createDataFrame([(n, v.tolist()) for n, v in h.items()] + [(77, None)], "node long, h array<double>")
    table = spark.createDataFrame([(*e, "extra") for e in edges] + [(9, 0, 1, ""), (0, 77, 1, ""), (0, 1, 77, "")], "relation long, src long, dst long, head string")
    given = spark.createDataFrame([(r, k, ws.tolist(), wd.tolist(), a.tolist()) for (r, k), (ws, wd, a) in weights.items()], "relation long, head int, w_src array<array<double>>, w_dst array<array<double>>, a array<double>")
    for concat, active in ((True, True), (False, False)):
        skip = draw.normal(0, 1, (wide * (2 if concat else 1), d))
        got = {r.node: r.h for r in explain.attention_layer(table, node(h), node(h), given, skip.tolist(), concat, active).collect()}
        expected = layer(h, concat, skip, active)
        assert set(got) == set(expected)
        for n in expected:
            np.testing.assert_allclose(got[n], expected[n], atol=1e-9)
    assert explain.attention_layer(table.limit(0), node(h), node(h), given, skip.tolist(), False).count() == 12
