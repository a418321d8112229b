"""Edge cases, properties and brute-force twins of the engine's operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import bands, explain, forest, gradient, kernel, linear, matrices, metrics, regions, scenarios
from traitloom.plans import study

KEYS = "population string, phenotype string, ratio double, sample int, model string, id long, fold string, actual double, predicted double"


def genotypes(spark, n=40, p=6, seed=1, population="P0"):
    x = np.random.default_rng(seed).integers(0, 3, (n, p))
    rows = [(i, population, j, f"m{j:02}", int(x[i, j])) for i in range(n) for j in range(p)]
    return spark.createDataFrame(rows, "id long, population string, pos int, marker string, dosage int"), x.astype(float)


def scenario_rows(spark, n=40, p=6, seed=1):
    geno, x = genotypes(spark, n, p, seed)
    y = x @ np.arange(p) + np.random.default_rng(seed + 1).normal(0, 1, n)
    pheno = spark.createDataFrame([(i, "P0", "T", float(y[i])) for i in range(n)], "id long, population string, phenotype string, y double")
    split = scenarios.split(scenarios.complete(geno, pheno), scenarios.grid(spark, scenarios.Study(("P0",), ("T",), (0.75,), 1)))
    return split.join(matrices.vectors(geno), ["id", "population"]).cache(), x, y


def test_split_sizes_and_seed(spark):
    rows = spark.createDataFrame([(i, "P0", "T", float(i)) for i in range(31)] + [(99, "P1", "T", 1.0)], "id long, population string, phenotype string, y double")
    grid = scenarios.grid(spark, scenarios.Study(("P0", "P1"), ("T",), (0.8, 0.5), 2))
    out = scenarios.split(rows, grid).groupBy("scenario_id").agg(F.count_if(F.col("fold") == "train").alias("t"), F.count("*").alias("n")).collect()
    assert {(r.n, r.t) for r in out} == {(31, 24), (31, 15), (1, 0)} and len(out) == 8
    again = scenarios.split(rows.repartition(7), grid)
    assert sorted(map(str, again.select("scenario_id", "id", "fold").collect())) == sorted(map(str, scenarios.split(rows, grid).select("scenario_id", "id", "fold").collect()))
    told = scenarios.resolve_all(scenarios.split(rows, grid), 5).collect()
    assert all(r.n_explain == 5 for r in told)


def test_missing_values_drop_the_row(spark):
    geno, _ = genotypes(spark, 3, 2)
    geno = geno.withColumn("dosage", F.when((F.col("id") != 1) | (F.col("pos") != 0), F.col("dosage")))
    pheno = spark.createDataFrame([(0, "P0", "T", 1.0), (1, "P0", "T", 1.0), (2, "P0", "T", None)], "id long, population string, phenotype string, y double")
    assert [r.id for r in scenarios.complete(geno, pheno).collect()] == [0]


def test_metrics_edges(spark):
    rows = [("P", "T", 0.8, 1, "const", i, "test", float(i), 2.0) for i in range(4)]
    rows += [("P", "T", 0.8, 1, "nan", i, "test", float(i), math.nan if i == 2 else i * 2.0) for i in range(4)]
    rows += [("P", "T", 0.8, 1, "one", 0, "test", 1.0, 3.0)]
    got = {r.model: r for r in metrics.metrics(spark.createDataFrame(rows, KEYS)).collect()}
    assert got["const"].pearson is None and got["const"].mse == pytest.approx(1.5)
    assert got["nan"].pearson == pytest.approx(1) and got["nan"].mse == pytest.approx((0 + 1 + 9) / 3)
    assert got["one"].pearson is None and got["one"].mse == 4
    mean = {r.id: r.predicted for r in metrics.ensemble(spark.createDataFrame(rows, KEYS), ["id"]).collect()}
    assert mean[2] == 2.0 and mean[3] == 4.0


def test_ensemble_is_no_worse_than_its_members_on_average(spark):
    draw = np.random.default_rng(3)
    rows = [("P", "T", 0.8, 1, m, i, "test", float(i % 7), float(i % 7 + draw.normal(0, 2))) for m in "abc" for i in range(50)]
    frame = spark.createDataFrame(rows, KEYS)
    each = [r.mse for r in metrics.metrics(frame).collect()]
    assert metrics.metrics(metrics.ensemble(frame, ["population", "phenotype", "ratio", "sample", "id"])).first().mse <= np.mean(each)


def test_effects(spark):
    kind = "s string, model string, marker string, effect double"
    frame = spark.createDataFrame([("a", "x", "m1", -3.0), ("a", "x", "m2", 1.0), ("a", "y", "m1", 2.0), ("b", "z", "m1", 0.0)], kind)
    normal = {(r.s, r.model, r.marker): r.effect for r in metrics.normalise_effects(frame, ["s", "model"]).collect()}
    assert normal == {("a", "x", "m1"): 0.75, ("a", "x", "m2"): 0.25, ("a", "y", "m1"): 1.0, ("b", "z", "m1"): None}
    both = {(r.s, r.marker): r.effect for r in metrics.ensemble_effect(frame, ["s"]).collect()}
    assert both == {("a", "m1"): 0.875, ("a", "m2"): 0.125, ("b", "m1"): None}
    assert metrics.ensemble_effect(frame.limit(0), ["s"]).count() == 0


def test_band_levels_follow_the_values(spark):
    draw = np.random.default_rng(4)
    values = np.concatenate([np.zeros(40), draw.random(60)])
    frame = spark.createDataFrame([("g", f"m{i}", float(v)) for i, v in enumerate(values)] + [("same", f"m{i}", 1.0) for i in range(5)], "g string, marker string, effect double")
    got = bands.band_levels(frame, ["g"]).collect()
    q = np.quantile(values, bands.DECILES)
    assert all(r.level == (10 if r.g == "same" else 1 + (r.effect >= q).sum()) for r in got)


def test_links_need_both_places(spark):
    pairs = spark.createDataFrame([("p", "a", "b", 3.0), ("p", "a", "zz", 9.0), ("p", "factor", "a", 50.0), ("p", "a", "c", 1.0)], "population string, from string, to string, value double")
    places = spark.createDataFrame([("a", 1, 10, 15, 21), ("b", 2, 5, 7, 9), ("c", 1, 3, 4, 5)], "name string, chromosome int, start long, middle long, end long")
    kept = bands.top_interactions(bands.mean_interactions(pairs, ["population"]), ["population"], 0.5)
    assert sum(r.value for r in kept.collect()) == pytest.approx(1)
    got = bands.links(bands.mean_interactions(pairs, ["population"]), places, pad=7).collect()
    assert {(r["from"], r.to, r.colour, r.start_from, r.end_from, r.start_to) for r in got} == {("a", "b", "blue", 3, 28, 0), ("a", "c", "red", 3, 28, 0)}


@pytest.mark.parametrize("width", [7, 1000])
def test_overlaps_against_brute_force(spark, width):
    draw = np.random.default_rng(5)
    make = lambda n: [(k, f"chr{draw.integers(1, 3)}", int(s := draw.integers(0, 300)), int(s + draw.integers(0, 40))) for k in range(n)]
    a, b = make(60), make(50)
    schema = "key long, chromosome string, start long, end long"
    left = spark.createDataFrame([*a, (100, "chr1", None, 5), (101, "chr9", 1, 2)], schema)
    right = spark.createDataFrame([*b, (200, "chr1", 9, None)], schema)
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2]}
    got = [(r.key, r.known_key) for r in regions.overlaps(left, right, width).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.key for r in regions.novel(left, right, ["key"], width).collect()} == {x[0] for x in a} - {w[0] for w in want} | {100, 101}
    bounds = spark.createDataFrame([("chr1", 0, 100), ("chr2", 0, 500)], "chromosome string, start long, end long")
    assert {r.key for r in regions.out_of_bounds(left, bounds).collect()} == {x[0] for x in a if x[1] == "chr1" and x[3] > 100} | {100, 101}


def test_gram_and_ridge(spark, monkeypatch):
    monkeypatch.setattr(matrices, "HELD_CELLS", 10)
    rows, x, y = scenario_rows(spark)
    train = [r.id for r in rows.where("fold = 'train'").collect()]
    fits = linear.fit(linear.sufficient_statistics(rows.repartition(3)), "rrBLUP", penalty=2.0).orderBy("pos").collect()
    a, b = x[train] - x[train].mean(0), y[train] - y[train].mean()
    want = np.linalg.solve(a.T @ a + 2 * np.eye(6), a.T @ b)
    assert np.allclose([r.effect for r in fits], want)
    told = {r.id: r.predicted for r in linear.predict(rows, linear.fit(linear.sufficient_statistics(rows), "rrBLUP", penalty=2.0)).collect()}
    assert len(told) == 40 and all(told[i] == pytest.approx(y[train].mean() + (x[i] - x[train].mean(0)) @ want) for i in told)


def test_chosen_penalty_maximises_the_restricted_likelihood(spark):
    rows, x, y = scenario_rows(spark)
    train = [r.id for r in rows.where("fold = 'train'").collect()]
    lam = linear.fit(linear.sufficient_statistics(rows), "rrBLUP").first().penalty
    n = len(train)
    a, b = x[train] - x[train].mean(0), y[train] - y[train].mean()

    def loss(lam):  # through the covariance I + XX'/lam itself
        v = np.eye(n) + a @ a.T / lam
        return (n - 1) * np.log(b @ np.linalg.solve(v, b) / (n - 1)) + np.linalg.slogdet(v)[1]

    assert loss(lam) <= min(loss(lam * f) for f in (0.5, 0.9, 1.1, 2)) + 1e-9


def test_spike_slab_finds_the_large_effects(spark):
    geno, x = genotypes(spark, 200, 12, seed=9)
    y = 5 * x[:, 3] + np.random.default_rng(1).normal(0, 1, 200)
    rows = matrices.vectors(geno).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double"), "id").withColumn("scenario_id", F.lit("s")).withColumn("fold", F.lit("train"))
    got = linear.fit(linear.sufficient_statistics(rows), "BayesB", linear.spike_slab_solution).orderBy("pos").collect()
    assert got[3].inclusion > 0.99 and got[3].effect == pytest.approx(5, abs=0.3) and max(r.inclusion for k, r in enumerate(got) if k != 3) < 0.7


def test_constant_marker_and_kernel(spark):
    geno, x = genotypes(spark, 12, 3)
    geno = geno.withColumn("dosage", F.when(F.col("pos") == 1, 2).otherwise(F.col("dosage")))
    z = {(r.id, r.pos): r.z for r in matrices.standardise(geno, ["population"]).collect()}
    assert z[(0, 1)] == -1.0
    assert z[(4, 0)] == pytest.approx((x[4, 0] - x[:, 0].mean()) / x[:, 0].std(ddof=1) / math.sqrt(3))
    one = matrices.gaussian_kernel(matrices.distances(geno.where("id = 0"), ["population"]), ["population"]).collect()
    assert [r.k for r in one] == [1.0]


def test_random_features_approach_the_kernel(spark):
    rows, x, _ = scenario_rows(spark, n=10)
    got = {r.id: np.array(r.f) for r in rows.select("id", kernel.random_features("x", 6, 4000, 0.1).alias("f")).collect()}
    for i, j in itertools.combinations(range(6), 2):
        assert got[i] @ got[j] == pytest.approx(np.exp(-0.1 * ((x[i] - x[j]) ** 2).sum()), abs=0.08)


def test_svr_reaches_the_least_objective(spark):
    rows, x, y = scenario_rows(spark, n=60)
    train = rows.where("fold = 'train'").withColumn("scenario_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    maps = {"a": gradient.plain, "b": kernel.RandomFeatures(6, 40, 0.1)}
    for name, width in (("a", 6), ("b", 40)):
        model = gradient.fit_svr(train.where(F.col("scenario_id") == name), maps, width)[name]
        ids = [r.id for r in train.select("id").distinct().collect()]
        f, t = maps[name](x[ids]), y[ids]

        def objective(w, b):
            return 0.5 * w @ w + np.maximum(np.abs(f @ w + b - t) - 0.5, 0).sum()

        least = objective(model.weights, model.bias)
        draw = np.random.default_rng(2)
        for size in (1e-3, 1e-2, 0.1):
            for _ in range(20):  # the rounded corner costs SOFT / 2 a row at most
                assert objective(model.weights + draw.normal(0, size, width), model.bias + draw.normal(0, size)) > least - gradient.SOFT / 2 * len(t)
        assert model.slope < 1e-3
    both = gradient.fit_svr(train.where("scenario_id = 'a'").unionByName(rows.where("id < 0")), {"a": maps["a"]}, 6)
    assert set(both) == {"a"} and gradient.fit_svr(train.limit(0), maps, 6) == {}
    told = gradient.predict(train, both).groupBy("scenario_id").agg(F.count("predicted").alias("n")).collect()
    assert {r.scenario_id: r.n for r in told} == {"a": 45, "b": 0}


@pytest.mark.parametrize("bucket", [4096, 20])
def test_network_learns_in_batches(spark, monkeypatch, bucket):
    monkeypatch.setattr(gradient, "BUCKET_ROWS", bucket)
    rows, x, y = scenario_rows(spark, n=60)
    train = rows.where("fold = 'train'")
    name = rows.first().scenario_id
    few = gradient.fit_network(train, 6, hidden=6, epochs=1, rate=0.05)[name]
    net = gradient.fit_network(train, 6, hidden=6, epochs=15, rate=0.05)[name]
    ids = [r.id for r in train.collect()]
    error = lambda n: ((n.forward(x[ids]) - y[ids]) ** 2).mean()
    assert error(net) < 0.5 * error(few) and error(net) < 0.5 * y[ids].var()
    again = gradient.fit_network(train.repartition(5), 6, hidden=6, epochs=15, rate=0.05)[name]
    assert np.allclose(again.w1, net.w1, atol=1e-6)
    loose = gradient.fit_network(train, 6, hidden=6, dropout=0.5, epochs=15, rate=0.05)[name]
    assert error(loose) > error(net)
    told = {r.id: r.p for r in rows.select("id", net.scorer("x").alias("p")).collect()}
    assert all(told[i] == pytest.approx(net.forward(x[i : i + 1])[0]) for i in told)
    assert gradient.fit_network(train.limit(0), 6) == {}


def test_network_slope_is_that_of_the_error():
    draw = np.random.default_rng(3)
    flat, x, y = draw.normal(0, 1, 5 * 4 + 4 + 4 + 1), draw.normal(0, 1, (7, 5)), draw.normal(0, 1, 7)
    error = lambda w: ((gradient.Network.unpack(w, 5, 4).forward(x) - y) ** 2).mean()
    got = gradient._slope(flat, x, y, 4, 1.0)
    for k in range(len(flat)):
        step = np.eye(len(flat))[k] * 1e-6
        assert got[k] == pytest.approx((error(flat + step) - error(flat - step)) / 2e-6, abs=1e-5)


def test_kernel_ridge_approaches_the_exact_kernel_fit(spark):
    rows, x, y = scenario_rows(spark, n=60)
    name = rows.first().scenario_id
    mean = ((x[:, None] - x[None]) ** 2).sum(2).mean()
    model = kernel.fit_kernel_ridge(rows, {name: kernel.RandomFeatures(6, 1500, 1 / mean)})[name]
    train = [r.id for r in rows.where("fold = 'train'").collect()]
    pairs = [(name, int(i), int(j), float(np.exp(-((x[i] - x[j]) ** 2).sum() / mean))) for i in train for j in train if i <= j]
    exact = kernel.kernel_blup(spark.createDataFrame(pairs, "scenario_id string, i long, j long, k double"), rows.where("fold = 'train'").select("scenario_id", "id", "y")).toPandas()
    alpha = dict(zip(exact["id"], exact["alpha"]))
    want = [exact["intercept"].iloc[0] + sum(a * np.exp(-((x[k] - x[i]) ** 2).sum() / mean) for i, a in alpha.items()) for k in range(60)]
    assert np.corrcoef(model.forward(x), want)[0, 1] > 0.98


def test_study_runs_every_model(spark):
    geno, x = genotypes(spark, 48, 5, seed=4)
    geno = geno.unionByName(geno.where("id = 3 AND pos = 0"))  # a repeated cell
    y = x @ np.array([3.0, 0, -2, 0, 1]) + np.random.default_rng(5).normal(0, 0.5, 48)
    pheno = spark.createDataFrame([(i, "P0", "T", None if i == 7 else float(y[i])) for i in range(48)], "id long, population string, phenotype string, y double")
    sizes = scenarios.Sizes(trees=4, depth=3, hidden=6, rate=0.02, epochs=10, features=32, permutations=1, background=2)
    known = dict.fromkeys(("RKHS", "RF", "SVR", "MLP"), 2)
    all_ = ("rrBLUP", "BayesB", "RKHS", "RF", "SVR", "MLP")
    got = study.run(spark, geno, pheno, scenarios.Study(("P0", "none"), ("T",), (0.75,), 1, all_, known, all_, sizes))
    told = got.predictions.groupBy("model").agg(F.count("predicted").alias("n"), F.count("*").alias("all")).collect()
    assert {(r.model, r.n, r["all"]) for r in told} == {(m, 47, 47) for m in (*all_, "ensemble")}
    scores = {r.model: r.pearson for r in got.metrics.collect()}
    assert scores["rrBLUP"] > 0.9 and scores["ensemble"] > 0.8 and scores["RKHS"] > 0.8
    effects = {}
    for r in got.effects.collect():
        effects.setdefault(r.model, {})[r.marker] = abs(r.effect)
    assert set(effects) == {*all_, "ensemble"} and all(len(e) == 5 for e in effects.values())
    assert all(max(effects[m], key=effects[m].get) == "m00" for m in ("rrBLUP", "BayesB", "RF"))
    links = got.interactions.collect()
    assert links and all(r["from"] < r.to and r.value >= 0 and r.model == "RF" for r in links)
    none = study.run(spark, geno, pheno.limit(0), scenarios.Study(("P0",), ("T",), (0.75,), 1, all_, known, all_, sizes))
    assert none.predictions.count() == none.metrics.count() == none.effects.count() == none.interactions.count() == 0


def shapley(f, x, backgrounds):
    p = len(x)
    value = lambda s: np.mean([f(np.where([k in s for k in range(p)], x, z)) for z in backgrounds])
    out = np.zeros(p)
    for k in range(p):
        others = [j for j in range(p) if j != k]
        for size in range(p):
            for s in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                out[k] += weight * (value({*s, k}) - value(set(s)))
    return out


def test_sampled_shapley_of_a_linear_model_is_exact(spark, monkeypatch):
    rows, x, _ = scenario_rows(spark, n=8)
    w = np.array([0.5, -1, 2, 0, 3, -0.25])
    some, back = rows.where("id < 2"), rows.where("id >= 5")
    found = explain.sampled_shapley(some, back, lambda v, key: v @ w + 1, 6, 1, [])
    got = {(r.id, r.pos): r.phi for r in found.collect()}
    want = {i: shapley(lambda v: v @ w + 1, x[i], x[5:8]) for i in (0, 1)}
    assert all(got[(i, k)] == pytest.approx(want[i][k]) for i in want for k in range(6)) and len(got) == 12
    monkeypatch.setattr(explain, "CELLS", 12)  # instances in slices
    again = explain.sampled_shapley(some, back, lambda v, key: v @ w + 1, 6, 1, ["scenario_id"]).collect()
    assert all(r.phi == pytest.approx(got[(r.id, r.pos)]) for r in again) and len(again) == 12
    assert explain.sampled_shapley(some, back.limit(0), lambda v, key: v @ w, 6, 1, []).count() == 0


def test_forest_interactions_against_brute_force(spark):
    rows, x, _ = scenario_rows(spark, n=60, p=5)
    model = forest.fit(rows, 3, depth=3)
    table = forest.nodes(model, spark).cache()
    gains = {r.feature: r.importance for r in forest.importance(table).collect()}
    assert all(gains.get(k, 0) == pytest.approx(v) for k, v in enumerate(model.featureImportances.toArray()))
    trees = {}
    for r in table.collect():
        trees.setdefault(r.tree, {})[r.node] = r

    def expected(tree, node, v, known):
        r = trees[tree][node]
        if r.left < 0:
            return r.value
        if r.feature in known:
            return expected(tree, r.left if v[r.feature] <= r.threshold else r.right, v, known)
        left, right = trees[tree][r.left], trees[tree][r.right]
        return (left.cover * expected(tree, r.left, v, known) + right.cover * expected(tree, r.right, v, known)) / r.cover

    some = [0, 1, 2]
    want = {}
    for i, j in itertools.combinations(range(5), 2):
        total = 0.0
        for row in some:
            index = 0.0
            others = [k for k in range(5) if k not in (i, j)]
            f = lambda s, row=row: sum(expected(t, 0, x[row], s) for t in trees) / len(trees)
            for size in range(4):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(5 - size - 2) / math.factorial(4)
                    index += weight * (f({*s, i, j}) - f({*s, i}) - f({*s, j}) + f(set(s)))
            total += abs(index / 2)
        want[(i, j)] = total
    paths = forest.leaf_paths(table, 3)
    got = {(r.i, r.j): r.value for r in forest.interactions(paths, rows.where(F.col("id").isin(some)), 3, 3).collect()}
    assert all(got.get(k, 0) == pytest.approx(v, abs=1e-9) for k, v in want.items()) and max(want.values()) > 0


def test_attention_keeps_nodes_without_edges(spark):
    edges = spark.createDataFrame([("r", 1, 9, 800.0, 2.0), ("r", 2, 9, 800.0, 4.0), ("q", 1, 9, 0.0, 1.0)], "relation string, src long, dst long, score double, message double")
    skip = spark.createDataFrame([(9, 0.5), (8, 1.5)], "dst long, skip double")
    assert {r.dst: r.h for r in explain.attention_sum(edges, skip).collect()} == {9: pytest.approx(4.5), 8: 1.5}
