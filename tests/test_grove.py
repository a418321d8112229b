"""Forests of all scenarios against a brute-force tree, and the node table's uses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import forest, grove

SCHEMA = "scenario_id string, id long, fold string, x array<double>, y double, tree int"


def rows_of(spark, seed=1):
    draw, rows, held = np.random.default_rng(seed), [], {}
    for s, (n, p) in enumerate([(60, 6), (45, 6), (1, 6)]):
        x = draw.integers(0, 3, (n, p)).astype(float)
        x[:, 5] = draw.normal(0, 1, n)  # many values
        y = 2 * x[:, 0] * x[:, 1] - x[:, 2] + np.where(x[:, 5] > 0.3, 3, 0) + draw.normal(0, 0.1, n)
        held[f"s{s}"] = x, y
        rows += [(f"s{s}", i, "train" if i % 4 or n == 1 else "test", x[i].tolist(), float(y[i]), 7) for i in range(n)]
        rows += [(f"s{s}", n, "train", x[0].tolist(), None, 7), (f"s{s}", n + 1, "test", None, 1.0, 7), (f"s{s}", n + 2, "train", [None] * p, 1.0, 7)]
    rows += [("none", 1, "test", [0.0] * 6, 1.0, 7), ("s0", None, "test", [2.0] * 6, 1.0, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), held


def brute(x, y, w, cuts, depth):
    """A nested tuple (feature, threshold, left, right) or a value."""
    mean = (w * y).sum() / w.sum()
    best = (1e-9, None, None)
    for f, limits in enumerate(cuts):
        for c in limits:
            go = x[:, f] <= c
            if w[go].sum() > 0 and w[~go].sum() > 0:
                parts = sum((w[m] * y[m]).sum() ** 2 / w[m].sum() for m in (go, ~go))
                gain = round((parts - (w * y).sum() ** 2 / w.sum()) / w.sum(), 9)
                if gain > best[0]:
                    best = gain, f, c
    if depth == 0 or best[1] is None:
        return mean
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], brute(x[go], y[go], w[go], cuts, depth - 1), brute(x[~go], y[~go], w[~go], cuts, depth - 1)


def told(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("bootstrap,depth,together", [(False, 3, 10**6), (True, 40, 100)])
def test_trees_against_brute_force(spark, monkeypatch, bootstrap, depth, together):
    """Values of every tree, with trees in one batch or several, shallow and as deep as they go."""
    monkeypatch.setattr(grove, "OPEN", together)
    rows, held = rows_of(spark)
    nodes = grove.grow(rows, 3, depth, bootstrap=bootstrap, seed=5)
    assert {(r.scenario_id, r.tree) for r in nodes.select("scenario_id", "tree").distinct().collect()} == {(f"s{s}", t) for s in range(3) for t in range(3)}
    usable = rows.where("fold = 'train' AND y IS NOT NULL AND x[0] IS NOT NULL")
    cuts = grove.thresholds(usable)
    hashes = {(r.scenario_id, r.id): r.h for r in usable.select("scenario_id", "id", F.xxhash64("scenario_id", "id").alias("h")).collect()}
    got = {(r.scenario_id, r.id): r.predicted for r in grove.predict(rows, nodes).collect()}
    for name, (x, y) in held.items():
        train = [i for i in range(len(y)) if (name, i) in hashes]
        h = np.array([hashes[name, i] for i in train], np.int64)
        trees = [brute(x[train], y[train], grove.drawn(h, t, 5) if bootstrap else np.ones(len(h)), cuts, depth) if not bootstrap or grove.drawn(h, t, 5).sum() else 0.0 for t in range(3)]
        if name == "s2" and bootstrap:
            continue  # a single row that a sample may lack
        for i in range(len(y)):
            assert abs(got[name, i] - np.mean([told(t, x[i]) for t in trees])) < 1e-6
    assert got["none", 1] is None and got["s0", None] is not None and got["s0", 61] is None


def test_node_table_serves_the_other_operators(spark):
    rows, held = rows_of(spark)
    nodes = grove.grow(rows.where("scenario_id <> 's2'"), 8, 4)
    shares = forest.importance(nodes, ("scenario_id",)).groupBy("scenario_id").agg(F.sum("importance").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in shares.collect())
    inner = nodes.where("left >= 0").alias("n").join(nodes.alias("c"), F.expr("n.scenario_id = c.scenario_id AND n.tree = c.tree AND c.node IN (n.left, n.right)"))
    assert inner.groupBy("n.scenario_id", "n.tree", "n.node").agg((F.sum("c.cover") - F.max("n.cover")).alias("d")).where("abs(d) > 1e-9").count() == 0
    pairs = forest.interactions(forest.leaf_paths(nodes, 4, ("scenario_id",)), rows.where("fold = 'test' AND x[0] IS NOT NULL AND scenario_id IN ('s0', 's1')"), 8, 4, ("scenario_id",))
    top = {r.scenario_id: (r.i, r.j) for r in pairs.groupBy("scenario_id").agg(F.max_by(F.struct("i", "j"), "value").alias("p")).select("scenario_id", "p.*").collect()}
    assert top["s0"] == (0, 1)
    fitted = grove.predict(rows, nodes).where("fold = 'train' AND y IS NOT NULL AND scenario_id = 's0'")
    assert fitted.agg(F.corr("predicted", "y")).first()[0] > 0.9


def test_shares_of_markers_and_empty_tables(spark):
    rows, _ = rows_of(spark)
    few = grove.grow(rows, 5, 3, share=0.3)
    assert few.where("node = 0 AND left >= 0").select("feature").distinct().count() > 1
    assert grove.grow(rows.limit(0), 2).count() == 0
    assert grove.predict(rows.limit(0), few).count() == 0


def test_few_rows_have_all_their_trees(spark):
    """A bootstrap sample of one row or two may draw none; the tree is grown all the same."""
    rows = spark.createDataFrame([("one", 1, "train", [1.0], 4.0, 0), ("two", 1, "train", [0.0], 1.0, 0), ("two", 2, "train", [1.0], 3.0, 0)], SCHEMA)
    nodes = grove.grow(rows, 12, 3)
    assert nodes.where("node = 0 AND cover > 0").groupBy("scenario_id").count().orderBy("scenario_id").collect() == [("one", 12), ("two", 12)]
    assert {r.value for r in nodes.where("scenario_id = 'one'").collect()} == {4.0}
    empty = {t for t in range(12) if not any(grove.drawn(np.array([r.h]), t, 1).sum() for r in rows.where("scenario_id = 'two'").select(F.xxhash64("scenario_id", "id").alias("h")).collect())}
    roots = {r.tree: (r.cover, r.value) for r in nodes.where("scenario_id = 'two' AND node = 0").collect()}
    assert all(roots[t] == (2.0, 2.0) for t in empty)
