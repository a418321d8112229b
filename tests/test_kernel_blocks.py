"""The exact kernel regression in blocks against the one-task solver."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom import queries
from traitloom.operators import kernel


def rows_of(spark, sizes, p=8, seed=1):
    draw, rows = np.random.default_rng(seed), []
    for s, n in enumerate(sizes):
        x = draw.integers(0, 3, (n, p)).astype(float)
        y = np.sin(x[:, 0]) * x[:, 1] + x[:, 2] + draw.normal(0, 0.2, n)
        rows += [(f"s{s}", i, "train" if i % 4 else "test", x[i].tolist(), float(y[i]), 1) for i in range(n)]
        rows += [(f"s{s}", n, "train", x[0].tolist(), None, 1), (f"s{s}", n + 1, "test", None, 1.0, 1), (f"s{s}", n + 2, "test", [None] * p, 1.0, 1)]
    return spark.createDataFrame(rows, "scenario_id string, id long, fold string, x array<double>, y double, block int").repartition(6)


@pytest.mark.parametrize("individuals", [7, 1000])
def test_blocks_solve_the_same_system(spark, monkeypatch, individuals):
    monkeypatch.setattr(kernel, "INDIVIDUALS", individuals)
    rows, gammas = rows_of(spark, [50, 33]), {"s0": 0.1, "s1": 0.3}
    fits = kernel.blup_in_blocks(rows, gammas, {"s0": 0.5, "s1": 2.0}).toPandas()
    told = kernel.blup_predict(rows, kernel.blup_in_blocks(rows, gammas, {"s0": 0.5, "s1": 2.0}), gammas).toPandas()
    for name, lam in (("s0", 0.5), ("s1", 2.0)):
        all_ = rows.where((F.col("scenario_id") == name) & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())).toPandas().sort_values("id")
        mine = all_[(all_["fold"] == "train") & all_["y"].notna()]
        x, y = np.stack(mine["x"]), mine["y"].to_numpy()
        k = lambda a, b: np.exp(-gammas[name] * ((a[:, None] - b[None]) ** 2).sum(2))
        alpha = np.linalg.solve(k(x, x) + lam * np.eye(len(y)), y - y.mean())
        got = fits[fits["scenario_id"] == name].sort_values("id")
        assert got["id"].tolist() == mine["id"].tolist()
        np.testing.assert_allclose(got["alpha"], alpha, atol=1e-7)
        expected = dict(zip(all_["id"], k(np.stack(all_["x"]), x) @ alpha + y.mean()))
        here = told[told["scenario_id"] == name]
        assert set(here["id"]) == set(expected)
        np.testing.assert_allclose(here["predicted"], [expected[i] for i in here["id"]], atol=1e-7)


def test_penalty_of_its_own(spark, monkeypatch):
    """Without given penalties: the system holds, and the fit follows the targets."""
    monkeypatch.setattr(kernel, "INDIVIDUALS", 20)
    rows, gammas = rows_of(spark, [120]), {"s0": 0.1}
    fits = kernel.blup_in_blocks(rows, gammas)
    told = kernel.blup_predict(rows, fits, gammas).join(rows.where("fold = 'test' AND y IS NOT NULL").select("id", "y"), "id")
    assert told.agg(F.corr("predicted", "y")).first()[0] > 0.9
    assert kernel.blup_in_blocks(rows.limit(0), gammas).count() == kernel.blup_predict(rows.limit(0), fits, gammas).count() == 0


def test_pairs_of_blocks_are_bounded(spark):
    """No pair of blocks holds more than its share, and together they are the whole kernel."""
    n, p = 3_000, 16
    x = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: F.pmod(F.xxhash64(k, F.col("id")), F.lit(3)).cast("double"))
    rows = spark.range(n).select(F.lit("s").alias("scenario_id"), "id", F.lit("train").alias("fold"), x.alias("x")).withColumn("y", F.get("x", F.lit(0)) * F.get("x", F.lit(1)))
    pairs = kernel.kernel_blocks(rows, {"s": 0.05}, {"s": n})
    told = pairs.agg(F.max(F.length("k")).alias("most"), F.sum(F.when(F.col("a") < F.col("b"), 2).otherwise(1) * F.length("k")).alias("all")).first()
    assert told.all == 8 * n * n and told.most < 8 * (1.5 * kernel.INDIVIDUALS) ** 2


def solved(fits):
    return {k: p.sort_values("id")["alpha"].to_numpy() for k, p in fits.toPandas().groupby("scenario_id")}


def test_written_kernel_and_vectors_agree(spark, monkeypatch):
    """Few markers: pairs of vectors, whose kernel each pass computes; many: pairs of kernels. Constant, equal, fractional and
    negative markers, and more markers than individuals."""
    rows = rows_of(spark, [60, 5]).withColumn("x", F.concat("x", F.array(F.lit(1.0), F.lit(1.0)), F.transform(F.slice("x", 1, 2), lambda v: v / 3 - 200)))
    rows = rows.withColumn("x", F.when(F.size("x") == 12, F.col("x")))
    gammas, penalties, found = {"s0": 0.1, "s1": 0.3}, {"s0": 1e-3, "s1": 2.0}, []
    for individuals in (4, 9, 1000):
        monkeypatch.setattr(kernel, "INDIVIDUALS", individuals)
        found.append(solved(kernel.blup_in_blocks(rows, gammas, penalties)))
    for name, lam in penalties.items():
        mine = rows.where((F.col("scenario_id") == name) & (F.col("fold") == "train") & F.col("y").isNotNull()).toPandas().sort_values("id")
        x, y = np.stack(mine["x"]), mine["y"].to_numpy()
        k = np.exp(-gammas[name] * ((x[:, None] - x[None]) ** 2).sum(2))
        for got in found:
            np.testing.assert_allclose(k @ got[name] + lam * got[name], y - y.mean(), atol=1e-7)


def test_no_kernel_is_written_of_narrow_vectors(spark, monkeypatch, tmp_path):
    """3,000 individuals: half of their kernel is 36 MB."""
    n, sizes, write = 3_000, {}, kernel.materialise

    def counted(df, name):
        out = write(df, name)
        sizes[name] = sum(f.stat().st_size for f in Path(out._traitloom_path.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(kernel, "materialise", counted)
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pmod(F.xxhash64(k, F.col("id")), F.lit(3)).cast("double"))
    rows = spark.range(n).select(F.lit("s").alias("scenario_id"), "id", F.lit("train").alias("fold"), x.alias("x")).withColumn("y", F.get("x", F.lit(0)) * F.get("x", F.lit(1)))
    weights = kernel.blup_in_blocks(rows, {"s": 0.05}, {"s": 1.0})
    told = kernel.blup_predict(rows, weights, {"s": 0.05}).join(weights, "id").join(rows, "id")
    assert told.agg(F.max(F.abs(F.col("predicted") + F.col("alpha") - F.col("y")))).first()[0] < 1e-6
    assert sizes and sum(sizes.values()) < 2e6


def test_each_scenario_is_solved_by_its_size(spark, monkeypatch):
    """The small one with the penalty of greatest restricted likelihood, as from its table of pairs; the large one by blocks."""
    monkeypatch.setattr(kernel, "INDIVIDUALS", 7)
    monkeypatch.setattr(kernel, "ONE_TASK", 30)
    rows, gammas = rows_of(spark, [50, 33]), {"s0": 0.1, "s1": 0.3}
    fits = kernel.blup(rows, gammas).toPandas()
    assert set(fits["scenario_id"]) == {"s0", "s1"}
    for name, part in fits.groupby("scenario_id"):
        mine = rows.where((F.col("scenario_id") == name) & (F.col("fold") == "train") & F.col("y").isNotNull()).toPandas().sort_values("id")
        x, y = np.stack(mine["x"]), mine["y"].to_numpy()
        k = np.exp(-gammas[name] * ((x[:, None] - x[None]) ** 2).sum(2))
        part = part.sort_values("id")
        np.testing.assert_allclose(k @ part["alpha"] + part["penalty"] * part["alpha"], y - y.mean(), atol=1e-7)
        if name == "s1":
            ids = mine["id"].tolist()
            pairs = [(name, a, b, float(k[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids) if a <= b]
            train = spark.createDataFrame([(name, i, float(v)) for i, v in zip(ids, y)], "scenario_id string, id long, y double")
            exact = kernel.kernel_blup(spark.createDataFrame(pairs, "scenario_id string, i long, j long, k double"), train).toPandas().sort_values("id")
            np.testing.assert_allclose(part[["alpha", "penalty"]], exact[["alpha", "penalty"]], rtol=1e-4)
    assert kernel.blup(rows.limit(0), gammas).count() == 0


@pytest.mark.parametrize("name", ["kernel_blup_certificate", "kernel_blup_blocks_certificate"])
def test_certificates_write_no_pairs(spark, monkeypatch, name):
    """No written table has more rows than the split."""
    counts, write = {}, kernel.materialise

    def counted(df, table):
        out = write(df, table)
        counts[table] = out.count()
        return out

    for module in (kernel, queries):
        monkeypatch.setattr(module, "materialise", counted)
    assert {r.ok for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == {True}
    assert counts and max(counts.values()) <= queries._split(spark, "/root/testdata/sf0.001", queries.FITTED).count()
