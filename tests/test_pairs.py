"""Pairwise distances and kernels: what they give, and what is moved for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import matrices

GENO = "id long, population string, pos int, marker string, dosage double"


def shuffled(plan):
    """Records of each exchange of a plan that ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(plan.plan())
    kids = plan.children()
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
    return own + [n for k in range(kids.size()) for n in shuffled(kids.apply(k))]


@pytest.mark.parametrize("what", ["distances", "kernel_pairs"])
def test_a_vector_travels_a_few_times(spark, what):
    """3,000 individuals, which were 12 blocks, and no pair is shuffled before the last sum."""
    n = 3_000
    geno = spark.range(n).select("id", F.lit("P").alias("population"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    geno = geno.withColumns({"marker": F.col("pos").cast("string"), "dosage": F.pmod(F.xxhash64("id", "pos"), F.lit(3)).cast("double")})
    told = getattr(matrices, what)(geno, ["population"]).agg(F.count("*").alias("n"), F.count_if(F.col("i") > F.col("j")).alias("wrong"), F.countDistinct("i").alias("i"))
    row = told.collect()[0]
    assert (row.n, row.wrong, row.i) == (n * (n + 1) // 2, 0, n)
    # the distinct ids are dealt by partitions; all else is vectors
    assert max(shuffled(told._jdf.queryExecution().executedPlan())) <= 8 * n


@pytest.mark.parametrize("block,cells,tile", [(256, 1 << 20, 1 << 18), (3, 20, 4), (2, 1 << 20, 1)])
def test_distances_and_kernels_against_brute_force(spark, monkeypatch, block, cells, tile):
    """In blocks and tiles of any size; nulls are left out, alike individuals have a kernel of 1."""
    for name, value in (("BLOCK", block), ("CELLS", cells), ("TILE", tile)):
        monkeypatch.setattr(matrices, name, value)
    draw, x = np.random.default_rng(4), {}
    x = {(g, i): draw.integers(0, 3, 5) / (1 if g == "P" else 3) for g, n in (("P", 23), ("Q", 4)) for i in range(n)} | {("R", i): np.full(5, 0.7) for i in range(30)}
    rows = [(i, g, k, f"m{k}", float(v)) for (g, i), own in x.items() for k, v in enumerate(own)]
    rows += [(90, "P", k, f"m{k}", None if k == 2 else 1.0) for k in range(5)] + [(None, "P", k, f"m{k}", 1.0) for k in range(5)] + [(91, None, k, f"m{k}", 1.0) for k in range(5)]
    geno = spark.createDataFrame(rows, GENO).repartition(7)
    d = {(g, i, j): float(((x[g, i] - x[g, j]) ** 2).sum()) for g, i in x for h, j in x if g == h and i <= j}
    got = {(r.population, r.i, r.j): r.d for r in matrices.distances(geno, ["population"]).collect()}
    assert set(got) == set(d) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in d.items())
    mean = {g: np.mean([((x[a] - x[b]) ** 2).sum() for a in x for b in x if a[0] == b[0] == g]) for g in "PQ"}
    k = {(r.population, r.i, r.j): r.k for r in matrices.kernel_pairs(geno, ["population"], 0.5).collect()}
    assert set(k) == set(d) and all(k[g, i, j] == pytest.approx(1.0 if g == "R" else np.exp(-0.5 * v / mean[g]), abs=1e-9) for (g, i, j), v in d.items())
    assert matrices.kernel_pairs(geno.limit(0), ["population"]).count() == 0
