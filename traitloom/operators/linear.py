"""Linear marker models from sufficient statistics that Spark sums.

A row is the marker vector with the target and a 1 behind it, so its Gram matrix holds every statistic: the solvers below
get one scenario's matrix, whose size is that of the markers, never of the individuals: some thousand markers a scenario
fit a task (10,000 take 0.8 GB). Wider tables are for ``blocks``; ``ridge`` and ``spike_slab`` choose by shape.

``rows`` hold scenario_id, id, fold, x (array) and y, and whatever else. Rows with a null y, or with a null in or for x, are no
rows of a fit; repeated rows count each; a scenario without usable rows has no fit; empty tables give empty ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions import whole
from traitloom.operators.matrices import gram

#: Markers of the largest matrix that one task solves.
WIDE = 4096
FIT = "scenario_id string, model string, pos int, effect double, inclusion double, intercept double, penalty double, noise double"


def sufficient_statistics(rows: DataFrame) -> DataFrame:
    """(scenario_id, i, j, v) over the usable training rows."""
    train = rows.where((F.col("fold") == "train") & whole("x") & F.col("y").isNotNull())
    return gram(train.select("scenario_id", F.concat("x", F.array(F.col("y"), F.lit(1.0))).alias("x")), "scenario_id")


def centred(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float, int, np.ndarray, float]:
    """X'X, X'y, y'y (all centred), n, the marker means and the mean of y."""
    size = int(cells["j"].max()) + 1
    g = np.zeros((size, size))
    g[cells["i"], cells["j"]] = cells["v"]
    g = np.triu(g) + np.triu(g, 1).T
    n = g[-1, -1]
    mean = g[-1] / n
    c = g - n * np.outer(mean, mean)
    return c[:-2, :-2], c[:-2, -2], float(c[-2, -2]), int(round(n)), mean[:-2], float(mean[-2])


def marginal_penalty(values: np.ndarray, r: np.ndarray, yy: float, n: int) -> tuple[float, float]:
    """Ratio of noise to effect variance of greatest restricted likelihood, and the noise, from eigenvalues: a grid on
    the logarithm and then golden section."""
    keep = values > 1e-9 * max(values.max(initial=0), 1e-300)
    values, r = values[keep], r[keep]

    def noise(lam):
        return max((yy - (r * r / (values + lam)).sum()) / max(n - 1, 1), 1e-12)

    def loss(log):
        lam = np.exp(log)
        return (n - 1) * np.log(noise(lam)) + np.log1p(values / lam).sum()

    grid = np.linspace(np.log(1e-4), np.log(1e6), 121)
    at = int(np.argmin([loss(g) for g in grid]))
    low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    golden = (5**0.5 - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    for _ in range(60):
        if loss(a) < loss(b):
            high, b = b, a
            a = high - golden * (high - low)
        else:
            low, a = a, b
            b = low + golden * (high - low)
    lam = float(np.exp((low + high) / 2))
    return lam, float(noise(lam))


def ridge_solution(cells: pd.DataFrame, penalty: float | None = None) -> pd.DataFrame:
    """Ridge effects of one scenario; the penalty by restricted likelihood if none is given."""
    xx, xy, yy, n, mean, y = centred(cells)
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0)
    r = vectors.T @ xy
    lam, noise = marginal_penalty(values, r, yy, n) if penalty is None else (penalty, np.nan)
    b = vectors @ (r / (values + lam))
    return pd.DataFrame({"pos": np.arange(len(b), dtype=np.int32), "effect": b, "inclusion": 1.0, "intercept": y - mean @ b, "penalty": lam, "noise": noise})


def spike_slab_solution(cells: pd.DataFrame, inclusion: float = 0.1, sweeps: int = 5000, close: float = 1e-10) -> pd.DataFrame:
    """Effects under a spike-and-slab prior by coordinate-wise variational updates, to a fixed point.

    Noise and slab variance come from the ridge fit: the same share of variance is spread over the included markers.
    """
    xx, xy, yy, n, mean, y = centred(cells)
    p = len(xy)
    values, vectors = np.linalg.eigh(xx)
    lam, noise = marginal_penalty(np.maximum(values, 0), vectors.T @ xy, yy, n)
    slab = 1 / (lam * inclusion)  # in units of the noise
    alpha, mu = np.full(p, inclusion), np.zeros(p)
    for _ in range(sweeps):
        worst = 0.0
        for k in range(p):
            alpha_k, mu_k = spike_slab_step(k, alpha, mu, xx, xy, noise, slab, inclusion)
            worst = max(worst, abs(alpha_k * mu_k - alpha[k] * mu[k]), abs(alpha_k - alpha[k]))
            alpha[k], mu[k] = alpha_k, mu_k
        if worst < close:
            break
    b = alpha * mu
    return pd.DataFrame({"pos": np.arange(p, dtype=np.int32), "effect": b, "inclusion": alpha, "intercept": y - mean @ b, "penalty": slab, "noise": noise})


def spike_slab_step(k, alpha, mu, xx, xy, noise, slab, inclusion):
    """One marker's update: its inclusion probability and mean effect given all others."""
    variance = noise / (xx[k, k] + 1 / slab)
    rest = xy[k] - xx[k] @ (alpha * mu) + xx[k, k] * alpha[k] * mu[k]
    mean = variance / noise * rest
    logit = np.log(inclusion / (1 - inclusion)) + 0.5 * np.log(variance / (slab * noise)) + mean * mean / (2 * variance)
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500))), mean


def fit(cells: DataFrame, model: str, solve=ridge_solution, **options) -> DataFrame:
    """Solve every scenario; ``cells`` from ``sufficient_statistics``."""

    def one(key, pdf):
        out = solve(pdf, **options)
        out.insert(0, "scenario_id", key[0])
        out.insert(1, "model", model)
        return out

    return cells.groupBy("scenario_id").applyInPandas(one, FIT)


def wide_scenarios(rows: DataFrame, most: int = WIDE) -> list[str]:
    """Scenarios with more markers than usable training rows, and those of over ``most`` markers."""
    train = rows.where((F.col("fold") == "train") & whole("x") & F.col("y").isNotNull())
    shape = train.groupBy("scenario_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"))
    return [r.scenario_id for r in shape.where((F.col("p") > F.col("n")) | (F.col("p") > most)).collect()]


def _by_shape(rows: DataFrame, model: str, solve, by_blocks, most: int, **sizes) -> DataFrame:
    from traitloom.operators.blocks import Blocks

    wide = wide_scenarios(rows, most)
    tall = fit(sufficient_statistics(rows.where(~F.col("scenario_id").isin(wide))), model, solve)
    return tall.unionByName(by_blocks(Blocks(rows.where(F.col("scenario_id").isin(wide)), **sizes), model)) if wide else tall


def ridge(rows: DataFrame, model: str = "rrBLUP", most: int = WIDE) -> DataFrame:
    """Ridge effects of every scenario: from its Gram matrix, or through the dual where there are more markers than rows."""
    from traitloom.operators import blocks

    return _by_shape(rows, model, ridge_solution, blocks.ridge, most)


def spike_slab(rows: DataFrame, model: str = "BayesB", most: int = WIDE) -> DataFrame:
    """Spike-and-slab effects of every scenario: from its Gram matrix, or by marker blocks."""
    from traitloom.operators import blocks

    return _by_shape(rows, model, spike_slab_solution, blocks.spike_slab, most, cells=blocks.LARGE)


def predict(rows: DataFrame, fits: DataFrame, wide: bool = False) -> DataFrame:
    """Predictions of all rows, both folds; ``rows`` as for ``sufficient_statistics``, with any further columns.

    Effects of a scenario and model are gathered to one array, as wide as the markers. With ``wide`` neither those nor the
    rows are broadcast: the files of long vectors of dosages are so small that Spark takes them for a small table.
    """
    effects = fits.groupBy("scenario_id", "model", "intercept").agg(F.array_sort(F.collect_list(F.struct("pos", "effect"))).alias("_b"))
    dot = F.aggregate(F.zip_with("x", F.col("_b.effect"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(effects.hint("merge") if wide else effects, "scenario_id").withColumn("predicted", dot + F.col("intercept")).drop("_b", "intercept", "x").withColumnRenamed("y", "actual")
