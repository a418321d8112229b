"""Models fitted by passes that Spark sums, all scenarios at once: support vector regression and a small neural network.

``rows`` hold scenario_id, x (array) and y, and whatever else; rows with a null y, or with a null in or for x, are no rows of a
fit, repeated rows count each; a null in or for x is scored null. A fit is a dictionary of models by scenario; a scenario
without rows has none. Models score in Arrow batches, so their weights never enter a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions import hashed_order, stacked, whole


def scorer(forward: Callable[[np.ndarray], np.ndarray]) -> Callable[[str], Column]:
    """A model's forward pass over an array column; null where the array is not whole."""

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        there, x = stacked(rows)
        out = np.full(len(rows), np.nan)
        if there.any():
            out[there] = forward(x)
        return pd.Series(out)

    return lambda x: F.nanvl(scored(x), F.lit(None).cast("double"))


def predict(rows: DataFrame, models: dict, x: str = "x") -> DataFrame:
    """``rows`` with ``predicted`` from their scenario's model; null where a scenario has none."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def scored(scenario: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.full(len(scenario), np.nan)
        for name in scenario.unique():
            if name in held.value:
                here = np.flatnonzero(scenario == name)
                there, x_ = stacked(vectors.iloc[here])
                if there.any():
                    out[here[there]] = held.value[name].forward(x_)
        return pd.Series(out)

    return rows.withColumn("predicted", F.nanvl(scored("scenario_id", x), F.lit(None).cast("double")))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(whole("x") & F.col("y").isNotNull()).select("scenario_id", "x", "y")


def _summed(rows: DataFrame, measure: Callable, states: dict) -> dict[str, np.ndarray]:
    """Sum of ``measure(state, x, y)``, a vector, over each scenario's rows. Tasks send one vector a scenario, which Spark
    adds up before the driver sees them."""
    held = rows.sparkSession.sparkContext.broadcast(states)

    def partial(batches):
        total: dict = {}
        for pdf in batches:
            for name, part in pdf.groupby("scenario_id", sort=False):
                if name in held.value:
                    total[name] = total.get(name, 0) + measure(held.value[name], np.stack(part["x"].to_numpy()), part["y"].to_numpy())
        for name, v in total.items():
            yield pd.DataFrame({"scenario_id": name, "k": np.arange(len(v), dtype=np.int32), "v": v})

    cells = rows.mapInPandas(partial, "scenario_id string, k int, v double").groupBy("scenario_id", "k").agg(F.sum("v").alias("v")).toPandas()
    held.unpersist()
    return {name: part.sort_values("k")["v"].to_numpy() for name, part in cells.groupby("scenario_id")}


# ---------------------------------------------------------------- support vector regression


def plain(x: np.ndarray) -> np.ndarray:
    """Vectors as their own features."""
    return x


@dataclass
class SupportVector:
    """w . features(x) + bias"""

    weights: np.ndarray
    bias: float
    features: Callable[[np.ndarray], np.ndarray] = plain
    objective: float = np.nan
    slope: float = np.nan

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights + self.bias


#: Width of the parabola that rounds the loss off at the tube's edge; fits begin with the targets' spread and narrow it by
#: this factor a pass.
SOFT, NARROW = 0.05, 0.4


def _tube(gap: np.ndarray, epsilon: float, soft: float = SOFT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of the rounded epsilon-insensitive loss."""
    over = np.abs(gap) - epsilon
    bent = (over > 0) & (over < soft)
    loss = np.where(over <= 0, 0, np.where(bent, over * over / (2 * soft), over - soft / 2))
    slope = np.sign(gap) * np.where(over <= 0, 0, np.where(bent, over / soft, 1.0))
    return loss, slope, bent / soft


def svr_passes(rows: DataFrame, models: dict, epsilon: float, cost: float, soft: dict | None = None) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Objective, gradient and curvature at each scenario's model, from one pass."""

    def measure(held, x, y):
        model, width = held
        f = np.column_stack([model.features(x), np.ones(len(x))])
        loss, slope, bent = _tube(f[:, :-1] @ model.weights + model.bias - y, epsilon, width)
        return np.concatenate([[loss.sum()], slope @ f, (f.T @ (f * bent[:, None])).ravel()])

    out = {}
    for name, v in _summed(_usable(rows), measure, {k: (m, (soft or {}).get(k, SOFT)) for k, m in models.items()}).items():
        w = np.append(models[name].weights, 0.0)
        size = len(w)
        own = np.diag(np.append(np.ones(size - 1), 1e-8))
        out[name] = (0.5 * float(w @ w) + cost * v[0], w + cost * v[1 : 1 + size], own + cost * v[1 + size :].reshape(size, size))
    return out


def fit_svr(rows: DataFrame, features: dict[str, Callable], width: int, epsilon: float = 0.5, cost: float = 1.0, passes: int = 60, close: float = 1e-5) -> dict[str, SupportVector]:
    """Epsilon-insensitive regression with an L2 penalty by Newton steps on the rounded loss.

    ``features`` maps each scenario's x to ``width`` features: random features for a Gaussian kernel, or ``plain``. A pass
    sums width^2 numbers a scenario. Each step is the best of a few lengths; a scenario is done when its gradient is
    ``close`` to 0 at the narrowest rounding, or no step lowers its objective there.
    """
    starts = {r.scenario_id: (r.y, r.s) for r in _usable(rows).groupBy("scenario_id").agg(F.avg("y").alias("y"), F.stddev_pop("y").alias("s")).collect()}
    models = {k: SupportVector(np.zeros(width), float(y), features[k]) for k, (y, _) in starts.items()}
    open_, tries = set(models), [1.0, 0.5, 0.25, 0.1, 0.02, 0.002]
    for turn in range(passes):
        soft = {k: max(SOFT, 4 * starts[k][1] * NARROW**turn) for k in open_}
        here = svr_passes(rows, {k: models[k] for k in open_}, epsilon, cost, soft)
        for name, (value, slope, _) in here.items():
            models[name].objective, models[name].slope = value, float(np.linalg.norm(slope))
        steps = {k: np.linalg.solve(h, g) for k, (_, g, h) in here.items() if soft[k] > SOFT or np.linalg.norm(g) > close}
        if not steps:
            break

        def losses(held, x, y):
            model, step, width_ = held
            f = np.column_stack([model.features(x), np.ones(len(x))])
            at, turned = f[:, :-1] @ model.weights + model.bias - y, f @ step
            return np.array([_tube(at - t * turned, epsilon, width_)[0].sum() for t in tries])

        found = _summed(_usable(rows), losses, {k: (models[k], s, soft[k]) for k, s in steps.items()})
        open_ = set()
        for name, loss in found.items():
            w, step = np.append(models[name].weights, models[name].bias), steps[name]
            values = [0.5 * float((w - t * step)[:-1] @ (w - t * step)[:-1]) + cost * v for t, v in zip(tries, loss)]
            best = int(np.argmin(values))
            lower = values[best] < models[name].objective
            if lower:
                w = w - tries[best] * step
                models[name] = SupportVector(w[:-1], float(w[-1]), features[name], values[best], models[name].slope)
            if lower or soft[name] > SOFT:
                open_.add(name)
        if not open_:
            break
    return models


# ---------------------------------------------------------------- neural network


@dataclass
class Network:
    """y = b2 + w2 . relu(w1 x + b1)"""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def unpack(cls, flat: np.ndarray, width: int, hidden: int) -> Network:
        a = width * hidden
        return cls(flat[:a].reshape(hidden, width), flat[a : a + hidden], flat[a + hidden : a + 2 * hidden], float(flat[-1]))

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1.T + self.b1, 0) @ self.w2 + self.b2

    def scorer(self, x: str = "x") -> Column:
        return scorer(self.forward)(x)


#: Rows of a bucket, on average. A bucket's rows are one task's, in batches; several buckets' networks are averaged after
#: each epoch.
BUCKET_ROWS = 4096


def _slope(flat: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, kept: np.ndarray | float) -> np.ndarray:
    """Gradient of the mean squared error; ``kept`` scales the hidden units that dropout leaves."""
    net = Network.unpack(flat, x.shape[1], hidden)
    inner = (x @ net.w1.T + net.b1) * kept
    active = np.maximum(inner, 0)
    gap = active @ net.w2 + net.b2 - y
    back = np.outer(gap, net.w2) * (inner > 0) * kept
    return 2 / len(y) * np.concatenate([(back.T @ x).ravel(), back.sum(0), gap @ active, [gap.sum()]])


def fit_network(rows: DataFrame, width: int, hidden: int = 30, dropout: float = 0.0, rate: float = 1e-3, decay: float = 5e-4, epochs: int = 30, batch: int = 8, seed: int = 1) -> dict[str, Network]:
    """One hidden layer by Adam on mini-batches, a new order of a scenario's rows each epoch.

    Scenarios are dealt to hash buckets of about ``BUCKET_ROWS``. One bucket runs all its epochs in one job; several start
    each epoch from their mean, weighted by their rows. ``rows`` also hold id; rows order by a hash of id and epoch.
    """
    rows = rows.where(whole("x") & F.col("y").isNotNull()).select("scenario_id", "id", "x", "y")
    sizes = {r.scenario_id: (r.n, r.y) for r in rows.groupBy("scenario_id").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect()}
    if not sizes:
        return {}
    draw = np.random.default_rng(seed)
    edge, inner = 1 / np.sqrt(width), 1 / np.sqrt(hidden)
    start = np.concatenate([draw.uniform(-edge, edge, width * hidden), draw.uniform(-edge, edge, hidden), draw.uniform(-inner, inner, hidden)])
    buckets = max(1, -(-max(n for n, _ in sizes.values()) // BUCKET_ROWS))
    alone = buckets == 1
    zero = np.zeros(len(start) + 1)
    states = {k: np.concatenate([start, [mean], zero, zero]) for k, (_, mean) in sizes.items()}
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    for epoch in range(1 if alone else epochs):
        held = rows.sparkSession.sparkContext.broadcast(states)
        turns = range(epochs) if alone else range(epoch, epoch + 1)

        def learn(key, pdf):
            flat, m, v = np.split(held.value[key[0]].copy(), 3)
            x, y = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["y"].to_numpy()
            luck = np.random.default_rng([seed, key[1]])
            batches = -(-len(y) // batch)
            for turn in turns:
                order = np.argsort(pdf[f"o{turn - turns[0]}"].to_numpy(), kind="stable")
                for k in range(batches):
                    at = order[k * batch : (k + 1) * batch]
                    kept = (luck.random((len(at), hidden)) >= dropout) / (1 - dropout) if dropout else 1.0
                    g = _slope(flat, x[at], y[at], hidden, kept) + decay * flat
                    step = turn * batches + k + 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            state = np.concatenate([flat, m, v])
            return pd.DataFrame({"scenario_id": key[0], "k": np.arange(len(state), dtype=np.int32), "v": state * len(y), "n": float(len(y))})

        orders = [hashed_order("id", F.lit(turn)).alias(f"o{n}") for n, turn in enumerate(turns)]
        told = bucketed.select("*", *orders).groupBy("scenario_id", "bucket").applyInPandas(learn, "scenario_id string, k int, v double, n double")
        mean = told.groupBy("scenario_id", "k").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        states = {name: part.sort_values("k")["v"].to_numpy() for name, part in mean.groupby("scenario_id")}
        held.unpersist()
    return {k: Network.unpack(np.split(v, 3)[0], width, hidden) for k, v in states.items()}
