"""Linear marker models of wide tables: a scenario's markers are held in blocks, never its marker-by-marker matrix.

A block is the centred n x width matrix of one scenario and ``width`` consecutive markers, some ``CELLS`` numbers, one row of
a written table. Everything a fit needs crosses between blocks as vectors over individuals: the summed outer products of
the ridge's dual form, or the residual that the blocks of the spike-and-slab fit take turns in explaining. So this is for
scenarios of some thousand individuals and any number of markers; for the other shape use ``linear``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions import whole
from traitloom.operators.linear import FIT, marginal_penalty
from traitloom.session import forget, materialise

#: Numbers of a block, in general and for the spike-and-slab fit (fewer blocks agree sooner); tasks that sum a scenario's outer
#: products.
CELLS, LARGE, SUMMERS = 1 << 17, 1 << 23, 8
BLOCK = "scenario_id string, block int, first int, x binary, mean array<double>"
PEOPLE = "scenario_id string, id long, row int, y double"


class Blocks:
    """Marker blocks of the training rows of all scenarios, written once.

    ``rows`` hold scenario_id, id, fold, x (array) and y, whatever else; rows with a null y, or with a null in or for x, are
    no rows of a fit. Rows that share an id share their vector; repeated rows count each. A scenario's individuals are in the
    order of id, then y. An empty table has no blocks.
    """

    def __init__(self, rows: DataFrame, width: int | None = None, cells: int = CELLS):
        train = rows.where((F.col("fold") == "train") & whole("x") & F.col("y").isNotNull()).select("scenario_id", "id", "y", "x")
        self.shape = {r.scenario_id: (r.n, r.p, r.y) for r in train.groupBy("scenario_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"), F.avg("y").alias("y")).collect()}
        most = max((n for n, _, _ in self.shape.values()), default=1)
        self.width = width or max(1, cells // most)
        at = F.explode(F.sequence(F.lit(0), F.expr(f"(size(x) - 1) div {self.width}"))).alias("block")
        slices = train.where(F.size("x") > 0).select("scenario_id", "id", "y", "x", at)
        slices = slices.select("scenario_id", "block", "id", "y", F.slice("x", F.col("block") * self.width + 1, F.lit(self.width)).alias("x"))
        step = self.width

        def gather(key, pdf):
            pdf = pdf.sort_values(["id", "y"], kind="stable")
            x = np.stack(pdf["x"].to_numpy())
            mean = x.mean(0)
            return pd.DataFrame([(key[0], key[1], key[1] * step, (x - mean).tobytes(), mean)], columns=["scenario_id", "block", "first", "x", "mean"])

        self.table = materialise(slices.groupBy("scenario_id", "block").applyInPandas(gather, BLOCK), "blocks")
        self.targets = train.select("scenario_id", "id", "y")

    def centred_targets(self) -> dict[str, np.ndarray]:
        """y less its mean of each scenario, in the order of the blocks' rows: a number an individual."""
        told = self.targets.toPandas().sort_values(["scenario_id", "id", "y"], kind="stable")
        return {name: part["y"].to_numpy() - part["y"].mean() for name, part in told.groupby("scenario_id")}

    def outer(self) -> DataFrame:
        """(scenario_id, i, j, v), i <= j: the sum of all blocks' x x'. A scenario's blocks are summed by ``SUMMERS`` tasks, which
        send one number a cell each."""
        sizes = {k: n for k, (n, _, _) in self.shape.items()}

        def partial(batches):
            name, total = None, None

            def flush():
                i, j = np.triu_indices(len(total))
                for at in range(0, len(i), 1 << 20):
                    yield pd.DataFrame({"scenario_id": name, "i": i[at : at + (1 << 20)].astype(np.int32), "j": j[at : at + (1 << 20)].astype(np.int32), "v": total[i[at : at + (1 << 20)], j[at : at + (1 << 20)]]})

            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if row.scenario_id != name:
                        if name is not None:
                            yield from flush()
                        name, total = row.scenario_id, np.zeros((sizes[row.scenario_id],) * 2)
                    x = np.frombuffer(row.x).reshape(len(total), -1)
                    total += x @ x.T
            if name is not None:
                yield from flush()

        dealt = self.table.select("scenario_id", "block", "x").repartition("scenario_id", F.col("block") % SUMMERS).sortWithinPartitions("scenario_id")
        cells = dealt.mapInPandas(partial, "scenario_id string, i int, j int, v double")
        return cells.groupBy("scenario_id", "i", "j").agg(F.sum("v").alias("v"))


DUAL = "scenario_id string, alpha array<double>, penalty double, noise double"


def ridge(blocks: Blocks, model: str = "rrBLUP", penalty: float | None = None, explained: float = 1.0) -> DataFrame:
    """Ridge effects (``linear.FIT``) through the dual: (X X' + penalty) alpha = y - mean in the individuals, and effects
    X' alpha from one pass over the blocks. The same effects and penalty as ``linear.ridge_solution``.

    The penalty is no less than that under which the markers are expected to explain the share ``explained`` of the variance.
    A task solves one scenario's n x n system. A constant marker has an effect of 0; a scenario without usable rows has no
    effects."""
    y = blocks.targets.sparkSession.sparkContext.broadcast(blocks.centred_targets())
    means = {k: m for k, (_, _, m) in blocks.shape.items()}

    def solve(key, cells):
        own = y.value[key[0]]
        g = np.zeros((len(own), len(own)))
        i, j, v = (cells[c].to_numpy() for c in "ijv")
        g[i, j] = g[j, i] = v
        values, vectors = np.linalg.eigh(g)
        values = np.maximum(values, 0)
        r = vectors.T @ own
        lam, noise = marginal_penalty(values, r * np.sqrt(values), float(own @ own), len(own)) if penalty is None else (penalty, np.nan)
        least = values.mean() * (1 - explained) / explained
        if penalty is None and lam < least:
            lam, noise = least, max(float(own @ own - (r * r * values / (values + least)).sum()) / max(len(own) - 1, 1), 1e-12)
        return pd.DataFrame([(key[0], vectors @ (r / (values + lam)), lam, noise)], columns=["scenario_id", "alpha", "penalty", "noise"])

    solved = materialise(blocks.outer().groupBy("scenario_id").applyInPandas(solve, DUAL), "dual")

    def effects(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b = np.frombuffer(row.x).reshape(len(row.alpha), -1).T @ row.alpha
                yield pd.DataFrame({
                    "scenario_id": row.scenario_id, "pos": row.first + np.arange(len(b), dtype=np.int32), "effect": b,
                    "penalty": row.penalty, "noise": row.noise, "part": row.mean * b,
                })

    told = blocks.table.join(F.broadcast(solved), "scenario_id").mapInPandas(effects, "scenario_id string, pos int, effect double, penalty double, noise double, part double")
    return _with_intercepts(told.withColumn("inclusion", F.lit(1.0)), means, model)


def _with_intercepts(told: DataFrame, means: dict[str, float], model: str) -> DataFrame:
    """``linear.FIT`` from effects with each marker's share of the mean prediction (part)."""
    told = materialise(told, "effects")
    base = told.sparkSession.createDataFrame(list(means.items()), "scenario_id string, _y double")
    shares = told.groupBy("scenario_id").agg(F.sum("part").alias("_part")).join(F.broadcast(base), "scenario_id")
    out = told.join(F.broadcast(shares), "scenario_id").withColumn("intercept", F.col("_y") - F.col("_part"))
    return out.withColumn("model", F.lit(model)).select(*(c.split()[0] for c in FIT.split(", ")))


# ---------------------------------------------------------------- spike and slab

#: Shares of the blocks' steps that are tried in each round; the least is one over the number of blocks, or this.
STEPS, LEAST_STEP = (1.0, 0.5, 0.25, 0.1), 1e-3
STATE = "scenario_id string, block int, alpha array<double>, b array<double>, alpha_new array<double>, b_new array<double>, change array<double>, worst double, terms array<double>"


def _gains(alpha, b, alpha_new, b_new, steps, xx, noise, slab, inclusion):
    """For each step, the part of the bound that depends on one block alone: the variance of its effects, and how far they are
    from the prior."""
    out = []
    variance = noise / (xx + 1 / slab)
    for step in steps:
        a, m = alpha + step * (alpha_new - alpha), b + step * (b_new - b)
        a = np.clip(a, 1e-300, 1 - 1e-16)
        second = m * m / a + a * variance  # alpha (mu^2 + s^2)
        spread = second - m * m
        bound = -(xx * spread).sum() / (2 * noise) - second.sum() / (2 * slab * noise) + 0.5 * (a * np.log(np.e * variance / (slab * noise))).sum()
        bound -= (a * np.log(a / inclusion) + (1 - a) * np.log((1 - a) / (1 - inclusion))).sum()
        out.append(bound)
    return np.array(out)


def spike_slab(blocks: Blocks, model: str = "BayesB", inclusion: float = 0.1, rounds: int = 1000, close: float = 1e-6, inner: int = 1000, explained: float = 0.95) -> DataFrame:
    """Effects (``linear.FIT``) under a spike-and-slab prior by block-coordinate variational updates, to a fixed point.

    In each round every block updates its markers in turn, up to ``inner`` times or until nothing moves, against the residual that the last round left,
    and returns the change of its fitted values, one number an individual. How far all blocks go together is the step
    with the highest evidence bound, so the bound never falls; the fixed points are those of updating marker by marker.
    Two blocks of 64 markers in all take 50 to 280 rounds where there are about as many individuals, one block takes 5: blocks
    should be as large as a task can hold (``LARGE``).
    Noise and slab variance come from the ridge's dual form, where the markers explain ``explained`` of the variance at most: with
    far more markers than individuals the likelihood often ends at no noise at all, which no update would leave. The driver holds the residuals; a scenario is done when no
    update changes an inclusion or effect by ``close``."""
    spark = blocks.targets.sparkSession
    targets = blocks.centred_targets()
    start = {r.scenario_id: (r.penalty, r.noise) for r in ridge(blocks, explained=explained).select("scenario_id", "penalty", "noise").distinct().collect()}
    hyper = {k: (noise, 1 / (lam * inclusion)) for k, (lam, noise) in start.items()}
    least = max((-(-p // blocks.width) for _, p, _ in blocks.shape.values()), default=1)
    steps = np.array([*STEPS, max(1 / least, LEAST_STEP)])
    residual, open_ = targets, set(hyper)
    fill = lambda v: F.transform("mean", lambda _: F.lit(v))
    # the first state is no table of its own: constants are so small a file that Spark would broadcast them
    state, taken = None, {}
    met = blocks.table.withColumns({n: fill(v) for n, v in (("alpha", inclusion), ("b", 0.0), ("alpha_new", inclusion), ("b_new", 0.0))})
    for _ in range(rounds if blocks.shape else 0):
        held = spark.sparkContext.broadcast((residual, hyper, open_, taken))

        def update(batches):
            left, sizes, still, shares = held.value
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    share = shares.get(row.scenario_id, 0.0)
                    alpha0, b0 = row.alpha + share * (row.alpha_new - row.alpha), row.b + share * (row.b_new - row.b)
                    alpha, b = alpha0.copy(), b0.copy()
                    if row.scenario_id not in still:
                        out.append((row.scenario_id, row.block, alpha, b, alpha, b, [], 0.0, []))
                        continue
                    (noise, slab), r = sizes[row.scenario_id], left[row.scenario_id].copy()
                    x = np.frombuffer(row.x).reshape(len(r), -1)
                    xx = (x * x).sum(0)
                    variance = noise / (xx + 1 / slab)
                    prior = np.log(inclusion / (1 - inclusion)) + 0.5 * np.log(variance / (slab * noise))
                    worst = 0.0
                    for turn in range(inner):
                        moved = 0.0
                        for k in range(len(xx)):
                            mu = variance[k] / noise * (x[:, k] @ r + xx[k] * b[k])
                            a = 1 / (1 + np.exp(-np.clip(prior[k] + mu * mu / (2 * variance[k]), -500, 500)))
                            new = a * mu
                            moved = max(moved, abs(new - b[k]), abs(a - alpha[k]))
                            r -= x[:, k] * (new - b[k])
                            alpha[k], b[k] = a, new
                        worst = max(worst, moved if turn == 0 else 0.0)
                        if moved < close / 10:
                            break
                    terms = _gains(alpha0, b0, alpha, b, steps, xx, noise, slab, inclusion)
                    out.append((row.scenario_id, row.block, alpha0, b0, alpha, b, left[row.scenario_id] - r, worst, terms))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

        before, state = state, materialise(met.mapInPandas(update, STATE), "state")
        met = blocks.table.join(state.select("scenario_id", "block", "alpha", "b", "alpha_new", "b_new"), ["scenario_id", "block"])
        told, taken = _summed(state), {}
        for name, (change, terms, worst) in told.items():
            noise = hyper[name][0]
            bounds = [t - ((residual[name] - s * change) ** 2).sum() / (2 * noise) for s, t in zip(steps, terms)]
            taken[name] = float(steps[int(np.argmax(bounds))])
            residual[name] = residual[name] - taken[name] * change
            if worst < close:
                open_.discard(name)
        if before is not None:
            forget(before)
        held.unpersist()
        if not open_:
            break
    if state is None:
        state = materialise(met.drop("first", "x", "mean"), "state")
    # the last round's step is left out where it was below what counts as a change
    known = spark.createDataFrame([(k, noise, slab) for k, (noise, slab) in hyper.items()], "scenario_id string, noise double, penalty double")
    each = blocks.table.drop("x").join(state.hint("merge"), ["scenario_id", "block"])
    cells = each.select("scenario_id", F.posexplode(F.arrays_zip("alpha", "b", "mean")).alias("k", "m"), "first")
    told = cells.select("scenario_id", (F.col("first") + F.col("k")).alias("pos"), F.col("m.b").alias("effect"), F.col("m.alpha").alias("inclusion"), (F.col("m.b") * F.col("m.mean")).alias("part"))
    return _with_intercepts(told.join(F.broadcast(known), "scenario_id"), {k: m for k, (_, _, m) in blocks.shape.items()}, model)


def _summed(moved: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Sums of the changes and terms of each scenario's blocks, added up by tasks and then by Spark; the worst change."""

    def partial(batches):
        total: dict = {}
        for pdf in batches:
            for row in pdf[pdf["change"].map(len) > 0].itertuples(index=False):
                change, terms, worst = total.get(row.scenario_id, (0, 0, 0.0))
                total[row.scenario_id] = (change + row.change, terms + row.terms, max(worst, row.worst))
        for name, (change, terms, worst) in total.items():
            v = np.concatenate([terms, change])
            yield pd.DataFrame({"scenario_id": name, "k": np.arange(len(v), dtype=np.int32), "v": v, "worst": worst, "n": len(terms)})

    cells = moved.select("scenario_id", "change", "terms", "worst").mapInPandas(partial, "scenario_id string, k int, v double, worst double, n int")
    out = {}
    for name, part in cells.groupBy("scenario_id", "k").agg(F.sum("v").alias("v"), F.max("worst").alias("worst"), F.max("n").alias("n")).toPandas().groupby("scenario_id"):
        part = part.sort_values("k")
        n, v = int(part["n"].iloc[0]), part["v"].to_numpy()
        out[name] = v[n:], v[:n], float(part["worst"].max())
    return out
