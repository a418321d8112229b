"""Gaussian-kernel regression: exact, in blocks of individuals or in one task, and by random features.

``rows`` hold scenario_id, id, fold, x (array) and y, and whatever else. Rows with a null y, or with a null in or for x, are no
rows of a fit; a null in or for x gives a null prediction. Empty tables give empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions import stacked, whole
from traitloom.operators.gradient import plain
from traitloom.operators.linear import fit as linear_fit
from traitloom.operators.linear import marginal_penalty, sufficient_statistics
from traitloom.session import bounded_batches, forget, materialise

FIT = "scenario_id string, id long, alpha double, intercept double, penalty double"


def kernel_blup(kernel: DataFrame, train: DataFrame) -> DataFrame:
    """Weights of the training individuals: (K + penalty) alpha = y - mean.

    ``kernel``: scenario_id, i, j (i <= j), k over training individuals; ``train``: scenario_id, id, y. A scenario's
    kernel has n * n cells and is solved in one task, so this is for scenarios of some thousand individuals; for larger
    ones use ``blup_in_blocks``. The penalty is that of greatest restricted likelihood. Rows of ``kernel`` with an
    individual that ``train`` lacks must be left out before; both tables hold an individual once and no nulls.
    """
    own = kernel.join(train.select("scenario_id", F.col("id").alias("i"), F.col("y")), ["scenario_id", "i"])

    def solve(key, pdf):
        ids = np.unique(pdf["i"])
        a, b = np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])
        k, y = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        k[a, b] = k[b, a] = pdf["k"]
        y[a] = pdf["y"]
        return _solved(key[0], ids, k, y)

    return own.groupBy("scenario_id").applyInPandas(solve, FIT)


def _solved(name: str, ids: np.ndarray, k: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """``FIT`` of a scenario whose kernel is one matrix."""
    mean, eye = y.mean(), np.eye(len(ids))
    centred = k - k.mean(0)[None, :] - k.mean(1)[:, None] + k.mean()
    values, vectors = np.linalg.eigh((centred + centred.T) / 2)
    values = np.maximum(values, 0)
    r = vectors.T @ (y - mean)
    lam, _ = marginal_penalty(values, r * np.sqrt(values), float((y - mean) @ (y - mean)), len(ids))
    return pd.DataFrame({"scenario_id": name, "id": ids, "alpha": np.linalg.solve(k + lam * eye, y - mean), "intercept": mean, "penalty": lam})


#: Individuals of the largest scenario whose kernel is one task's matrix.
ONE_TASK = 2048


def blup(rows: DataFrame, gammas: dict[str, float]) -> DataFrame:
    """Weights of the training individuals (``FIT``) from their vectors, K = exp(-gamma d): a scenario of up to ``ONE_TASK``
    individuals as in ``kernel_blup``, a larger one as in ``blup_in_blocks``. No table of pairs is written."""
    train = _usable(rows)
    counts = {r.scenario_id: r.n for r in train.groupBy("scenario_id").agg(F.count("*").alias("n")).collect()}
    large = [k for k, n in counts.items() if n > ONE_TASK]

    def solve(key, pdf):
        pdf = pdf.sort_values(["id", "y"], kind="stable")
        x = np.stack(pdf["x"].to_numpy())
        return _solved(key[0], pdf["id"].to_numpy(), _gaussian(x, x, gammas[key[0]]), pdf["y"].to_numpy())

    small = train.where(~F.col("scenario_id").isin(large)).groupBy("scenario_id").applyInPandas(solve, FIT)
    return small.unionByName(blup_in_blocks(rows.where(F.col("scenario_id").isin(large)), gammas)) if large else small


def kernel_predict(kernel: DataFrame, weights: DataFrame) -> DataFrame:
    """scenario_id, id, predicted: kernel rows of any individual against the training ones (``kernel``: id, train_id, k)."""
    w = weights.select("scenario_id", F.col("id").alias("train_id"), "alpha", "intercept")
    return kernel.join(w, ["scenario_id", "train_id"]).groupBy("scenario_id", "id").agg((F.sum(F.col("k") * F.col("alpha")) + F.max("intercept")).alias("predicted"))


class RandomFeatures:
    """sqrt(2 / m) cos(W x + b): inner products approach exp(-gamma |x - y|^2). The draws depend on the seed only."""

    def __init__(self, width: int, count: int, gamma: float, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.w, self.b = draw.normal(0, 1, (count, width)) * np.sqrt(2 * gamma), draw.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.b)) * np.cos(x @ self.w.T + self.b)


class TensorSketch:
    """Inner products approach (gamma x.y + constant)^degree. Each factor hashes the coordinates of (sqrt(gamma) x, sqrt(constant))
    to ``count`` signed buckets (a count sketch); the sketch of the product is the convolution of the factors' sketches, a
    product of their Fourier transforms. The draws depend on the seed only."""

    def __init__(self, width: int, count: int, gamma: float, degree: int = 3, constant: float = 0.0, seed: int = 1):
        if degree < 1:
            raise ValueError("the degree is 1 or more")
        draw = np.random.default_rng(seed)
        self.scale, self.constant, self.count = np.sqrt(gamma), np.sqrt(constant), count
        self.buckets, self.signs = draw.integers(0, count, (degree, width + 1)), draw.choice([-1.0, 1.0], (degree, width + 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.column_stack([self.scale * x, np.full(len(x), self.constant)])
        product = 1.0
        for buckets, signs in zip(self.buckets, self.signs):
            order = np.argsort(buckets, kind="stable")
            used, starts = np.unique(buckets[order], return_index=True)
            sketch = np.zeros((len(x), self.count))
            sketch[:, used] = np.add.reduceat((x * signs)[:, order], starts, axis=1)
            product = product * np.fft.rfft(sketch, axis=1)
        return np.fft.irfft(product, self.count, axis=1)


def kernel_map(kernel: str, width: int, count: int, gamma: float, degree: int = 3, constant: float = 0.0):
    """Features whose inner products are, or approach, a kernel's: ``linear``, ``rbf`` or ``poly``."""
    if kernel == "linear":
        return plain
    if kernel == "rbf":
        return RandomFeatures(width, count, gamma)
    if kernel == "poly":
        return TensorSketch(width, count, gamma, degree, constant)
    raise ValueError(f"no kernel is called {kernel}")


def random_features(x: str, width: int, count: int, gamma: float, seed: int = 1) -> Column:
    """The features of an array column, as an array; null where it is not whole."""
    of = RandomFeatures(width, count, gamma, seed)

    @F.pandas_udf("array<double>")
    def features(rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype=object)
        there, vectors = stacked(rows)
        for at, f in zip(np.flatnonzero(there), of(vectors) if there.any() else []):
            out.iat[at] = f
        return out

    return features(x)


def with_features(rows: DataFrame, maps: dict[str, RandomFeatures]) -> DataFrame:
    """``rows`` with x replaced by its scenario's features; null where x is not whole or the scenario has no map."""
    held = rows.sparkSession.sparkContext.broadcast(maps)

    @F.pandas_udf("array<double>")
    def features(scenario: pd.Series, vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(scenario), dtype=object)
        for name in scenario.unique():
            here = np.flatnonzero(scenario == name)
            there, x = stacked(vectors.iloc[here])
            if there.any() and name in held.value:
                for at, f in zip(here[there], held.value[name](x)):
                    out.iat[at] = f
        return out

    return rows.withColumn("x", features("scenario_id", "x"))


@dataclass
class KernelRidge:
    """A ridge on random features: a Gaussian-kernel regression whose size does not depend on the individuals."""

    features: RandomFeatures
    weights: np.ndarray
    intercept: float

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights + self.intercept


def fit_kernel_ridge(rows: DataFrame, maps: dict[str, RandomFeatures]) -> dict[str, KernelRidge]:
    """Kernel models of all scenarios from the summed Gram matrices of their features; the penalty is that of greatest
    restricted likelihood. ``rows`` as for ``sufficient_statistics``; only training rows are used."""
    fits = linear_fit(sufficient_statistics(with_features(rows, maps)), "RKHS").toPandas()
    return {
        name: KernelRidge(maps[name], part.sort_values("pos")["effect"].to_numpy(), float(part["intercept"].iloc[0]))
        for name, part in fits.groupby("scenario_id")
    }


# ---------------------------------------------------------------- exact, in blocks of individuals

#: Individuals of a block, on average. Blocks of vectors are ``TOGETHER`` times as large: the kernel of two is computed anew in each
#: pass, which is less to write, and to read, up to so many markers. Pairs of such blocks that a task takes on at least.
INDIVIDUALS, TOGETHER, PAIRS = 256, 4, 64
PAIR = "scenario_id string, a int, b int, k binary"
VECTORS = "scenario_id string, block int, blocks int, kind string, x binary"


def _dealt(rows: DataFrame, counts: dict[str, int], size: int) -> DataFrame:
    """``rows`` with the block of each individual, by a hash of its id, and the number of blocks of its scenario."""
    told = rows.sparkSession.createDataFrame([(k, -(-n // size)) for k, n in counts.items()], "scenario_id string, _blocks int")
    met = rows.join(F.broadcast(told), "scenario_id")  # a row a scenario
    return met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))


def _gaussian(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma d): one product of (2 gamma x, -gamma x.x, 1) and (z, 1, -gamma z.z), in place."""
    one = lambda v: np.ones(len(v))
    d = np.column_stack([2 * gamma * x, -gamma * (x * x).sum(1), one(x)]) @ np.column_stack([z, one(z), -gamma * (z * z).sum(1)]).T
    np.minimum(d, 0, out=d)
    return np.exp(d, out=d)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("fold") == "train") & whole("x") & F.col("y").isNotNull()).select("scenario_id", "id", "x", "y")


def kernel_blocks(rows: DataFrame, gammas: dict[str, float], counts: dict[str, int]) -> DataFrame:
    """``PAIR``: exp(-gamma d) of every two blocks (a <= b) of training individuals of a scenario, a row a pair. The rows of a
    block are in the order of id, then y."""
    dealt = _dealt(_usable(rows), counts, INDIVIDUALS)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("scenario_id", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "y", "x")

    def compare(key, pdf):
        pdf = pdf.sort_values(["id", "y"], kind="stable")
        first, second = (pdf["block"] == key[1]).to_numpy(), (pdf["block"] == key[2]).to_numpy()
        if not first.any() or not second.any():
            return pd.DataFrame(columns=["scenario_id", "a", "b", "k"])
        x = np.stack(pdf["x"].to_numpy())
        return pd.DataFrame([(*key, _gaussian(x[first], x[second], gammas[key[0]]).tobytes())], columns=["scenario_id", "a", "b", "k"])

    return met.groupBy("scenario_id", "a", "b").applyInPandas(compare, PAIR)


def vector_blocks(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(scenario_id, a, b, kind, x, other_kind, z): the vectors of every two blocks (a <= b) of training individuals of a
    scenario, a row a pair, packed as the least of a byte or a double that holds them. The rows of a block are in the order of
    id, then y; z is null for a block with itself."""
    dealt = _dealt(_usable(rows), counts, TOGETHER * INDIVIDUALS)

    def pack(key, pdf):
        x = np.stack(pdf.sort_values(["id", "y"], kind="stable")["x"].to_numpy()).astype(np.float64)
        with np.errstate(invalid="ignore"):
            small = x.astype(np.int8)
        x = small if np.array_equal(small, x) else x
        return pd.DataFrame([(*key, x.dtype.str, x.tobytes())], columns=["scenario_id", "block", "blocks", "kind", "x"])

    packed = materialise(dealt.withColumnRenamed("_blocks", "blocks").groupBy("scenario_id", "block", "blocks").applyInPandas(pack, VECTORS), "vectors")
    first = packed.select("scenario_id", F.col("block").alias("a"), "kind", "x", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b"))
    second = packed.select("scenario_id", F.col("block").alias("b"), F.col("kind").alias("other_kind"), F.col("x").alias("z"))
    z = F.when(F.col("a") < F.col("b"), F.col("z"))
    met = first.join(second, ["scenario_id", "b"]).select("scenario_id", "a", "b", "kind", "x", "other_kind", z.alias("z"))
    blocks = [-(-n // (TOGETHER * INDIVIDUALS)) for n in counts.values()]
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, sum(m * (m + 1) // 2 for m in blocks) // PAIRS)
    return bounded_batches(met).repartition(parts, "scenario_id", "a", "b")


def _cells(row, n: int, gamma: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The kernel of a pair of blocks, the first of ``n`` individuals, and their vectors behind a 1, if the pair holds vectors."""
    if hasattr(row, "k"):
        return np.frombuffer(row.k).reshape(n, -1), []
    x = np.frombuffer(row.x, row.kind).reshape(n, -1).astype(np.float64)
    z = x if row.a == row.b else np.frombuffer(row.z, row.other_kind).reshape(-1, x.shape[1]).astype(np.float64)
    return _gaussian(x, z, gamma), [np.column_stack([np.ones(len(v)), v]) for v in (x, z)]


def _over_pairs(kernel: DataFrame, held: dict, work) -> dict[str, dict[int, np.ndarray]]:
    """Sums, by scenario and block, of the vectors that ``work`` (what is held for a scenario, a pair of blocks) tells of each pair."""
    sent = kernel.sparkSession.sparkContext.broadcast(held)

    def partial(batches):
        out: dict = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.scenario_id in sent.value:
                    for at, part in work(sent.value[row.scenario_id], row):
                        out[row.scenario_id, at] = out.get((row.scenario_id, at), 0) + part
        yield pd.DataFrame([(*key, v.tobytes()) for key, v in out.items()], columns=["scenario_id", "block", "v"])

    def add(key, pdf):
        return pd.DataFrame([(*key, sum(np.frombuffer(v) for v in pdf["v"]).tobytes())], columns=["scenario_id", "block", "v"])

    kind = "scenario_id string, block int, v binary"
    out: dict[str, dict[int, np.ndarray]] = {k: {} for k in held}
    for row in bounded_batches(kernel).mapInPandas(partial, kind).groupBy("scenario_id", "block").applyInPandas(add, kind).collect():
        out[row.scenario_id][row.block] = np.frombuffer(row.v)
    sent.destroy()
    return out


#: Blocks under which a pass tells what is no individual's: sums over W, over W'KW.
SPAN, TURNED = -1, -2


def _span(held, row):
    """W'W and W'r under ``SPAN``, W'KW under ``TURNED``, where W are the vectors behind a 1."""
    left, gamma, _ = held
    k, (w, z) = _cells(row, len(left[row.a]), gamma)
    turned = w.T @ k @ z
    if row.a == row.b:
        yield SPAN, np.concatenate([(w.T @ w).ravel(), w.T @ left[row.a]])
    yield TURNED, (turned if row.a == row.b else turned + turned.T).ravel()


def _turn(held, row):
    """(K + penalty) (v + W h) by blocks, and W' of it under ``SPAN``."""
    v, h, gamma, penalty = held
    k, w = _cells(row, len(v[row.a]), gamma)
    way = [v[at] + (x @ h if w else 0) for at, x in zip((row.a, row.b), w or [0, 0])]
    parts = [k @ way[1] + (penalty * way[0] if row.a == row.b else 0)] + ([k.T @ way[0]] if row.a != row.b else [])
    yield from zip((row.a, row.b), parts)
    if w:
        yield SPAN, sum(x.T @ part for x, part in zip(w, parts))


def _along(held, row):
    """W h by blocks."""
    sizes, h = held
    if row.a == row.b:
        x = np.frombuffer(row.x, row.kind).reshape(sizes[row.a], -1)
        yield row.a, h[0] + x @ h[1:]


class _Conjugate:
    """Conjugate gradients of a scenario for (K + penalty) alpha = left, whose kernel others turn.

    They are conditioned by the kernel on the span of the vectors and a constant, W, where its large values lie: M = Q (T +
    penalty) Q' + c (1 - Q Q') with an orthonormal Q = W B and T = Q'KQ. A direction is v + W h, so that no vector of an
    individual is needed here. Without W, M = c.
    """

    def __init__(self, left: dict[int, np.ndarray], penalty: float, span: np.ndarray, turned: np.ndarray):
        n, m = sum(len(v) for v in left.values()), int((np.sqrt(4 * len(span) + 1) - 1) / 2 + 0.5)
        self.left, self.penalty, self.u = left, penalty, span[m * m :].copy()
        values, vectors = np.linalg.eigh(span[: m * m].reshape(m, m))
        keep = values > 1e-8 * values.max(initial=0)
        b = vectors[:, keep] / np.sqrt(values[keep])
        t = b.T @ turned.reshape(m, m) @ b
        self.c = penalty + max(n - np.trace(t), 0) / max(n - len(t), 1)
        self.d = b @ (np.linalg.inv((t + t.T) / 2 + penalty * np.eye(len(t))) - np.eye(len(t)) / self.c) @ b.T
        self.alpha, self.along = {k: np.zeros(len(v)) for k, v in left.items()}, np.zeros(m)
        self.v, self.h = {k: v / self.c for k, v in left.items()}, self.d @ self.u
        self.size = self.norm / self.c + float(self.u @ self.h)

    @property
    def norm(self) -> float:
        return sum(float(v @ v) for v in self.left.values())

    def step(self, turned: dict[int, np.ndarray]) -> None:
        w = turned.get(SPAN, np.zeros(0))
        share = self.size / (sum(float(v @ turned[k]) for k, v in self.v.items()) + float(self.h @ w))
        self.alpha = {k: v + share * self.v[k] for k, v in self.alpha.items()}
        self.left = {k: v - share * turned[k] for k, v in self.left.items()}
        self.along, self.u = self.along + share * self.h, self.u - share * w
        g = self.d @ self.u
        now = self.norm / self.c + float(self.u @ g)
        self.v = {k: v / self.c + now / self.size * self.v[k] for k, v in self.left.items()}
        self.h, self.size = g + now / self.size * self.h, now


def blup_in_blocks(rows: DataFrame, gammas: dict[str, float], penalties: dict[str, float] | None = None, close: float = 1e-10, passes: int = 1000) -> DataFrame:
    """Weights of the training individuals (``FIT``): (K + penalty) alpha = y - mean by conjugate gradients, K = exp(-gamma d).

    Blocks of individuals meet blocks once and are written in pairs as vectors, and each pass computes their kernel anew: n * n / 2048
    times the bytes of a vector. With so many markers that the kernel takes less, half of n * n numbers, it is written. The
    driver holds some numbers an individual, a task two blocks and their kernel. Without given penalties a scenario's is that of greatest restricted likelihood under 256 random features of the same kernel. Rows that
    share an id are individuals alike, whose weights stand in a row each.
    """
    spark, train = rows.sparkSession, _usable(rows)
    shape = train.groupBy("scenario_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).collect()
    counts, width = {r.scenario_id: r.n for r in shape}, {r.scenario_id: r.p for r in shape}
    if not counts:
        return spark.createDataFrame([], FIT)
    if penalties is None:
        maps = {k: RandomFeatures(width[k], 256, gammas[k]) for k in counts}
        fits = linear_fit(sufficient_statistics(with_features(rows, maps)), "RKHS")
        penalties = {r.scenario_id: r.penalty for r in fits.select("scenario_id", "penalty").distinct().collect()}
    narrow = max(width.values()) < 2 * INDIVIDUALS
    dealt = _dealt(train.drop("x"), counts, TOGETHER * INDIVIDUALS if narrow else INDIVIDUALS)
    people = dealt.select("scenario_id", "block", "id", "y").toPandas().sort_values(["scenario_id", "block", "id", "y"], kind="stable")
    kernel = materialise(vector_blocks(rows, counts) if narrow else kernel_blocks(rows, gammas, counts), "kernel")
    split = {k: {b: q["y"].to_numpy() for b, q in p.groupby("block")} for k, p in people.groupby("scenario_id")}
    mean = {k: float(np.concatenate(list(v.values())).mean()) for k, v in split.items()}
    left = {k: {b: y - mean[k] for b, y in v.items()} for k, v in split.items()}
    held = {k: (v, gammas[k], penalties[k]) for k, v in left.items()}
    spans = _over_pairs(kernel, held, _span) if narrow else {}
    none = np.zeros(0)
    solvers = {k: _Conjugate(v, penalties[k], *(spans[k][at] if narrow else none for at in (SPAN, TURNED))) for k, v in left.items()}
    least = {k: close * close * s.norm for k, s in solvers.items()}
    for _ in range(passes):
        open_ = {k: s for k, s in solvers.items() if s.norm > least[k]}
        if not open_:
            break
        turned = _over_pairs(kernel, {k: (s.v, s.h, gammas[k], s.penalty) for k, s in open_.items()}, _turn)
        for k, s in open_.items():
            s.step(turned[k])
    alpha = {k: s.alpha for k, s in solvers.items()}
    if narrow:
        along = _over_pairs(kernel, {k: ({b: len(v) for b, v in s.alpha.items()}, s.along) for k, s in solvers.items()}, _along)
        alpha = {k: {b: v + along[k][b] for b, v in s.alpha.items()} for k, s in solvers.items()}
    forget(kernel)
    people["alpha"] = np.concatenate([alpha[k][b] for k, b in people[["scenario_id", "block"]].drop_duplicates().itertuples(index=False)])
    people["intercept"], people["penalty"] = people["scenario_id"].map(mean), people["scenario_id"].map(penalties)
    return spark.createDataFrame(people[["scenario_id", "id", "alpha", "intercept", "penalty"]], FIT)


#: Cells of the vectors of a block that is predicted, or predicted from.
MET = 1 << 19


def blup_predict(rows: DataFrame, weights: DataFrame, gammas: dict[str, float]) -> DataFrame:
    """scenario_id, id, predicted of every row whose x is whole: its kernel with all training individuals, block against block,
    none of which is written. Blocks hold ``MET`` cells of vectors. Rows that share an id share their prediction."""
    told = _usable(rows).dropDuplicates(["scenario_id", "id"])
    sums = weights.groupBy("scenario_id", "id").agg(F.sum("alpha").alias("alpha"), F.max("intercept").alias("intercept"))
    asked = rows.where(whole("x")).select("scenario_id", "id", "x").dropDuplicates(["scenario_id", "id"])
    shape = asked.groupBy("scenario_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).collect()
    counts, size = {r.scenario_id: r.n for r in shape}, max(INDIVIDUALS, MET // max((r.p for r in shape), default=1))
    kind = "scenario_id string, id long, part double"
    if not counts:
        return rows.sparkSession.createDataFrame([], "scenario_id string, id long, predicted double")

    def every(df: DataFrame, a: str, b: str, *more: str) -> DataFrame:
        met = _dealt(df, counts, size).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        return met.select(*(F.col(c).alias(n) for c, n in (("scenario_id", "scenario_id"), (a, "a"), (b, "b"))), *(F.col(c).alias(c) for c in ("id", "x", *more)))

    left, right = every(asked, "block", "other"), every(told.join(sums, ["scenario_id", "id"]), "other", "block", "alpha")

    def score(key, mine, theirs):
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=["scenario_id", "id", "part"])
        x, z, alpha = np.stack(mine["x"].to_numpy()), np.stack(theirs["x"].to_numpy()), theirs["alpha"].to_numpy()
        part = [_gaussian(x[at : at + INDIVIDUALS], z, gammas[key[0]]) @ alpha for at in range(0, len(x), INDIVIDUALS)]
        return pd.DataFrame({"scenario_id": key[0], "id": mine["id"], "part": np.concatenate(part)})

    keys = ["scenario_id", "a", "b"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, kind)
    base = sums.groupBy("scenario_id").agg(F.max("intercept").alias("intercept"))
    return parts.groupBy("scenario_id", "id").agg(F.sum("part").alias("part")).join(base, "scenario_id").select("scenario_id", "id", (F.col("part") + F.col("intercept")).alias("predicted"))
