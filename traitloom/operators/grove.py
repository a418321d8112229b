"""Random forests of all scenarios in one job: every tree of every scenario grows by one level in each pass over the rows.

A pass routes the rows of a scenario down its trees and sums weights and targets of each open node over marker values;
the sums are keyed by scenario, tree and node, each node's best split comes back as one row, and the driver appends it to
the trees. Trees are dealt to batches so that what a pass holds is bounded. Plans do not depend on the number of
scenarios or trees, and depth has no limit of its own. The result is the node table of ``forest``.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions import stacked, whole
from traitloom.session import delete_at_end, materialise, new_path

NODES = "scenario_id string, tree int, node int, left int, right int, feature int, threshold double, gain double, cover double, value double"
#: Thresholds of a marker at most; open nodes of a batch of trees; numbers of partial sums that a task holds; markers of a
#: partial sum's row; rows of a chunk.
THRESHOLDS, OPEN, HELD, PART, CHUNK = 31, 1 << 18, 1 << 23, 1 << 10, 1 << 12
#: Gains below this share of the root's variance count as none.
LEAST_GAIN = 1e-12
#: Cumulative probabilities of how often a bootstrap sample holds a row.
DRAWS = np.cumsum([exp(-1) / factorial(k) for k in range(12)])


def thresholds(rows: DataFrame, most: int = THRESHOLDS) -> list[np.ndarray]:
    """The middles between each marker's values, over all rows. A marker of more values keeps ``most``, evenly spaced among
    those that the tasks send (at most eight times as many each)."""
    wide = 8 * (most + 1)

    def partial(batches):
        held: list = []
        for pdf in batches:
            _, x = stacked(pdf["x"])
            held = [np.unique(np.append(held[k], x[:, k]) if held else x[:, k]) for k in range(x.shape[1])]
            held = [v if len(v) <= wide else v[np.linspace(0, len(v) - 1, wide).astype(int)] for v in held]
        if held:  # a task may have no rows
            yield pd.DataFrame({"pos": np.arange(len(held), dtype=np.int32), "v": held})

    values = rows.select("x").mapInPandas(partial, "pos int, v array<double>")
    merged = values.groupBy("pos").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))
    out = []
    for row in merged.orderBy("pos").collect():
        v = np.array(row.v)
        v = v if len(v) <= most + 1 else v[np.linspace(0, len(v) - 1, most + 1).astype(int)]
        out.append((v[1:] + v[:-1]) / 2)
    return out


def drawn(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample, from the row's hash."""
    with np.errstate(over="ignore"):
        z = hashes.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(DRAWS, (z >> np.uint64(11)) * 2.0**-53, "right").astype(np.float64)


class Tree:
    """A growing tree. ``bins``: a row goes left if its marker's bin is not above; -1 in a leaf. ``sampled``: whether it sees a
    bootstrap sample or each row once."""

    def __init__(self, sampled: bool):
        self.sampled = sampled
        self.left, self.right, self.feature, self.bin, self.gain, self.cover, self.value = [-1], [-1], [-1], [-1], [0.0], [0.0], [0.0]
        self.open, self.least = [0], 0.0

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, np.int32) for v in (self.left, self.right, self.feature, self.bin))

    def grow(self, found: dict[int, tuple]) -> None:
        """Splits of the open nodes; those without one are leaves."""
        new = []
        for node in self.open:
            if node not in found:
                continue
            feature, bin_, gain, weight, total, left_weight, left_total = found[node]
            self.cover[node], self.value[node] = weight, total / weight
            if node == 0:
                self.least = LEAST_GAIN * max(1.0, abs(total / weight)) ** 2
            if feature < 0 or gain <= self.least:
                continue
            at = len(self.left)
            self.left[node], self.right[node], self.feature[node], self.bin[node], self.gain[node] = at, at + 1, feature, bin_, gain
            for w, s in ((left_weight, left_total), (weight - left_weight, total - left_total)):
                for column, v in ((self.left, -1), (self.right, -1), (self.feature, -1), (self.bin, -1), (self.gain, 0.0), (self.cover, w), (self.value, s / w)):
                    column.append(v)
            new += [at, at + 1]
        self.open = new


def routed(codes: np.ndarray, left, right, feature, bins, steps: int) -> np.ndarray:
    """The node that each row of marker bins reaches."""
    at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
    for _ in range(steps):
        inner = left[at] >= 0
        if not inner.any():
            break
        down = codes[rows, np.maximum(feature[at], 0)] <= bins[at]
        at = np.where(inner, np.where(down, left[at], right[at]), at)
    return at


PARTIAL = "scenario_id string, tree int, node int, part int, w binary, s binary"
BEST = "scenario_id string, tree int, node int, gain double, feature int, bin int, weight double, total double, left_weight double, left_total double"


def _sums(binned: DataFrame, trees: dict, level: int, width: int, bins: int, seed: int) -> DataFrame:
    """``PARTIAL``: weights and weighted targets of every open node, by marker and bin."""
    shape = {k: (t.arrays(), t.open, t.sampled) for k, t in trees.items() if t.open}
    of: dict[str, list[int]] = {}
    for name, tree in shape:
        of.setdefault(name, []).append(tree)
    held = binned.sparkSession.sparkContext.broadcast((shape, of))

    def partial(batches):
        sums: dict = {}

        def flush():
            out = []
            for (name, tree, node), (w, s) in sums.items():
                for part, at in enumerate(range(0, width, PART)):
                    out.append((name, tree, node, part, w[at : at + PART].tobytes(), s[at : at + PART].tobytes()))
            sums.clear()
            return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])

        for pdf in batches:
            for name, part in pdf.groupby("scenario_id", sort=False):
                codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), width)
                y, hashes = part["y"].to_numpy(), part["h"].to_numpy()
                for tree in held.value[1].get(name, ()):
                    arrays, open_, sampled = held.value[0][name, tree]
                    weight = drawn(hashes, tree, seed) if sampled else np.ones(len(y))
                    at = routed(codes, *arrays, level)
                    here = np.flatnonzero(np.isin(at, open_) & (weight > 0))
                    here = here[np.argsort(at[here], kind="stable")]
                    if not len(here):
                        continue
                    nodes, starts = np.unique(at[here], return_index=True)
                    w, mine = weight[here][:, None], codes[here]
                    wy = w * y[here][:, None]
                    for b in range(bins):
                        there = mine == b
                        for k, v in enumerate((w, wy)):
                            added = np.add.reduceat(there * v, starts, axis=0)
                            for node, row in zip(nodes.tolist(), added):
                                if (name, tree, node) not in sums:
                                    sums[name, tree, node] = np.zeros((width, bins)), np.zeros((width, bins))
                                sums[name, tree, node][k][:, b] += row
                    if len(sums) * 2 * width * bins > HELD:
                        yield flush()
        yield flush()

    return binned.mapInPandas(partial, PARTIAL)


def best_splits(sums: DataFrame, bins: int, share: float, seed: int) -> DataFrame:
    """``BEST``: the split of each node that lowers the variance most; among equals that of the first marker and value. A node
    that cannot be split has a feature of -1."""

    def evaluate(key, w, s):
        name, tree, node, part = key
        w, s = w.reshape(-1, bins), s.reshape(-1, bins)
        weight, total = w[0].sum(), s[0].sum()
        lw, ls = w.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
        rw, rs = weight - lw, total - ls
        allowed = (lw > 1e-9) & (rw > 1e-9)
        if share < 1:
            luck = np.random.default_rng([seed, tree, node, part, *name.encode()])
            allowed &= (luck.random(len(w)) < share)[:, None]
        if not allowed.any():
            return (name, tree, node, -1.0, -1, -1, weight, total, 0.0, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(allowed, (ls * ls / lw + rs * rs / rw - total * total / weight) / weight, -1)
        gain = np.round(gain, 9)
        at = int(np.argmax(gain))
        f, b = divmod(at, bins - 1)
        return (name, tree, node, float(gain[f, b]), part * PART + f, b, weight, total, lw[f, b], ls[f, b])

    def run(batches):
        key, w, s = None, None, None
        columns = [c.split()[0] for c in BEST.split(", ")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                new = (row.scenario_id, row.tree, row.node, row.part)
                rw, rs = np.frombuffer(row.w), np.frombuffer(row.s)
                if new == key:
                    w, s = w + rw, s + rs
                    continue
                if key:
                    out.append(evaluate(key, w, s))
                key, w, s = new, rw, rs
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([evaluate(key, w, s)] if key else [], columns=columns)

    keys = ["scenario_id", "tree", "node", "part"]
    each = sums.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, BEST)
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    best = F.max_by(F.struct("gain", "feature", "bin", "weight", "total", "left_weight", "left_total"), order)
    return each.groupBy("scenario_id", "tree", "node").agg(best.alias("b")).select("scenario_id", "tree", "node", "b.*")


def grow(rows: DataFrame, trees: int, depth: int = 5, share: float = 1.0, bootstrap: bool = True, seed: int = 1) -> DataFrame:
    """The node table (``NODES``) of ``trees`` regression trees of every scenario, grown on its training rows.

    ``rows`` hold scenario_id, id, fold, x (array) and y, whatever else; rows with a null y, or with a null in or for x, are no
    rows of a fit; repeated rows count each and are drawn together. A tree sees a bootstrap sample (Poisson draws from a hash
    of scenario and id) or all rows, and a node ``share`` of the markers. Splits lie between a marker's values
    (``thresholds``), a row goes left if its value is not above. A scenario without rows has no trees. A tree whose sample drew
    no row, which happens where a scenario has very few, sees each of its rows once.
    """
    spark = rows.sparkSession
    train = rows.where((F.col("fold") == "train") & whole("x") & F.col("y").isNotNull())
    train = train.select("scenario_id", "id", "y", "x", F.xxhash64("scenario_id", "id").alias("h"))
    counts = {r.scenario_id: r.n for r in train.groupBy("scenario_id").agg(F.count("*").alias("n")).collect()}
    path = new_path(spark, "grove")
    delete_at_end(spark, path)
    if not counts:
        return spark.createDataFrame([], NODES)
    cuts = thresholds(train)
    width, bins = len(cuts), max(2, 1 + max(map(len, cuts)))
    held = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("binary")
    def coded(vectors: pd.Series) -> pd.Series:
        _, x = stacked(vectors)
        return pd.Series([row.tobytes() for row in np.column_stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(held.value)]).astype(np.uint8)])

    chunks = max(1, -(-max(counts.values()) // CHUNK))
    binned = materialise(train.select("scenario_id", "h", "y", coded("x").alias("codes")).repartition("scenario_id", F.pmod("h", F.lit(chunks))), "binned")
    every = [(name, t) for t in range(trees) for name in sorted(counts)]
    batch = max(1, OPEN // max(counts.values()))

    def grown_of(keys: list[tuple], sampled: bool) -> dict[tuple, Tree]:
        grown = {key: Tree(sampled) for key in keys}
        for level in range(depth + 1):
            found: dict[tuple, dict] = {}
            for r in best_splits(_sums(binned, grown, level, width, bins, seed), bins, share, seed).collect():
                feature = r.feature if level < depth else -1
                found.setdefault((r.scenario_id, r.tree), {})[r.node] = (feature, r.bin, r.gain, r.weight, r.total, r.left_weight, r.left_total)
            for key, tree in grown.items():
                tree.grow(found.get(key, {}))
            if not any(t.open for t in grown.values()):
                break
        return grown

    for at in range(0, len(every), batch):
        grown = grown_of(every[at : at + batch], bootstrap)
        if missed := [key for key, tree in grown.items() if not tree.cover[0]]:
            grown |= grown_of(missed, False)
        table = []
        for (name, t), tree in grown.items():
            n = len(tree.left)
            limits = [float(cuts[f][b]) if f >= 0 else np.nan for f, b in zip(tree.feature, tree.bin)]
            table.append(pd.DataFrame({"scenario_id": name, "tree": t, "node": range(n), "left": tree.left, "right": tree.right, "feature": tree.feature, "threshold": limits, "gain": tree.gain, "cover": tree.cover, "value": tree.value}))
        told = spark.createDataFrame(pd.concat(table, ignore_index=True), NODES)
        told.withColumn("threshold", F.nanvl("threshold", F.lit(None).cast("double"))).write.mode("append").parquet(path)
    return spark.read.schema(NODES).parquet(path)


def predict(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with ``predicted``, the mean of their scenario's trees; null without trees, or where x is not whole. Rows that share
    a scenario and an id share x and their prediction.

    A scenario's trees travel to each chunk of its rows; a task holds one scenario's forest and one batch of rows."""
    asked = rows.where(whole("x") & F.col("scenario_id").isNotNull()).select("scenario_id", "id", "x").dropDuplicates(["scenario_id", "id"])
    most = asked.groupBy("scenario_id").count().agg(F.max("count")).first()[0] or 1
    chunks = -(-most // CHUNK)
    cell = F.struct("node", "left", "right", "feature", F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "value")
    packed = nodes.groupBy("scenario_id", "tree").agg(F.array_sort(F.collect_list(cell)).alias("nodes"))
    fields = ["left", "right", "feature", "threshold", "value"]
    trees = packed.select("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x"), *(F.col(f"nodes.{c}").alias(c) for c in fields))
    empty = [F.lit(None).cast(dict(trees.dtypes)[c]).alias(c) for c in fields]
    told = asked.select("scenario_id", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "x", *empty)
    keys = ["scenario_id", "chunk", "kind"]
    met = trees.withColumn("known", F.lit(False)).unionByName(told).repartition("scenario_id", "chunk").sortWithinPartitions(*keys)

    def run(batches):
        of, forest = None, []
        for pdf in batches:
            for (name, chunk, kind), part in pdf.groupby(keys, sort=False):
                if (name, chunk) != of:
                    of, forest = (name, chunk), []
                if kind == 0:
                    forest += [tuple(np.asarray(getattr(r, c)) for c in fields) for r in part.itertuples(index=False)]
                elif forest:
                    x = np.stack(part["x"].to_numpy()).astype(np.float64)
                    total = np.zeros(len(x))
                    for left, right, feature, limit, value in forest:
                        total += value[routed(x, left, right, feature, limit, len(left))]
                    yield pd.DataFrame({"scenario_id": name, "_known": part["known"], "_id": part["id"].astype(np.int64), "predicted": total / len(forest)})

    scores = met.mapInPandas(run, "scenario_id string, _known boolean, _id long, predicted double")
    scores = scores.select(F.col("scenario_id").alias("_scenario"), F.when(F.col("_known"), F.col("_id")).alias("_id"), "predicted")
    return rows.drop("predicted").join(scores, (rows["scenario_id"] == F.col("_scenario")) & rows["id"].eqNullSafe(F.col("_id")), "left").drop("_scenario", "_id")
