"""Explanations of any fitted model: Shapley values, integrated gradients, and attention sums over edges."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions import elu, stacked, whole


def linear_shapley(geno: DataFrame, effects: DataFrame, by: list[str]) -> DataFrame:
    """Exact values of a linear model: effect * (dosage - its mean in the group). Markers without an effect are left out, null
    dosages give null; ``phi`` is replaced, other columns are passed on."""
    means = geno.groupBy(*by, "marker").agg(F.avg("dosage").alias("_m"))
    return geno.join(means, [*by, "marker"]).join(effects.select("marker", "effect"), "marker").withColumn("phi", F.col("effect") * (F.col("dosage") - F.col("_m"))).drop("_m", "effect")


#: Cells of the instances that are scored at once.
CELLS = 1 << 21


def sampled_shapley(rows: DataFrame, background: DataFrame, forward: Callable[[np.ndarray, tuple], np.ndarray], width: int, permutations: int, by: list[str]) -> DataFrame:
    """Sampled Shapley values: (by, id, pos, phi).

    ``rows`` and ``background`` (a bounded sample of each group) hold ``by``, ``id`` and ``x``. For each row, background
    row and permutation (the markers in the order of a hash of marker and permutation) the markers are switched over one
    after another, each instance from the one before, and the change of the score is the marker's value; all are
    averaged. ``forward`` scores a matrix of instances, given the row's ``by`` values. Groups without background rows give
    nothing; repeated rows share their values; a null in or for x is left out.
    """
    orders = [np.array(sorted(range(width), key=lambda pos: hashlib.md5(f"{pos}:{k}".encode()).digest())) for k in range(permutations)]
    z = background.where(whole("x")).select(*by, F.col("x").alias("z"))
    asked = rows.where(whole("x")).select(*by, "id", "x")
    met = asked.join(z, by) if by else asked.withColumn("_", F.lit(0)).join(z.withColumn("_", F.lit(0)), "_").drop("_")

    def values(x, z, key):
        phi = np.zeros(width)
        for order in orders:
            rank = np.empty(width, np.int64)
            rank[order] = np.arange(width)
            step, last = max(1, CELLS // width), None
            for at in range(0, width + 1, step):
                turn = np.arange(at, min(at + step, width + 1))
                score = forward(np.where(rank[None, :] < turn[:, None], x, z), key)
                scores = score if last is None else np.append(last, score)
                done = np.arange(at if last is None else at - 1, at + len(turn) - 1)
                phi[order[done]] += np.diff(scores)
                last = score[-1]
        return phi / permutations

    def walk(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(row[: len(by)])
                phi = values(np.asarray(row.x, np.float64), np.asarray(row.z, np.float64), key)
                yield pd.DataFrame({**dict(zip(by, key)), "id": row.id, "pos": np.arange(width, dtype=np.int32), "phi": phi})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, "id"])
    return met.mapInPandas(walk, f"{kinds}, pos int, phi double").groupBy(*by, "id", "pos").agg(F.avg("phi").alias("phi"))


def integrated_gradients(rows: DataFrame, gradient: Callable[[str], Column], baseline: Column, steps: int, by: list[str]) -> DataFrame:
    """(by, id, pos, phi): (x - baseline) times the mean gradient at the middles of ``steps`` parts of the way. A null in or for
    x is left out; rows that share by and id share their values; other columns are left out."""
    way = rows.where(whole("x")).select(*by, "id", "x", baseline.alias("x0")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at = way.withColumn("at", F.zip_with("x", "x0", lambda a, b: b + (a - b) * (F.col("step") - 0.5) / steps))
    cells = at.select(*by, "id", F.posexplode(F.zip_with(gradient("at"), F.zip_with("x", "x0", lambda a, b: a - b), lambda g, d: g * d)).alias("pos", "part"))
    return cells.groupBy(*by, "id", "pos").agg(F.avg("part").alias("phi"))


def network_gradient(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray) -> Callable[[str], Column]:
    """Gradient of w2 . relu(w1 x + b1) with respect to x, as an array; null where x is not whole."""

    @F.pandas_udf("array<double>")
    def gradient(rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype=object)
        there, x = stacked(rows)
        for at, g in zip(np.flatnonzero(there), ((x @ w1.T + b1 > 0) * w2) @ w1 if there.any() else []):
            out.iat[at] = g
        return out

    return lambda x: gradient(x)


def rescaled_attributions(rows: DataFrame, background: DataFrame, models: dict, by: list[str]) -> DataFrame:
    """(by, id, pos, phi): layer-wise attributions of one-layer networks against background rows, in one pass.

    A hidden unit's share of the output goes to the markers in proportion to their part of the change of its input: its
    multiplier is the change of the rectifier over that change (its slope where nothing changes), and a marker's value is
    the sum over units of weight times multiplier times the marker's own change, averaged over the background rows. The
    values of a row add up to its score less the mean score of the background. ``rows`` and ``background`` (a bounded sample
    of each group, which the driver sends to the tasks) hold ``by``, ``id`` and ``x``; ``models`` are ``gradient.Network`` by
    the first column of ``by`` (one under None where ``by`` is empty). Groups without background rows or model give nothing;
    a null in or for x is left out; repeated rows count each.
    """
    held = {}
    for row in background.where(whole("x")).select(*by, "x").collect():
        held.setdefault(tuple(row)[: len(by)], []).append(row.x)
    sent = rows.sparkSession.sparkContext.broadcast(({k: np.array(v) for k, v in held.items()}, models))

    def values(x: np.ndarray, z: np.ndarray, net) -> np.ndarray:
        inner, base = x @ net.w1.T + net.b1, z @ net.w1.T + net.b1
        out = np.zeros(x.shape)
        for at in range(len(z)):
            change = inner - base[at]
            same = np.abs(change) < 1e-12
            lifted = np.maximum(inner, 0) - np.maximum(base[at], 0)
            multiplier = np.where(same, (inner > 0).astype(float), lifted / np.where(same, 1.0, change))
            out += ((multiplier * net.w2) @ net.w1) * (x - z[at])
        return out / len(z)

    def explain(batches):
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                z, net = sent.value[0].get(tuple(key)), sent.value[1].get(key[0] if by else None)
                if z is None or net is None:
                    continue
                phi = values(np.stack(part["x"].to_numpy()).astype(np.float64), z, net)
                n, width = phi.shape
                out = pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), width), "pos": np.tile(np.arange(width, dtype=np.int32), n), "phi": phi.ravel()})
                yield out.assign(**dict(zip(by, key)))[[*by, "id", "pos", "phi"]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, "id"])
    return rows.where(whole("x")).select(*by, "id", "x").mapInPandas(explain, f"{kinds}, pos int, phi double")


def attention_scores(edges: DataFrame, slope: float = 0.2) -> DataFrame:
    """``edges`` with ``score``: the leaky rectifier of the sum of what source and target bring (``from_src``, ``from_dst``). Null
    where either is; other columns are passed on (``score`` is replaced)."""
    raw = F.col("from_src") + F.col("from_dst")
    return edges.withColumn("score", F.when(raw > 0, raw).otherwise(slope * raw))


def decoded(nodes: DataFrame, bias: float = 0.0) -> DataFrame:
    """(graph, predicted): mean of the exponential-linear units of a graph's nodes (graph, h), plus a bias. Null h is left out."""
    return nodes.groupBy("graph").agg((F.avg(elu(F.col("h"))) + bias).alias("predicted"))


def attention_sum(edges: DataFrame, skip: DataFrame) -> DataFrame:
    """(dst, h): for each relation the softmax-weighted sum of its messages into ``dst``, added up, plus the node's skip.

    ``edges``: relation, src, dst, score, message; ``skip``: dst, skip. Nodes without edges keep their skip, edges into nodes
    that ``skip`` lacks are left out; repeated edges count each, edges without a score or message nothing.
    """
    top = edges.groupBy("relation", "dst").agg(F.max("score").alias("_top"))
    weight = F.exp(F.col("score") - F.col("_top"))
    each = edges.join(top, ["relation", "dst"]).groupBy("relation", "dst").agg((F.sum(weight * F.col("message")) / F.sum(weight)).alias("h"))
    total = each.groupBy("dst").agg(F.sum("h").alias("h"))
    return skip.join(total, "dst", "left").select("dst", (F.coalesce("h", F.lit(0.0)) + F.col("skip")).alias("h"))


# ---------------------------------------------------------------- attention over node vectors


def edge_scores(edges: DataFrame, sources: DataFrame, targets: DataFrame, weights: DataFrame, slope: float = 0.2) -> DataFrame:
    """(relation, src, dst, head, score, message): scores a . leaky(W_src h_src + W_dst h_dst) of every edge and head, and the
    messages W_src h_src.

    ``edges``: relation, src, dst; ``sources`` and ``targets``: node and its vector h; ``weights``: a row a relation and head
    with w_src and w_dst (arrays of rows) and a. A source's and a target's products are made once a node, not once an edge.
    Repeated edges count each; edges of nodes without a vector, or of relations without weights, are left out.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    heads = F.broadcast(weights.select("relation", "head", "w_src", "w_dst", "a"))  # a row a relation and head

    def turned(nodes: DataFrame, side: str, to: str) -> DataFrame:
        there = edges.select("relation", F.col(side).alias("node")).distinct()
        met = nodes.where(whole("h")).select("node", "h").join(there, "node").join(heads, "relation")
        return met.select("relation", "head", F.col("node").alias(side), F.transform(f"w_{side}", lambda w: dot(w, F.col("h"))).alias(to))

    met = edges.select("relation", "src", "dst").join(turned(sources, "src", "message"), ["relation", "src"]).join(turned(targets, "dst", "_to"), ["relation", "dst", "head"])
    leaky = F.transform(F.zip_with("message", "_to", lambda x, y: x + y), lambda v: F.when(v > 0, v).otherwise(slope * v))
    scored = met.join(heads.select("relation", "head", "a"), ["relation", "head"])
    return scored.select("relation", "src", "dst", "head", dot(leaky, F.col("a")).alias("score"), "message")


#: Salts that a node's incoming edges are dealt to.
SALTS = 16


def attention_messages(scored: DataFrame) -> DataFrame:
    """(relation, dst, head, h): softmax-weighted sums of the messages, a vector each.

    The weights are relative to the largest score of the target; both it and the sums are taken first in ``SALTS`` parts of a
    target's edges, dealt by their source, so a target of very many edges is no one task's."""
    keys = ["relation", "dst", "head"]
    salt = F.pmod(F.xxhash64("src"), F.lit(SALTS)).alias("_salt")
    top = scored.groupBy(*keys, salt).agg(F.max("score").alias("_top")).groupBy(*keys).agg(F.max("_top").alias("_top"))
    weighed = scored.where("score IS NOT NULL AND message IS NOT NULL").join(top, keys).withColumn("_w", F.exp(F.col("score") - F.col("_top")))
    cells = weighed.select(*keys, salt, "_w", F.posexplode("message").alias("k", "v"))
    parts = cells.groupBy(*keys, "_salt", "k").agg(F.sum(F.col("_w") * F.col("v")).alias("v"), F.sum("_w").alias("w"))
    sums = parts.groupBy(*keys, "k").agg((F.sum("v") / F.sum("w")).alias("v"))
    return sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_h")).select(*keys, F.col("_h.v").alias("h"))


def attention_layer(edges: DataFrame, sources: DataFrame, targets: DataFrame, weights: DataFrame, skip: list[list[float]], concat: bool = True, active: bool = True, slope: float = 0.2) -> DataFrame:
    """(node, h): one attention layer into the targets. Heads are joined behind one another in their order (or averaged),
    relations are summed, the target's own vector comes on top through the matrix ``skip``, and exponential-linear units
    follow (if ``active``). A target without edges keeps its skip alone; one without a vector is left out."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    heads = attention_messages(edge_scores(edges, sources, targets, weights, slope))
    cells = heads.select("dst", "relation", "head", F.posexplode("h").alias("k", "v"))
    if concat:
        cells = cells.groupBy("dst", "head", "k").agg(F.sum("v").alias("v"))
        order = F.struct("head", "k", "v")
    else:
        cells = cells.groupBy("dst", "relation", "k").agg(F.avg("v").alias("v")).groupBy("dst", "k").agg(F.sum("v").alias("v"))
        order = F.struct("k", "v")
    summed = cells.groupBy("dst").agg(F.array_sort(F.collect_list(order)).alias("_c")).select(F.col("dst").alias("node"), F.col("_c.v").alias("_h"))
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in skip))
    own = targets.where(whole("h")).select("node", F.transform(rows, lambda w: dot(w, F.col("h"))).alias("_own"))
    h = F.coalesce(add("_own", "_h"), F.col("_own"))
    h = F.transform(h, lambda v: F.when(v > 0, v).otherwise(F.expm1(v))) if active else h
    return own.join(summed, "node", "left").select("node", h.alias("h"))


def attribution_sums(phi: DataFrame, by: list[str]) -> DataFrame:
    """Sum of absolute values, and mean, over the explained rows; nulls count nothing."""
    return phi.groupBy(*by).agg(F.sum(F.abs("phi")).alias("effect"), F.avg("phi").alias("mean_phi"))
