"""Marker matrices as tables: scaling, Gram matrices, distances, kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions import varies, whole
from traitloom.session import bounded_batches, materialise


def standardise(geno: DataFrame, by: list[str]) -> DataFrame:
    """``z``: dosage minus its mean, over its standard deviation (n - 1) and the root of the number of markers; -1 for a
    constant marker, or a null dosage. Repeated rows count each; other columns are passed on (``z`` is replaced)."""
    stats = geno.groupBy(*by, "marker").agg(F.avg("dosage").alias("_m"), F.when(varies("dosage"), F.stddev_samp("dosage")).alias("_s"))
    p = geno.groupBy(*by).agg(F.countDistinct("marker").alias("_p"))
    z = F.coalesce(F.try_divide(F.col("dosage") - F.col("_m"), F.col("_s")) / F.sqrt("_p"), F.lit(-1.0))
    return geno.join(stats.join(p, by), [*by, "marker"]).withColumn("z", z).drop("_m", "_s", "_p")


def vectors(geno: DataFrame, value: str = "dosage", to: str = "x", keys: list[str] | None = None) -> DataFrame:
    """One row an individual, its values in marker order as an array. Of repeated markers of an individual the least value
    stays; nulls stay nulls; other columns are left out."""
    return vector_columns(geno, {to: value}, keys or ["id", "population"])


def vector_columns(geno: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """As ``vectors``, several values at once: names of the arrays to names of the values, the first of which decides between
    repeated markers."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", *(F.col(v).cast("double").alias(f"v{n}") for n, v in enumerate(columns.values())))))
    new = lambda cell, at: (at == 0) | (cell["pos"] != F.get("_p", at - 1)["pos"])
    rows = geno.groupBy(*keys).agg(pairs.alias("_p")).withColumn("_p", F.filter("_p", new))
    return rows.select(*keys, *(F.col(f"_p.v{n}").alias(to) for n, to in enumerate(columns)))


#: Cells of partial matrices that a task holds before it sends them on.
HELD_CELLS = 1 << 24


def gram(rows: DataFrame, key: str, column: str = "x") -> DataFrame:
    """(key, i, j, v), i <= j: the sum of x_i * x_j over the key's rows, whose vectors are of one length.

    Each task adds its rows up in blocks and sends one number a cell, so what is shuffled does not grow with the rows. Rows with
    a null key, or a null in or for the vector, are left out; repeated rows count each; other columns are left out.
    """

    def partial(batches):
        held: dict = {}

        def flush():
            for k, m in held.items():
                i, j = np.triu_indices(len(m))
                yield pd.DataFrame({key: k, "i": i.astype(np.int32), "j": j.astype(np.int32), "v": m[i, j]})
            held.clear()

        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False):
                x = np.stack(part[column].to_numpy())
                held[k] = held.get(k, 0) + x.T @ x
            if sum(m.size for m in held.values()) > HELD_CELLS:
                yield from flush()
        yield from flush()

    kind = rows.schema[key].dataType.simpleString()
    cells = rows.where(F.col(key).isNotNull() & whole(column)).select(key, column).mapInPandas(partial, f"{key} {kind}, i int, j int, v double")
    return cells.groupBy(key, "i", "j").agg(F.sum("v").alias("v"))


#: Individuals of a block at least, and cells of its vectors at most; a task compares two blocks and sends on ``TILE`` pairs at once.
#: A group has ``SPLIT`` blocks, if it has so many individuals; more only if its cells ask for them.
BLOCK, CELLS, TILE, SPLIT = 256, 1 << 20, 1 << 18, 8


def distances(geno: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, d), i <= j: squared Euclidean distance of individuals over their markers.

    All individuals of a group have the same markers; those with a null dosage are left out, and so is a null id or group; an id
    that two groups hold is an individual of each. They are dealt to blocks, and every two blocks meet in one task as matrices:
    an individual's vector travels once for each block, not its every dosage once for each other individual, and the pairs
    leave the task as they come. The vectors are written once.
    """
    return _compared(geno, by, "d", None)


def kernel_pairs(geno: DataFrame, by: list[str], h: float = 1.0) -> DataFrame:
    """(by, i, j, k), i <= j: as ``gaussian_kernel`` of ``distances``, which no pair is moved for: the mean distance of all cells
    is twice the sum of the markers' variances."""
    return _compared(geno, by, "k", h)


def _compared(geno: DataFrame, by: list[str], name: str, h: float | None) -> DataFrame:
    found = vectors(geno.dropna(subset=["id", *by]), keys=["id", *by]).where(whole("x"))
    rows = materialise(found.select("id", "x", *(F.col(c).alias(f"_{n}") for n, c in enumerate(by))), "vectors")
    keys = [f"_{n}" for n in range(len(by))]
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.size("x")).alias("_p"))
    told = size.select(*keys, F.greatest(F.ceil(F.col("_n") * F.col("_p") / CELLS), F.least(F.ceil(F.col("_n") / BLOCK), F.lit(SPLIT)), F.lit(1)).cast("int").alias("_blocks"))
    pairs = told.agg(F.sum(F.expr("bigint(_blocks) * (_blocks + 1) div 2"))).first()[0] or 1
    if h is not None:
        spread = rows.select(*keys, F.posexplode("x").alias("pos", "v")).groupBy(*keys, "pos").agg(F.when(varies("v"), F.var_pop("v")).alias("v"))
        told = told.join(spread.groupBy(*keys).agg((2 * F.coalesce(F.sum("v"), F.lit(0.0))).alias("_mean")), keys, "left")
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    met = rows.join(told, keys).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other")).drop("_other", "_blocks")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, one = pa.Table.from_batches(batches), key[-2].equals(key[-1])
        ids, own_ = rows_["id"].to_numpy().astype(np.int64), rows_["_own"].to_numpy()
        x = rows_["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if one:
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            i, j, a, b = ids, ids, x, x
        else:
            first = own_ == key[-2].as_py()
            i, j, a, b = ids[first], ids[~first], x[first], x[~first]
        mean = (rows_["_mean"][0].as_py() or 0.0) if h is not None else None
        aa, bb, step = (a * a).sum(1), (b * b).sum(1), max(1, TILE // max(len(j), 1))
        for at in range(0, len(i), step):
            left = i[at : at + step, None]
            from_ = at if one else 0
            right = j[None, from_:]
            value = np.maximum(aa[at : at + step, None] + bb[None, from_:] - 2 * a[at : at + step] @ b[from_:].T, 0)
            if mean is not None:
                value = np.exp(value * (-h / mean)) if mean > 0 else np.ones(value.shape)
            use = left <= right if one else np.ones(value.shape, bool)
            low, high = np.minimum(left, right)[use], np.maximum(left, right)[use]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(low)) for k in key[: len(by)]), pa.array(low), pa.array(high), pa.array(value[use])], names=[*by, "i", "j", name])

    kinds = "".join(f"{c} {geno.schema[c].dataType.simpleString()}, " for c in by)
    dealt = bounded_batches(met).repartition(min(2 * pairs, 10_000), *keys, "_a", "_b")
    return dealt.groupBy(*keys, "_a", "_b").applyInArrow(compare, f"{kinds}i long, j long, {name} double")


def gaussian_kernel(pairs: DataFrame, by: list[str], h: float = 1.0) -> DataFrame:
    """``k``: exp(-h d / mean(d)) of ``distances``; the mean is over all n * n cells. With a mean of 0 all individuals are alike:
    k = 1. Other columns are passed on (``k`` is replaced)."""
    total = pairs.groupBy(*by).agg(
        F.sum(F.when(F.col("i") < F.col("j"), 2 * F.col("d")).otherwise(0.0)).alias("all_"), F.count_if(F.col("i") == F.col("j")).alias("n")
    )
    mean = F.col("all_") / (F.col("n") * F.col("n"))
    return pairs.join(total, by).withColumn("k", F.exp(-h * F.coalesce(F.try_divide("d", mean), F.lit(0.0)))).drop("all_", "n")


def gamma_scale(geno: DataFrame, by: list[str]) -> DataFrame:
    """Kernel width 1 / (markers * variance of all dosages), null without variance; null dosages count nothing."""
    out = geno.groupBy(*by).agg(F.countDistinct("marker").alias("p"), F.when(varies("dosage"), F.var_pop("dosage")).alias("v"))
    return out.select(*by, F.try_divide(F.lit(1.0), F.col("p") * F.col("v")).alias("gamma"))
