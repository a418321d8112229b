"""Column functions that keep missing, infinite and constant values from stopping or poisoning a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """A double, or null if it is no number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def varies(c: Column | str) -> Column:
    """Aggregate: whether a column has two values that differ; null without any. The variance does not tell: it is summed by
    partitions, whose means of one and the same value differ in the last place."""
    return F.min(c) < F.max(c)


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns over the rows that have both; null if either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when(varies(x) & varies(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def mean_squared_error(a: str, b: str) -> Column:
    return F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))


def share(value: Column, total: Column) -> Column:
    """value / total, null if total is 0."""
    return F.try_divide(value, total)


def padded(start: Column, end: Column, by: int) -> tuple[Column, Column]:
    """A region widened on both sides, rounded half to even, not below 0."""
    low = F.greatest(F.bround(start.cast("double") - by), F.lit(0.0)).cast("long")
    return low, F.bround(end.cast("double") + by).cast("long")


def hashed_order(*keys: Column | str) -> Column:
    """A reproducible shuffle: the md5 of the keys, whatever the engine and the partitions."""
    return F.md5(F.concat_ws(":", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def whole(x: str) -> Column:
    """Whether an array column is there and holds no null."""
    return F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())


def stacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow batch are whole (see ``whole``), and those as a matrix."""
    there = np.array([v is not None and not np.isnan(np.asarray(v, np.float64)).any() for v in vectors], bool)
    return there, np.stack(vectors[there].to_numpy()).astype(np.float64) if there.any() else np.zeros((0, 0))
