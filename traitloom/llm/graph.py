"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import forget, materialise


def _star(pairs: DataFrame) -> DataFrame:
    """(node, near) rows joined with the smallest id among the node and its neighbours."""
    low = pairs.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("low"))
    return pairs.join(low, "node")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    large = _star(both).where("near > node").select(F.col("near").alias("node"), F.col("low").alias("near"))
    small = _star(large.where("node <> near").distinct())
    out = small.select(F.col("near").alias("a"), F.col("low").alias("b")).unionByName(
        small.select(F.col("node").alias("a"), F.col("low").alias("b"))
    )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has a link.

    ``edges``: long columns a, b, in any direction, repeats and self-links allowed. Rows with a null end are
    ignored. Returns (node, root) for all nodes but the roots themselves; an empty edge table gives no rows.
    Each round is written to the shared folder, so its lineage is one read, and the round before is deleted.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
        before, edges = edges, materialise(_round(edges), "edges")
        forget(before)
