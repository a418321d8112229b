"""Benchmark items found inside documents by size-partitioned MinHash and exact shingle containment.

Items are partitioned by their number of shingles: the class of width w holds those with more than w/2 and up to w.
For each class a document is cut into blocks of w shingles and every two neighbouring blocks are one window, so an
item that stands in a document lies whole in a window of comparable size and their Jaccard similarity stays near a
quarter or more, however long the document is. One equal minimum of ``PERMUTATIONS`` makes a candidate, which an exact
count of the item's shingles in the whole document then confirms or rejects.

An item of s shingles and class w that is scattered over a document shares s / (2w + s) or more minima a permutation,
summed over its windows, as one that stands in one piece does: with 32 permutations fewer than two in a thousand are
expected to be missed, 150 scattered ones are searched for in the tests.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches

from traitloom.llm.shingles import shingle_hashes

WIDTH, THRESHOLD, PERMUTATIONS = 5, 0.8, 32
#: Items, and bytes of their texts, that one pass over the documents holds (broadcast); more items take more passes.
ITEM_BLOCK, ITEM_BYTES = 20_000, 16_000_000
#: Shingles of the documents that are worked on at once.
CHUNK = 1 << 20
FOUND = "array<struct<item_id: long, n_shingles: int, n_found: int>>"

_FACTORS = np.random.default_rng(20_11).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class ItemIndex:
    """Signatures of one block of items: for each class and permutation the items' minima in order."""

    def __init__(self, ids: list, shingles: list[np.ndarray]):
        self.ids, self.sets = ids, [np.unique(s) for s in shingles]
        widths = np.array([1 << (len(s) - 1).bit_length() if len(s) else 0 for s in shingles])
        self.classes = []
        for width in sorted(set(widths) - {0}):
            members = np.flatnonzero(widths == width)
            minima = np.stack([[(self.sets[i] * f).min() for i in members] for f in _FACTORS])
            order = np.argsort(minima, axis=1)
            self.classes.append((int(width), members[order], np.take_along_axis(minima, order, axis=1)))

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs in which a window and an item share a minimum."""
        lengths = np.array([len(d) for d in docs])
        if not lengths.sum() or not self.classes:
            return set()
        flat, found = np.concatenate(docs), set()
        cuts = []
        finer, held = 1, lengths
        for width, _, _ in self.classes:
            # blocks of this class are runs of the finer class's blocks
            blocks = -(-held // (width // finer))
            owner = np.repeat(np.arange(len(docs)), blocks)
            nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = np.repeat(np.cumsum(held) - held, blocks) + nth * (width // finer)
            cuts.append((starts, owner))
            finer, held = width, blocks
        for k, factor in enumerate(_FACTORS):
            low = flat * factor
            for (starts, owner), (_, items, minima) in zip(cuts, self.classes):
                low = np.minimum.reduceat(low, starts)
                window = low.copy()
                same = owner[1:] == owner[:-1]
                window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                left = np.searchsorted(minima[k], window, "left")
                hit = np.flatnonzero(minima[k][np.minimum(left, len(minima[k]) - 1)] == window)
                for at in hit:
                    n = left[at]
                    while n < len(minima[k]) and minima[k][n] == window[at]:
                        found.add((int(owner[at]), int(items[k][n])))
                        n += 1
        return found

    def search(self, docs: list[np.ndarray], threshold: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in docs]
        for doc, item in sorted(self.candidates(docs)):
            wanted = self.sets[item]
            count = int(np.isin(wanted, docs[doc]).sum())
            if count >= threshold * len(wanted):
                out[doc].append({"item_id": self.ids[item], "n_shingles": len(wanted), "n_found": count})
        return out


def _blocks(items: DataFrame, width: int):
    """Indexes of the items, about ``ITEM_BLOCK`` items or ``ITEM_BYTES`` at most each; blank and null texts have no shingles and are left out."""

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_hashes(t, width).view(np.int64))

    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    count = max(1, -(-size[0] // ITEM_BLOCK), -(-(size[1] or 0) // ITEM_BYTES))
    for n in range(count):
        here = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == n)
        rows = here.select("item_id", hashed("text").alias("shingles")).where(F.size("shingles") > 0).collect()
        yield ItemIndex([r.item_id for r in rows], [np.array(r.shingles, np.int64).view(np.uint64) for r in rows])


def _finder(spark, index: ItemIndex, width: int, threshold: float):
    held = spark.sparkContext.broadcast(index)

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        out, docs, size = [], [], 0
        for text in texts:
            docs.append(shingle_hashes(text, width))
            size += len(docs[-1])
            if size > CHUNK:
                out += held.value.search(docs, threshold)
                docs, size = [], 0
        return pd.Series(out + held.value.search(docs, threshold), dtype=object)

    return find


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document row and item whose shingles are contained in it to ``threshold`` or more.

    Returns doc_id, item_id, n_shingles (distinct, of the item), n_found, containment. Shingles are runs of ``width``
    lower-cased (A-Z) words; a text with fewer words is one shingle. Null or blank texts match nothing. Repeated rows
    on either side each give their rows; null ids are passed on. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    parts = []
    for index in _blocks(items, width):
        find = _finder(spark, index, width, threshold)
        parts.append(bounded_batches(docs).select("doc_id", F.explode(find("text")).alias("hit")))
    return reduce(DataFrame.unionAll, parts).select("doc_id", "hit.*", (F.col("hit.n_found") / F.col("hit.n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, in which no item is contained to ``threshold`` or more."""
    for index in _blocks(items, width):
        docs = bounded_batches(docs).where(F.size(_finder(docs.sparkSession, index, width, threshold)("text")) == 0)
    return docs
