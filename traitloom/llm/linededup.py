"""Removal of lines that recur across documents, through a sharded minimal perfect hash.

The distinct hashes of recurring lines are dealt to shards. A shard is a minimal perfect hash whose index points into
compact arrays: the line's hash as fingerprint, its document count and the document that keeps it. Documents look
their lines up in the arrays, so lines are never joined with lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise
from traitloom.llm.mphf import PerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of one shard, on average.
SHARD_KEYS = 1 << 18
#: Recurring lines whose arrays (under 24 bytes each) are broadcast; with more, look-ups are sent to the shards.
BROADCAST_KEYS = 2_000_000
BLANK = " \t\n\x0b\x0c\r"
INDEX = "shard int, sizes binary, words binary, prints binary, counts binary, keepers binary"


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Distinct hashes (XXH64, seed 42) of a text's line keys of at least ``min_chars`` code points."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(F.btrim(x, F.lit(BLANK)), upper, upper.lower())
    )
    return F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), lambda k: F.xxhash64(k)))


def _hash(line: str, min_chars: int) -> int | None:
    key = line.strip(BLANK)
    return xxhash.xxh64_intdigest(key.encode().lower(), 42) if len(key) >= min_chars else None


def recurring_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """hash, count (rows holding the line) and keeper (largest doc_id) of lines in at least ``min_docs`` rows."""
    lines = docs.select("doc_id", F.explode(line_hashes(F.col("text"), min_chars)).alias("hash"))
    counted = lines.groupBy("hash").agg(F.count("*").alias("count"), F.max("doc_id").alias("keeper"))
    return counted.where((F.col("count") >= min_docs) & F.col("keeper").isNotNull())


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row of arrays a shard."""

    def build(key, pdf):
        hashes = pdf["hash"].to_numpy(np.int64).view(np.uint64)
        perfect = PerfectHash.build(hashes)
        at = perfect.index(hashes)
        arrays = [np.empty(len(at), t) for t in (np.uint64, np.uint32, np.int64)]
        for array, values in zip(arrays, (hashes, np.minimum(pdf["count"], 2**32 - 1), pdf["keeper"])):
            array[at] = values
        return pd.DataFrame([[key[0], perfect.sizes.tobytes(), perfect.words.tobytes(), *(a.tobytes() for a in arrays)]])

    shard = F.pmod(F.shiftrightunsigned("hash", 40), F.lit(shards)).cast("int")
    return lines.groupBy(shard.alias("shard")).applyInPandas(build, INDEX)


class Shard:
    def __init__(self, row):
        self.perfect = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.keepers = np.frombuffer(row["keepers"], np.int64)

    def drops(self, hashes: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether a document loses the line; ``known`` is false where the doc_id is null."""
        at = self.perfect.index(hashes)
        hit = np.flatnonzero(at >= 0)
        hit = hit[self.prints[at[hit]] == hashes[hit]]
        out = np.zeros(len(hashes), bool)
        out[hit] = (self.counts[at[hit]] >= min_docs) & ~(known[hit] & (self.keepers[at[hit]] == doc_ids[hit]))
        return out


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


#: pandas has no null integers: an id travels as a number and whether it is one.
ID, KNOWN = "coalesce(doc_id, 0L)", "doc_id IS NOT NULL"


RESULT = "text string, n_lines long, n_dropped long"


def _rewrite(texts: pd.Series, min_chars: int, decide) -> pd.DataFrame:
    """``decide(row numbers, hashes)`` says which of a batch's long lines go."""
    split = [(t or "").split("\n") for t in texts]
    where = [(i, k, h) for i, lines in enumerate(split) for k, x in enumerate(lines) if (h := _hash(x, min_chars)) is not None]
    rows, places, hashes = (np.array([w[n] for w in where], t) for n, t in ((0, np.int64), (1, np.int64), (2, np.uint64)))
    gone: dict[int, set[int]] = {}
    for i in np.flatnonzero(decide(rows, hashes)):
        gone.setdefault(int(rows[i]), set()).add(int(places[i]))
    kept = ["\n".join(x for k, x in enumerate(lines) if k not in gone[i]) if i in gone else "\n".join(lines) for i, lines in enumerate(split)]
    return pd.DataFrame({"text": kept, "n_lines": [len(x) for x in split], "n_dropped": [len(gone.get(i, ())) for i in range(len(split))]})


def _with_broadcast(docs, index, shards, min_chars, min_docs):
    held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])
    open_shards: dict[int, Shard] = {}

    @F.pandas_udf(RESULT)
    def rewrite(doc_ids: pd.Series, known: pd.Series, texts: pd.Series) -> pd.DataFrame:
        if not open_shards:
            open_shards.update((r["shard"], Shard(r)) for r in held.value)
        ids, known = doc_ids.to_numpy(np.int64), known.to_numpy(bool)

        def decide(rows, hashes):
            out, shard = np.zeros(len(rows), bool), _shard_of(hashes, shards)
            for s in np.unique(shard):
                if s in open_shards:
                    mine = np.flatnonzero(shard == s)
                    out[mine] = open_shards[s].drops(hashes[mine], ids[rows[mine]], known[rows[mine]], min_docs)
            return out

        return _rewrite(texts, min_chars, decide)

    return docs.withColumn("_deduped", rewrite(F.expr(ID), F.expr(KNOWN), F.col("text")))


def _with_routing(docs, index, shards, min_chars, min_docs):
    """Look-ups travel to the shard's arrays, eight copies of each so that a hot line meets several tasks."""
    copies = 8
    asked = docs.select("doc_id", F.explode(line_hashes(F.col("text"), min_chars)).alias("hash")).distinct()
    asked = asked.select(
        F.pmod(F.shiftrightunsigned("hash", 40), F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id"), F.lit(copies)).cast("int").alias("copy"),
        F.lit(1).alias("turn"),
        F.expr(ID).alias("doc_id"),
        F.expr(KNOWN).alias("known"),
        "hash",
    )
    none = F.lit(0).cast("long")
    arrays = index.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.lit(0).alias("turn"),
        none.alias("doc_id"),
        F.lit(False).alias("known"),
        none.alias("hash"),
    )
    met = arrays.unionByName(asked, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "turn")

    def look_up(batches):
        shard = None
        for pdf in batches:
            for (number, _, turn), part in pdf.groupby(["shard", "copy", "turn"], sort=False):
                if turn == 0:
                    shard = (number, Shard(part.iloc[0]))
                elif shard and shard[0] == number:
                    hashes, ids = part["hash"].to_numpy(np.int64).view(np.uint64), part["doc_id"].to_numpy(np.int64)
                    out = shard[1].drops(hashes, ids, part["known"].to_numpy(bool), min_docs)
                    yield part.loc[out, ["doc_id", "known", "hash"]]

    lost = met.mapInPandas(look_up, "doc_id long, known boolean, hash long")
    lost = lost.groupBy(F.when(F.col("known"), F.col("doc_id")).alias("doc_id")).agg(F.collect_set("hash").alias("_lost"))

    @F.pandas_udf(RESULT)
    def rewrite(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        sets = [set() if x is None else {int(h) & (2**64 - 1) for h in x} for x in lost]
        return _rewrite(texts, min_chars, lambda rows, hashes: np.array([int(h) in sets[i] for i, h in zip(rows, hashes)], bool))

    joined = docs.alias("d").join(lost.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("_deduped", rewrite("text", "_lost")).select("d.*", "_deduped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents with recurring lines removed, in a struct column ``_deduped`` (text, n_lines, n_dropped).

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of ``min_chars`` code points or more
    that ``min_docs`` rows or more hold are removed everywhere but in the largest doc_id holding them (there every
    repeat stays). Null and empty texts are one empty line. Rows that share a doc_id each count and decide alike; a
    null doc_id never keeps a recurring line, and lines held only by null ids stay. All columns are passed through,
    whatever their names (``_deduped`` is replaced); an empty table gives no rows.
    """
    lines = materialise(recurring_lines(bounded_batches(docs), min_chars, min_docs), "lines")
    count = lines.count()
    shards = max(1, -(-count // SHARD_KEYS))
    index = build_index(lines, shards)
    way = _with_broadcast if count <= BROADCAST_KEYS else _with_routing
    return way(docs, index, shards, min_chars, min_docs)
