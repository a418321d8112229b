"""Importance resampling towards a target distribution of hashed n-grams, with exact top-share selection.

Bucket counts of both tables give each bucket a gain; a document's weight is the sum of its features' gains, read from an
array. Random noise of each id makes the highest scores a sample without replacement. The cutoff is bracketed by a quantile
sketch; exact counts outside the bracket confirm that it holds the cutoff, or it is widened; only the bracket is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise

BUCKETS, WIDTH, SEED = 10_000, 1, 2024
#: Per cent of the documents of ``LEAST_WORDS`` or more that are drawn.
SHARE, LEAST_WORDS = 10, 20
#: Ranks of the sketch are exact to one in this many; the bracket's first half-width, in these steps.
ACCURACY, STEPS = 10_000, 2
#: Bytes whose words are held at once.
BLOCK = 1 << 20

#: ASCII characters that are no words' part, as blanks, and A-Z lower-cased; all other characters belong to words.
WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words(text: str | None) -> Iterator[list[bytes]]:
    """A text's words, in lists of about ``BLOCK`` bytes."""
    data, at = (text or "").encode().translate(WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK) if len(data) - at > BLOCK else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(text: str | None, width: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of a text, block by block."""
    tail: list[bytes] = []
    for held in words(text):
        joined = tail + held
        hashes = [zlib.crc32(w) for w in held]
        for n in range(2, width + 1):
            hashes += [zlib.crc32(b" ".join(joined[k - n : k])) for k in range(max(n, len(tail) + 1), len(joined) + 1)]
        tail = joined[len(joined) - width + 1 :] if width > 1 else []
        yield len(held), np.fromiter(hashes, np.int64, len(hashes)) % buckets


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one number a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                for _, at in features(text, width, buckets):
                    total += np.bincount(at, minlength=buckets)
        here = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": here.astype(np.int32), "n": total[here]})

    cells = bounded_batches(texts).select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in cells.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target is than the source to fill a bucket, rounded down; each
    bucket counts one more."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on the seed and the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Documents with a struct ``_weight``: n_words, n_features, weight (the sum of the features' gains) and score (with noise)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def scored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            counted = count = total = 0
            for n, at in features(text, width, len(held.value)):
                counted, count, total = counted + n, count + len(at), total + int(held.value[at].sum())
            rows.append((counted, count, total))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    out = bounded_batches(docs).withColumn("_weight", scored("text"))
    return out.withColumn("_weight", F.struct("_weight.*", (F.col("_weight.weight") + noise(F.col("doc_id"), seed)).alias("score")))


def ranked(rows: DataFrame, to: str = "rank") -> DataFrame:
    """``rows`` (score, doc_id, ...) with ranks from 1: highest scores first, ties to the smaller doc_id. Spark sorts by ranges,
    so a rank is a place inside a range plus the rows of the ranges before; no task sorts all."""
    place = materialise(rows.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for row in place.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        before.append((row.part, total))
        total += row["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    met = place.withColumn("_part", part).join(starts, "_part")
    return met.withColumn(to, F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def cutoff(rows: DataFrame, count: int, total: int, accuracy: int = ACCURACY, steps: int = STEPS) -> tuple[int, int | None] | None:
    """(score, doc_id) of the row of rank ``count`` among ``total`` rows (doc_id, score). None if count is 0."""
    if count < 1:
        return None
    while True:
        half = steps / accuracy
        sides = [min(1.0, max(0.0, 1 - count / total + s * half)) for s in (-1, 1)]
        low, high = rows.agg(F.percentile_approx("score", sides, accuracy)).first()[0]
        low, high = -(1 << 62) if sides[0] == 0 else low, 1 << 62 if sides[1] == 1 else high
        above, held = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < count <= above + held:
            inside = ranked(rows.where(F.col("score").between(low, high)))
            row = inside.where(F.col("rank") == count - above).first()
            return row.score, row.doc_id
        steps = max(1, 4 * steps)


def draw(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document (and the columns in ``keep``); undrawn ones have no rank.

    Of the N documents with ``least_words`` words or more, floor(share * N / 100) are drawn: the highest scores, ties to the
    smaller doc_id. ``target`` holds texts of the wanted kind. Null and empty texts have no features and a weight of 0. Rows
    that share a doc_id count each, with the same noise; a null doc_id has the noise of an empty name and comes last among
    ties. An empty table draws nothing, an empty target weighs against common words only. All texts are read twice, whole;
    what is sorted is a row of numbers for each drawn document.
    """
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    scored = weigh(docs.select("doc_id", "text", *keep), gain, width, seed).select("doc_id", *keep, "_weight.*")
    scored = materialise(scored, "weights")
    able = F.col("n_words") >= least_words
    rows = scored.where(able).select("doc_id", "score")
    total = rows.count()
    last = cutoff(rows, share * total // 100, total)
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("n_words")
    score, doc_id = last
    tie = F.col("doc_id") <= doc_id if doc_id is not None else F.lit(True)
    drawn = able & ((F.col("score") > score) | ((F.col("score") == score) & F.coalesce(tie, F.lit(False))))
    order = ranked(scored.where(drawn))
    # rows alike in score and id, at the cutoff, may be more than are drawn
    order = order.withColumn("rank", F.when(F.col("rank") <= share * total // 100, F.col("rank")))
    return order.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")
