"""Document fingerprints by a randomised edit embedding.

A text is walked with randomness that all texts share: at step j the current character is emitted, and a coin for
(j, character) says whether to go on to the next one. Edits shift two walks only until they meet again, so edit distance
turns into Hamming distance between the emitted strings. The fingerprint samples the emitted string: each slot has a
random order of all steps and takes the first in that order that the walk reached, so walks of similar length sample
the same steps, however long they are. Four bits of the emitted character are kept a slot.
"""

from __future__ import annotations

import hashlib
import json
import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise

SLOTS, SLOT_BITS = 128, 4
#: Slots of a band at least and at most; unlike texts that share a band, on average, at most; recall of the bands at the bound.
BAND_SLOTS, WIDEST, STRANGERS, RECALL = 4, 16, 16, 0.98
#: Fingerprints, at most, by which the width of the bands is chosen.
JUDGED = 2048
#: Likeness of near texts, and of which documents (one in so many ids) the near ones are counted.
LIKENESS, ASKED_EVERY = 0.8, 100
#: Shared coins: classes of characters, and steps after which the coins repeat.
CLASSES, PERIOD = 256, 1 << 12
#: Longest walk that the slots' orders are laid out for.
LONGEST = 1 << 40
#: Chance that unlike characters leave equal bits.
CHANCE = 2.0**-SLOT_BITS
#: Code points that one batch of walks holds.
BATCH = 1 << 21


def _coins() -> np.ndarray:
    """How many steps a character of each class holds a walk that reaches it at each step."""
    go = np.random.default_rng(77).random((CLASSES, PERIOD)) < 0.5
    go[:, -1] = True
    held = np.empty((CLASSES, PERIOD), np.uint8)
    wait = np.ones(CLASSES, np.uint8)
    for step in range(PERIOD - 1, -1, -1):
        wait = np.where(go[:, step], 1, wait + 1).astype(np.uint8)
        held[:, step] = wait
    return held


def _orders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot the steps that are the first in its order up to there (records), as one sorted list."""
    draw = np.random.default_rng(78)
    slots, steps = [], []
    for slot in range(SLOTS):
        step, low = 0, draw.random()
        while step < LONGEST:
            slots.append(slot)
            steps.append(step)
            step += int(np.ceil(np.log(1 - draw.random()) / np.log1p(-low))) if low > 1e-12 else LONGEST
            low *= draw.random()
    order = np.argsort(steps, kind="stable")
    return np.array(slots)[order], np.array(steps)[order], draw.integers(1, 2**63, SLOTS, dtype=np.uint64) | np.uint64(1)


HELD = _coins()
RECORD_SLOT, RECORD_STEP, SALT = _orders()


def _walks(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The step at which each character is reached, for texts laid end to end."""
    reached = np.zeros(len(classes), np.int64)
    flat = HELD.ravel()
    order = np.argsort(-lengths, kind="stable")
    at, step = starts[order], np.zeros(len(order), np.int64)
    sizes = lengths[order]
    live = int(np.searchsorted(-sizes, 0, "left"))
    n = 0
    while live > 24:
        here = at[:live] + n
        reached[here] = step[:live]
        step[:live] += flat[(classes[here] << 12) + (step[:live] & (PERIOD - 1))]
        n += 1
        live = int(np.searchsorted(-sizes[:live], -n, "left"))
    rows = [bytes(r) for r in HELD]
    for k in range(live):  # the few longest, one by one
        rest = classes[at[k] + n : at[k] + sizes[k]].tolist()
        walk = accumulate(rest[:-1], lambda j, c: j + rows[c][j & (PERIOD - 1)], initial=int(step[k]))
        reached[at[k] + n : at[k] + sizes[k]] = np.fromiter(walk, np.int64, len(rest))
    return reached


def _batch(texts: list[str]) -> np.ndarray:
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, np.uint32)
    classes = ((flat * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    reached = _walks(classes, starts, lengths)
    prints = np.zeros((len(texts), SLOTS), np.uint8)
    for i in np.flatnonzero(lengths):
        own = reached[starts[i] : starts[i] + lengths[i]]
        last = int(own[-1]) + int(HELD[classes[starts[i] + lengths[i] - 1], own[-1] & (PERIOD - 1)])
        upto = int(np.searchsorted(RECORD_STEP, last, "left"))
        step = np.zeros(SLOTS, np.int64)
        step[RECORD_SLOT[:upto]] = RECORD_STEP[:upto]  # later records replace earlier ones
        char = flat[starts[i] + np.searchsorted(own, step, "right") - 1].astype(np.uint64)
        prints[i] = ((char + np.uint64(1)) * SALT >> np.uint64(64 - SLOT_BITS)).astype(np.uint8)
    return prints


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Rows of ``SLOTS`` values of ``SLOT_BITS`` bits; null and empty texts: zeros."""
    out, at = [], 0
    texts = [t or "" for t in texts]
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
            size += len(texts[end])
            end += 1
        out.append(_batch(texts[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros((0, SLOTS), np.uint8)


def as_hex(prints: np.ndarray) -> list[str]:
    """One hexadecimal digit a slot."""
    digits = np.frombuffer(b"0123456789abcdef", "S1")[prints]
    return [row.tobytes().decode() for row in digits]


def likeness_at(share: np.ndarray) -> np.ndarray:
    """0 to 1: a share of equal slots, beyond chance."""
    return np.clip((share - CHANCE) / (1 - CHANCE), 0, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: share of equal slots beyond chance."""
    return likeness_at((a == b).mean(1))


def add_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Documents with the fingerprint of a text column, as hexadecimal digits. Equal texts have equal ones; null texts that
    of an empty text, zeros. Repeated rows stay, a column of the new one's name is replaced, an empty table stays empty."""

    @F.pandas_udf("string")
    def walked(texts: pd.Series) -> pd.Series:
        return pd.Series(as_hex(fingerprints(texts.tolist())))

    return bounded_batches(docs).withColumn(to, walked(text))


def likeness_of(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns, neither null."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer("".join(s).encode(), np.uint8).reshape(len(s), SLOTS) for s in (x, y))
        return pd.Series(likeness(u, v))

    return alike(a, b)


def shared_by_strangers(prints: np.ndarray, least: float) -> np.ndarray:
    """For each width up to ``WIDEST`` (from 0) the chance that two of the texts not alike to ``least`` agree in all slots
    of a band of that width. Characters are far from equally frequent, so it falls more slowly than ``CHANCE`` would have it.

    A pair that agrees in m of all slots does so in a band of random ones with the chance C(m, width) / C(SLOTS, width).
    """
    agree = np.zeros(SLOTS + 1)
    for n in range(1, len(prints)):
        agree += np.bincount((prints[:n] == prints[n]).sum(1), minlength=SLOTS + 1)
    counts = np.arange(SLOTS + 1)
    agree[likeness_at(counts / SLOTS) >= least] = 0
    steps = np.clip(counts[:, None] - np.arange(WIDEST), 0, None) / (SLOTS - np.arange(WIDEST))
    chances = np.hstack([np.ones((SLOTS + 1, 1)), np.cumprod(steps, 1)])
    return agree @ chances / agree.sum() if agree.any() else CHANCE ** np.arange(WIDEST + 1)


def band_slots(rows: int, least: float, shared: np.ndarray | None = None) -> list[np.ndarray]:
    """The slots of each band for a table of so many different texts.

    A band is so wide that a text shares it with ``STRANGERS`` unlike ones at most (by the chances of
    ``shared_by_strangers``; without them, by those of equally frequent characters), so it widens with the logarithm of the
    table; there are so many that texts alike to ``least`` share one with the chance ``RECALL``.
    """
    strangers = max(rows, 1) * (CHANCE ** np.arange(WIDEST + 1) if shared is None else shared)
    width = int(np.clip(np.argmax(strangers <= STRANGERS) if (strangers <= STRANGERS).any() else WIDEST, BAND_SLOTS, WIDEST))
    met = (least + (1 - least) * CHANCE) ** width
    count = math.ceil(math.log(1 - RECALL) / math.log1p(-min(met, RECALL)))
    draw = np.random.default_rng(79)
    return [np.sort(draw.permutation(SLOTS)[:width]) for _ in range(count)]


def bands(fingerprint: Column, slots: list[np.ndarray]) -> Column:
    """Band keys of a fingerprint column."""
    key = lambda n, at: F.xxhash64(F.lit(n), *(F.substring(fingerprint, int(s) + 1, 1) for s in at))
    return F.array(*(key(n, at) for n, at in enumerate(slots)))


def in_one_band(a: np.ndarray, b: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """Whether rows of two sets of fingerprints are candidates."""
    same = a == b
    return np.logical_or.reduce([same[:, at].all(1) for at in slots])


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, packed, of the rows with an id."""
    return add_fingerprint(docs.where("doc_id IS NOT NULL").select("doc_id", "text")).select("doc_id", F.unhex("fingerprint").alias("print"))


def _judged(held: DataFrame, rows: int) -> np.ndarray:
    """The prints of a table without repeats, some ``JUDGED`` of them if it has more: those with the smallest hashes, of a
    part that a hash picks."""
    h = F.xxhash64("print", F.lit(80))
    part = held.where(F.pmod(h, F.lit(max(1, rows // (2 * JUDGED)))) == 0)
    packed = b"".join(bytes(r.print) for r in part.orderBy(h, "print").limit(JUDGED).select("print").collect())
    codes = np.frombuffer(packed, np.uint8).reshape(-1, SLOTS // 2)
    return np.stack([codes >> 4, codes & 15], 2).reshape(-1, SLOTS)


def _close(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Rows of ``held`` (print, not repeated, and other columns) with each ``asked`` print they are alike to, and likeness.

    Band keys travel with a hash of the print, the prints themselves only with candidates. A bounded sample of the prints
    says how wide the bands must be; all prints are banded.
    """
    rows = held.count()
    slots = band_slots(rows, least, shared_by_strangers(_judged(held, rows), least))
    told = lambda d: d.select(F.xxhash64("print").alias("id"), F.explode(bands(F.lower(F.hex("print")), slots)).alias("band"))
    pairs = materialise(told(asked).withColumnRenamed("id", "asked_id").join(told(held), "band").select("asked_id", "id").distinct(), "candidates")
    sides = pairs.join(asked.select(F.xxhash64("print").alias("asked_id"), F.col("print").alias("asked_print")), "asked_id")
    sides = sides.join(held.withColumn("id", F.xxhash64("print")), "id").drop("asked_id", "id")
    text = lambda c: F.lower(F.hex(c))
    return sides.withColumn("likeness", likeness_of(text("asked_print"), text("print"))).where(F.col("likeness") >= least)


def search(queries: DataFrame, docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """For each query row the documents alike to ``least`` or more: query_id, doc_id, likeness.

    Documents with equal fingerprints are one candidate until the end, so a hot text meets a query once. Null ids are left
    out, null texts are empty, repeated rows count each, queries find themselves; other columns are ignored and an empty
    table finds nothing.
    """
    asked, all_ = (materialise(_prints(d), "prints") for d in (queries, docs))
    close = _close(asked.select("print").distinct(), all_.select("print").distinct(), least)
    out = close.join(asked.select(F.col("doc_id").alias("query_id"), F.col("print").alias("asked_print")), "asked_print")
    return out.join(all_, "print").select("query_id", "doc_id", "likeness")


def count_alike(docs: DataFrame, least: float = LIKENESS, every: int = ASKED_EVERY) -> DataFrame:
    """fingerprint and n_alike, the rows besides itself that are alike to ``least`` or more, for each fingerprint of a row
    whose id ``every`` divides. Texts with equal fingerprints are counted, not paired. Rows as in ``search``."""
    groups = _prints(docs).groupBy("print").agg(F.count("*").alias("n"), F.max(F.col("doc_id") % every == 0).alias("asked"))
    groups = materialise(groups, "print-groups")
    close = _close(groups.where("asked").select("print"), groups.select("print", "n"), least)
    return close.groupBy("asked_print").agg((F.sum("n") - 1).alias("n_alike")).select(F.lower(F.hex("asked_print")).alias("fingerprint"), "n_alike")


# ---------------------------------------------------------------- neighbours in id order

#: Code points of a bucket of consecutive ids, on average, as long as that gives no more than so many buckets; a bucket is
#: sorted by Spark, which spills, and read in batches, so its size bounds no memory. Ids sampled a bucket.
BUCKET_CHARS, BUCKETS, SAMPLED = 8_000_000, 200_000, 64
EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_in_band boolean, next_in_band boolean"
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_in_band", pa.bool_()), ("next_in_band", pa.bool_())]
)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts_from(cuts: list[int]) -> Column:
    """How many of the cuts, in descending order, an id does not exceed. Looked up in two steps of the root of their
    number, from one folded constant."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts) - 1) + 1
    parts = F.from_json(F.lit(json.dumps([cuts[n : n + size] for n in range(0, len(cuts), size)])), "array<array<bigint>>")
    below = lambda numbers: F.size(F.filter(numbers, lambda c: c >= F.col("doc_id")))
    part = below(F.from_json(F.lit(json.dumps(cuts[::size])), "array<bigint>"))
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * size + below(F.element_at(parts, F.greatest(part, F.lit(1)))))


def _in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, bucket and guest, and the number of buckets: ids in descending order (nulls last) cut into buckets, each row in its own
    bucket, and the first row of a bucket also, as guest, at the end of the bucket before it (the very first at the end
    of the last). Only a bounded sample of ids and the buckets' borders, a few numbers each, reach the driver."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.count("doc_id"), F.sum(F.length("text"))).first()
    count = int(min(BUCKETS, max(1, (size[1] or 0) // BUCKET_CHARS)))
    every = max(1, size[0] // (SAMPLED * count))
    drawn = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("doc_id").distinct() if count > 1 else None
    ids = sorted((r.doc_id for r in drawn.collect()), reverse=True) if count > 1 else []
    cuts = sorted({ids[k * len(ids) // count] for k in range(1, count)}, reverse=True) if ids else []
    # bucket n holds ids up to cut n - 1 and above cut n; nulls are last
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_cuts_from(cuts))
    placed = docs.withColumn("bucket", bucket.cast("int"))
    tops = sorted((r.bucket, r.top) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return placed.withColumn("guest", F.lit(False)), 1
    goes_to = {tops[n][0]: tops[n - 1][0] for n in range(len(tops))}  # the first bucket's top goes to the last
    visits = spark.createDataFrame([(b, t, goes_to[b]) for b, t in tops], "at int, top long, to int")
    guests = placed.join(F.broadcast(visits), (F.col("bucket") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = guests.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).unionByName(guests), len(tops)


def next_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The next document is the one with the next smaller doc_id (rows with equal ids in order of their texts, null ids
    last; after the last comes the first). The edited text has its last floor(n/2) code points replaced by the first
    as many, or all, of the next text. Null texts are empty; a lone row is its own next. Other columns are ignored;
    an empty table gives no rows. Likeness is that of the fingerprints, 0 to 1; ``edited_in_band`` and ``next_in_band``
    say whether the banding for texts alike to a half would have found them.
    """
    placed, buckets = _in_order(bounded_batches(docs))
    slots = band_slots(1, 0.5)
    ordered = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")

    def measure(rows: list[tuple], following: list[str]):
        texts = [r[1] for r in rows]
        own = fingerprints([*texts, following[-1]])
        edited = [_edited(a, b) for a, b in zip(texts, following)]
        changed = fingerprints(edited)
        return pd.DataFrame(
            {
                "doc_id": pd.array([r[0] for r in rows], "Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": as_hex(own[:-1]),
                "edited_fingerprint": as_hex(changed),
                "near_edited": likeness(own[:-1], changed),
                "near_next": likeness(own[:-1], own[1:]),
                "edited_in_band": in_one_band(own[:-1], changed, slots),
                "next_in_band": in_one_band(own[:-1], own[1:], slots),
            }
        )

    def walk(batches):
        held: list[tuple] = []  # rows of the bucket at hand whose next text is not known yet
        size, visited = 0, None
        for batch in batches:
            columns = batch.to_pydict()
            for doc_id, text, bucket, guest in zip(columns["doc_id"], columns["text"], columns["bucket"], columns["guest"]):
                if bucket == visited:
                    continue  # equal ids share the border: the first of them is the guest
                held.append((doc_id, text))
                size += len(text)
                if guest:
                    visited = bucket
                    yield held
                    held, size = [], 0
                elif size > BATCH and len(held) > 1:
                    yield held
                    held, size = held[-1:], len(text)

    def run(batches):
        for rows in walk(batches):
            if len(rows) > 1:
                yield pa.RecordBatch.from_pandas(measure(rows[:-1], [r[1] for r in rows[1:]]), schema=ARROW, preserve_index=False)

    return ordered.select("doc_id", "text", "bucket", "guest").mapInArrow(run, EDITS)


def edits_and_alike(docs: DataFrame, least: float = LIKENESS, every: int = ASKED_EVERY) -> DataFrame:
    """``next_edits`` with ``n_alike`` of ``count_alike`` for the rows whose id ``every`` divides, null for the others."""
    # a hash stands for the fingerprint, so that the counts are small
    counts = materialise(count_alike(docs, least, every).select(F.xxhash64("fingerprint").alias("_key"), F.lit(True).alias("_asked"), "n_alike"), "alike")
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    # rows that do not ask get keys of their own, so that they do not meet in one task
    key = F.when(F.col("_asked"), F.xxhash64("fingerprint")).otherwise(F.xxhash64("doc_id", "edited_sha256"))
    edits = next_edits(docs).withColumn("_asked", asked).withColumn("_key", key)
    return edits.join(counts, ["_key", "_asked"], "left").drop("_key", "_asked")
