"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all learning documents. Weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample, and a temperature is fitted on a part of it that the weights never saw.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches

FOLDS, HELD_OUT, UNKNOWN = 5, 0, "und"
#: Hashed n-grams of one to three characters.
BUCKETS, LONGEST = 1 << 15, 3
#: Sampled documents of a language (about this many, picked by the hash of id and text), at most, and bytes of all the
#: sampled documents' n-grams, which the languages share evenly; each keeps one document at least.
ROWS_A_LANGUAGE, SAMPLE_BYTES = 700, 48 << 20
#: Follow-the-regularised-leader: learning rate, its offset, penalties, passes; and the share kept for the temperature.
RATE, OFFSET, L1, L2, PASSES, KEPT = 1.0, 1.0, 1e-3, 1e-4, 4, 5
PLAIN_LETTER = re.compile("[A-Za-z]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column, folds: int = FOLDS, part: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == part, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode category L occurs."""
    return bool(PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; runs of anything but letters are one blank."""
    codes = np.frombuffer(NOT_LETTERS.sub(" ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), np.uint32)
    keys, last = [], np.zeros(0, np.uint64)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        here = codes[n - 1 :].astype(np.uint64)
        last = here if n == 1 else last[:-1] * np.uint64(1_000_003) + here
        keys.append((last * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(49))
    count = np.bincount(np.concatenate(keys).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(count)
    return found, count[found]


def weigh(found: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times inverse document frequency, at length one."""
    x = (1 + np.log(count)) * idf[found]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found, count = grams(text)
        logit = (weigh(found, count, self.idf) @ self.weights[found] + self.bias) / self.temperature
        p = np.exp(logit - logit.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal follow-the-regularised-leader, one coordinate state a bucket and class; the bias is not penalised."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(5)
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0

    def weights(at):
        out = -(z[at] - np.sign(z[at]) * l1[at, None]) / ((OFFSET + np.sqrt(n[at])) / RATE + L2)
        return np.where(np.abs(z[at]) <= l1[at, None], 0, out)

    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE * w
            n[at] += g * g
    all_ = weights(np.arange(BUCKETS + 1))
    return all_[:-1].astype(np.float32), all_[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a grid. Labels are smoothed by one row's share, so that a fit without a
    mistake is not taken for certainty."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
    target = np.full(logits.shape, 1 / (len(labels) + 1) / logits.shape[1])
    target[np.arange(len(labels)), labels] += 1 - 1 / (len(labels) + 1)

    def loss(t):
        a = (logits - logits.max(1, keepdims=True)) / t
        return np.mean(np.log(np.exp(a).sum(1)) - (target * a).sum(1))

    return float(min(grid, key=loss))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and the number of rows; each task sends one number a bucket."""

    def count(batches):
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[grams(text or "")[0]] += 1
                rows += 1
        bucket = np.append(np.flatnonzero(seen), BUCKETS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.append(seen[seen > 0], rows))], ["bucket", "rows"])

    told = bounded_batches(docs).select("text").mapInArrow(count, "bucket int, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in told:
        out[r.bucket] = r.rows
    return out[:-1], int(out[-1])


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of the rows of the learning part whose lang is not null.

    Every language is learned, the empty string and ``UNKNOWN`` included if rows are marked so. Of each about
    ``ROWS_A_LANGUAGE`` rows are fitted on (all if it has fewer), fewer if their n-grams take more than its share of
    ``SAMPLE_BYTES``; document frequencies cover every learning row. Null texts count as empty, a null doc_id is in the
    learning part, repeated rows count each. Without a learning row every text is ``UNKNOWN``. The weights take 128 kB a
    language, in the fit on the driver eight times as much.
    """
    spark = docs.sparkSession
    learn = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r.lang: r["rows"] for r in learn.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    if not counts:
        return Model([], np.zeros(0), np.zeros(0), np.zeros(0), 1.0)
    languages = sorted(counts)
    df, total = document_frequencies(learn)
    idf = np.log((1 + total) / (1 + df)) + 1
    shares = spark.createDataFrame([(x, min(1.0, ROWS_A_LANGUAGE / counts[x])) for x in languages], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_003)) / 1_000_003

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        def pack(text):
            found, count = grams(text or "")
            return found.astype(np.uint16).tobytes() + count.astype(np.uint32).tobytes()

        return texts.map(pack)

    picked = learn.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", draw.alias("draw"), packed("text").alias("packed"))
    first = Window.partitionBy("lang").orderBy("draw", "packed")
    used = F.sum(F.octet_length("packed")).over(first.rowsBetween(Window.unboundedPreceding, 0))
    fitting = picked.select("*", used.alias("used"), F.row_number().over(first).alias("nth")).where((F.col("used") <= SAMPLE_BYTES // len(languages)) | (F.col("nth") == 1))
    rows, labels = [], []
    number = {x: n for n, x in enumerate(languages)}
    for r in fitting.orderBy("draw", "lang", "packed").select("lang", "packed").collect():
        size = len(r.packed) // 6
        found = np.frombuffer(r.packed, np.uint16, size).astype(np.int64)
        rows.append((found, weigh(found, np.frombuffer(r.packed, np.uint32, size, 2 * size), idf)))
        labels.append(number[r.lang])
    labels = np.array(labels, np.int64)
    check = np.arange(len(rows)) % KEPT == 0
    if check.all():
        check[:] = False
    weights, bias = fit_weights([rows[i] for i in np.flatnonzero(~check)], labels[~check], len(languages))
    logits = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in np.flatnonzero(check)]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, labels[check]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with a struct column ``_language``: lang_pred and score (the calibrated probability, 0 to 1).

    Null texts and texts without a letter are ``UNKNOWN`` with score 0. Whole texts are read; all columns are passed on
    (``_language`` is replaced); repeated rows are told alike; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return bounded_batches(docs).withColumn("_language", told("text"))
