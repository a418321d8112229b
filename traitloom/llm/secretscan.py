"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are whatever could be a secret: values given to a secret's name, of any length and alphabet, passwords in
addresses, web tokens, and long runs of key characters. The forest sees a candidate's length, how likely its character
transitions are in the corpus, how much of it dictionary words of the corpus cover, the path it comes from, and the
neighbouring words. It is trained on labelled findings: a given table, or secrets and look-alikes planted between the words
of a bounded sample of the documents. Transition and word counts cover the whole corpus.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise
from traitloom.llm.secretplants import plant

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Labelled findings of either label that the forest is trained on, at most, picked by hash; its size.
ROWS_A_LABEL, TREES, DEPTH = 8_000, 40, 10
#: Documents that findings are planted in where none are given (picked by hash), and plants in each.
PLANTED_DOCS, PLANTS = 3_000, 4
#: Hashed words; a dictionary word's bucket is in this share of the documents at least.
WORD_BUCKETS, WORD_SHARE = 1 << 16, 0.02
#: Hash buckets for neighbouring words and for paths.
NEAR_BUCKETS, PATH_BUCKETS = 32, 8

LONG = re.compile(r"[A-Za-z0-9+/_\-]{16,}+={0,2}")
WORD = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Names that secrets are given to, and how web tokens begin
NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_\- ]?key|auth|credential)s?[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}"
GIVEN = re.compile(NAME + r"""(?:"([^"\n]{4,}+)"|'([^'\n]{4,}+)'|([^\s"',;]{6,}+))|://[^\s:/@]++:([^\s/@]{3,}+)@|(eyj[\w\-]{8,}+\.[\w\-]{8,}+(?:\.[\w\-]*+)?)""", re.I)
ASSIGNED = re.compile(NAME + r"[\"']?\Z", re.I)
IN_ADDRESS = re.compile(r"://[^\s:/@]+:\Z")
FEATURES = ["length", "transition", "digits", "upper", "changes", "dictionary", "assigned", "address", "quoted", *(f"near{n}" for n in range(NEAR_BUCKETS)), *(f"path{n}" for n in range(PATH_BUCKETS))]
FINDING = "array<struct<start: int, n_chars: int, secret_sha256: string, features: array<double>>>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1].astype(np.int64) * 128 + codes[1:]


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), 127)


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of character transitions, of documents per word bucket, and of documents, over all rows."""

    def count(batches):
        pairs, words, rows = np.zeros(128 * 128, np.int64), np.zeros(WORD_BUCKETS, np.int64), 0
        memory: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                if not text:
                    continue
                pairs += np.bincount(_pairs(_codes(text)), minlength=128 * 128)
                found = set()
                for word in set(WORD.findall(text.lower())):
                    if len(word) > 2:
                        at = memory.get(word)
                        if at is None:
                            if len(memory) > 200_000:
                                memory.clear()
                            at = memory[word] = _bucket(word, WORD_BUCKETS)
                        found.add(at)
                words[list(found)] += 1
        all_ = np.concatenate([pairs, words, [rows]])
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(all_[at])], ["cell", "n"])

    out = np.zeros(128 * 128 + WORD_BUCKETS + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out[: 128 * 128], out[128 * 128 : -1], int(out[-1])


class Measurer:
    """Finds and measures the candidates of a text."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, rows: int):
        table = pairs.reshape(128, 128) + 0.5
        self.surprise = -np.log(table / table.sum(1, keepdims=True)).ravel()
        self.common = words >= max(2, WORD_SHARE * rows)

    def dictionary(self, value: str) -> float:
        """Share of the characters that dictionary words cover, longest first from the left."""
        covered = 0
        for run in RUNS.findall(value):
            run, at = run.lower(), 0
            while at < len(run):
                size = next((n for n in range(min(12, len(run) - at), 2, -1) if self.common[_bucket(run[at : at + n], WORD_BUCKETS)]), 0)
                covered, at = covered + size, at + (size or 1)
        return covered / len(value)

    def features(self, text: str, start: int, end: int, path: str) -> list[float]:
        value = text[start:end]
        codes = _codes(value)
        kinds = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s") for c in value]
        before, after = text[max(0, start - 60) : start], text[end : end + 40]
        out = [
            float(len(value)),
            float(self.surprise[_pairs(codes)].mean()) if len(codes) > 1 else 0.0,
            kinds.count("d") / len(kinds),
            kinds.count("u") / len(kinds),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / len(kinds),
            self.dictionary(value),
            float(bool(ASSIGNED.search(before))),
            float(bool(IN_ADDRESS.search(before))),
            float(before[-1:] in "\"'" and before != "" and after[:1] == before[-1:]),
        ]
        near, where = [0.0] * NEAR_BUCKETS, [0.0] * PATH_BUCKETS
        for word in [*WORD.findall(before.lower())[-2:], *WORD.findall(after.lower())[:1]]:
            near[_bucket(word, NEAR_BUCKETS)] += 1
        where[_bucket(path, PATH_BUCKETS)] = 1.0
        return out + near + where

    def __call__(self, text: str | None, path: str | None) -> list[dict]:
        return [
            {"start": a, "n_chars": b - a, "secret_sha256": hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest(), "features": self.features(text, a, b, path or "")}
            for a, b in candidates(text or "")
        ]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what could be a secret, in order; a run inside a value given to a name is not told apart."""
    spans = [m.span(m.lastindex) for m in GIVEN.finditer(text)]
    out, n = [], 0
    for m in LONG.finditer(text):
        a, b = m.span()
        while n < len(spans) and spans[n][1] <= a:
            n += 1
        if not (n < len(spans) and spans[n][0] < b):
            out.append((a, b))
    return sorted(spans + out)


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """All candidates of all documents: doc_id, start, n_chars, secret_sha256, features. Null and empty texts have none,
    a null path is the path "", repeated rows give their candidates each; an empty table gives no rows."""
    return _measured(docs, docs.sparkSession.sparkContext.broadcast(corpus_counts(docs)), path)


def _measured(docs: DataFrame, held, path: str) -> DataFrame:
    made: list = []

    @F.pandas_udf(FINDING)
    def measured(texts: pd.Series, paths: pd.Series) -> pd.Series:
        if not made:
            made.append(Measurer(*held.value))
        return pd.Series([made[0](t, p) for t, p in zip(texts, paths)], dtype=object)

    return docs.select("doc_id", F.explode(measured("text", F.col(path).cast("string"))).alias("f")).select("doc_id", "f.*")


def planted(docs: DataFrame, held, path: str = "source") -> DataFrame:
    """Labelled findings (label, features, secret_sha256) planted in ``PLANTED_DOCS`` documents, picked by hash; plants
    that ``candidates`` does not find are left out. Null texts count as empty."""
    made: list = []

    @F.pandas_udf("array<struct<label: int, features: array<double>, secret_sha256: string>>")
    def plants(texts: pd.Series, paths: pd.Series, seeds: pd.Series) -> pd.Series:
        if not made:
            made.append(Measurer(*held.value))
        out = []
        for text, where, seed in zip(texts, paths, seeds):
            found = []
            for snippet, a, b, label in plant(text, int(seed), PLANTS):
                if (a, b) in candidates(snippet):
                    value = hashlib.sha256(snippet[a:b].encode("utf-8", "replace")).hexdigest()
                    found.append({"label": label, "features": made[0].features(snippet, a, b, where or ""), "secret_sha256": value})
            out.append(found)
        return pd.Series(out, dtype=object)

    seed = F.xxhash64(F.lit("plants"), "doc_id", "text")
    picked = docs.select("doc_id", "text", F.col(path).cast("string").alias("path"), seed.alias("seed"))
    few = picked.select("seed").orderBy("seed").limit(PLANTED_DOCS).agg(F.max("seed")).first()[0]
    some = picked.where(F.col("seed") <= F.lit(few)).dropDuplicates(["seed"])
    return some.select(F.explode(plants(F.coalesce("text", F.lit("")), "path", "seed")).alias("p")).select("p.*")


def train(labelled: DataFrame):
    """A forest on at most ``ROWS_A_LABEL`` findings of either label (columns label, features, secret_sha256), picked by
    hash, ties by the features; None if a label is missing."""
    order = F.xxhash64("secret_sha256", "features")
    parts = [labelled.where(F.col("label") == y).select(F.col("label").cast("double").alias("label"), "features", order.alias("_o")).orderBy("_o", "features").limit(ROWS_A_LABEL) for y in (0, 1)]
    sample = materialise(parts[0].unionAll(parts[1]).select("label", "features"), "secret-labels").coalesce(1)
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, subsamplingRate=0.8, featureSubsetStrategy="onethird")
    return forest.fit(sample.select("label", array_to_vector("features").alias("features")))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Every candidate with its score and decision.

    Returns doc_id, start (code points from 0), n_chars, secret_sha256 (never the secret), held_out, score (0 to 1),
    is_secret. ``labelled`` gives labelled findings (doc_id, start, label); without it, findings are planted. Only
    documents outside the held-out fold train the forest. If a label is missing altogether, nothing is removed: every
    score is 1. Null and empty texts have no candidates; null paths are one path; repeated rows give their candidates
    each; other columns are ignored; an empty table gives no rows.
    """
    docs = bounded_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(corpus_counts(docs))
    found = materialise(_measured(docs, held, path).withColumn("held_out", held_out(F.col("doc_id"))), "findings")
    if labelled is not None:
        known = labelled.select("doc_id", "start", "label").where("label IN (0, 1)").dropDuplicates(["doc_id", "start"])
        forest = train(found.where("NOT held_out").join(known, ["doc_id", "start"]))
    else:
        forest = train(planted(docs.where(~held_out(F.col("doc_id"))), held, path))
    if forest is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        vectors = forest.transform(found.withColumn("features", array_to_vector("features")))
        scored = vectors.withColumn("score", vector_to_array("probability")[1])
    keep = F.col("score") >= THRESHOLD
    return scored.select("doc_id", "start", "n_chars", "secret_sha256", "held_out", "score", keep.alias("is_secret"))
