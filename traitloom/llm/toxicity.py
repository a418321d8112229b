"""Toxicity by weak supervision.

Many weak voters, each a lexicon word, a word beginning, or a beginning that fills a share of the text, vote "toxic" where
they find it and abstain elsewhere; one voter more votes "clean" where none of them speaks. A generative label model
estimates by expectation maximisation how often each voter speaks in toxic and in clean texts, and how far voters move
together inside a class, so repeated evidence counts once. All of it follows from how the voters agree: no accuracy is
given, and the labels are no voter. An abstaining voter is no evidence, since a lexicon of one language is silent in
all others. The posterior labels train a linear classifier, which scores every text.

Voters are found in labelled rows of the learning part only (crc32 of the id modulo ``FOLDS`` is not ``HELD_OUT``).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Labelled rows the classifier is fitted on, at most, of either label; picked by the hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 2_500, 4_500
#: Voters, and features of the classifier, at most: the strongest. On the 0.1 GB check tables 27 and 1,079 are used.
VOTERS, FEATURES = 128, 1_536
#: A voter speaks in this many labelled rows at least, of which this share is toxic at least; voters are added until
#: this many speak in each toxic row. More add words that stand in toxic texts by chance.
LEAST_ROWS, LEAST_SHARE, COVER = 4, 0.9, 1
#: A beginning fills a text if it has this many words there at least, and one word in so many.
DENSE_WORDS, DENSE_IN = 2, 200
#: Log-odds ratio of a feature over its standard error, at least.
LEAST_STRENGTH = 2.5
BEGINNINGS = (3, 4, 5, 6, 7)
WORD = re.compile(r"\w+")


def held_out(doc_id: Column, folds: int = FOLDS, part: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == part, F.lit(False))


def markers(word: str) -> list[str]:
    """What a word can be known by: itself (``=word``) and its beginnings (``beg*``)."""
    return ["=" + word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def words(text: str | None) -> Counter[str]:
    """Words and how often each occurs."""
    return Counter(WORD.findall((text or "").lower()))


def _fill(counts: Counter, total: int) -> list:
    return [k for k, n in counts.items() if n >= DENSE_WORDS and n * DENSE_IN >= total]


def text_markers(text: str | None) -> set[str]:
    """Markers of a text: those of its words, and the beginnings that fill it (``beg+``)."""
    counts, found, dense = words(text), set(), Counter()
    for word, n in counts.items():
        found.update(markers(word))
        for k in BEGINNINGS:
            if len(word) >= k:
                dense[word[:k] + "+"] += n
    return found.union(_fill(dense, counts.total()))


class Lookup:
    """Numbers of the known markers in a text; words met before are remembered, up to a bound."""

    def __init__(self, names: list[str], memory: int = 200_000):
        self.numbers = {m: i for i, m in enumerate(names)}
        self.memory, self.seen = memory, {}

    def __call__(self, text: str | None) -> list[int]:
        counts, found, dense = words(text), set(), Counter()
        for word, n in counts.items():
            hit = self.seen.get(word)
            if hit is None:
                if len(self.seen) >= self.memory:
                    self.seen.clear()
                begun = [word[:k] + "+" for k in BEGINNINGS if len(word) >= k]
                hit = self.seen[word] = tuple(tuple(self.numbers[m] for m in ms if m in self.numbers) for ms in (markers(word), begun))
            found.update(hit[0])
            for k in hit[1]:
                dense[k] += n
        return sorted(found.union(_fill(dense, counts.total())))


# ---------------------------------------------------------------- label model


def choose_voters(fired: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Columns that cover the toxic rows ``COVER`` times: greedily the column that speaks in most rows that need it,
    precise ones first. Labels choose the voters; they do not say how good they are."""
    share = (fired[toxic].sum(0) + 0.0) / np.maximum(fired.sum(0), 1)
    usable = np.flatnonzero((fired.sum(0) >= LEAST_ROWS) & (share >= LEAST_SHARE))
    need = np.full(int(toxic.sum()), COVER)
    chosen: list[int] = []
    while len(chosen) < VOTERS and len(usable):
        gain = ((need[:, None] > 0) * fired[toxic][:, usable]).sum(0) * share[usable] ** 8
        best = int(np.argmax(gain))
        if gain[best] < 1:
            break
        chosen.append(int(usable[best]))
        need = need - fired[toxic][:, usable[best]]
        usable = np.delete(usable, best)
    return chosen


@dataclass
class Labels:
    """What the label model estimates: each row's posterior of "toxic", how often each voter speaks in toxic (``on``) and
    clean rows (``off``), and how far two voters move together inside a class (0 to 1)."""

    posterior: np.ndarray
    on: np.ndarray
    off: np.ndarray
    together: np.ndarray


def label_model(fired: np.ndarray, start: np.ndarray | None = None, rounds: int = 300, smooth: float = 1.0, abstain: bool = False) -> Labels:
    """Estimate from agreement alone. ``fired``: rows by voters, true where a voter says toxic; the last voter has two
    opinions, so its silence says clean from the start, while that of the others counts only once it is estimated.
    ``abstain``: silence of the others is no evidence at all, and the last voter is whether any of them speaks, which
    tells nothing more where one does.

    Begins at the majority of the votes, or at ``start`` (a belief a row). A voter never speaks more in clean rows than
    in toxic ones, and toxic rows are not the majority: that tells the two classes apart. Evidence of a voter that
    speaks is shared with the voters speaking in the same row that move with it, that of a silent one with all such.
    """
    n, m = fired.shape
    spoke = fired.astype(np.float64)
    rate = np.clip(spoke.mean(0), 1e-6, 1 - 1e-6)
    lead = spoke[:, :-1].sum(1) + np.where(fired[:, -1], 1, -1)
    sure = 4.0 if abstain else 2.0  # few voters that abstain seldom agree, so the estimate stays near its start
    q = 1 / (1 + np.exp(-sure * lead)) if start is None else start
    on = off = rate
    together = np.zeros((m, m))
    for _ in range(rounds):
        prior = np.clip(q.mean(), 2e-3, 0.5)
        off = np.clip(((1 - q) @ spoke + smooth * rate) / ((1 - q).sum() + smooth), 1e-6, 1 - 1e-6)
        on = np.maximum(off, np.clip((q @ spoke + smooth * rate) / (q.sum() + smooth), 1e-6, 1 - 1e-6))
        together = np.zeros((m, m))
        for p in (q, 1 - q):
            centred = (spoke - (p @ spoke) / max(p.sum(), 1e-9)) * np.sqrt(p)[:, None]
            cov = centred.T @ centred
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            together += cov / np.outer(scale, scale) * (p.sum() / n)
        together = np.clip(together, 0, 1)
        np.fill_diagonal(together, 0)
        together[-1] = together[:, -1] = 0  # the last voter's evidence is its own
        voice = spoke / (1 + spoke @ together)
        silence = (1 - spoke) / (1 + together.sum(1))
        if abstain:
            voice[:, -1] = 0
            silence[:, :-1] = 0
        logit = np.log(prior / (1 - prior)) + voice @ np.log(on / off) + silence @ np.log((1 - on) / (1 - off))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved = np.abs(new - q).max(initial=0)
        q = new
        if moved < 1e-6:
            break
    return Labels(q, on, off, together)


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; both labels weigh the same in sum."""
    n, m = x.shape
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    w, bias = np.zeros(m, np.float32), 0.0
    last, last_bias = w, bias
    top, spread = np.ones(m, np.float32), 1.0
    for _ in range(20):  # largest curvature, by power iteration
        top = x.T @ (weight.astype(np.float32) * (x @ (top / np.linalg.norm(top))))
        spread = float(np.linalg.norm(top))
    rate = 1 / (0.25 * (1.1 * spread + 1) + penalty)
    for k in range(steps):
        turn = k / (k + 3)
        at, at_bias = w + turn * (w - last), bias + turn * (bias - last_bias)
        slope = weight * (1 / (1 + np.exp(-np.clip(x @ at + at_bias, -30, 30))) - y)
        last, last_bias = w, bias
        w, bias = (at - rate * (x.T @ slope.astype(np.float32) + penalty * at)).astype(np.float32), at_bias - rate * float(slope.sum())
    return w, bias


def without_twins(x: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[str]]:
    """Of markers that stand in the same rows only the longest beginning stays, or a whole word if there is none."""
    groups: dict[bytes, list[int]] = {}
    for j in range(x.shape[1]):
        groups.setdefault(np.packbits(x[:, j] > 0).tobytes(), []).append(j)
    kept = sorted(max(g, key=lambda j: (names[j][-1] == "*", len(names[j]), names[j])) for g in groups.values())
    return x[:, kept], [names[j] for j in kept]


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    voters: list[tuple[str, float, float]]  # name, how often it speaks in toxic and in clean rows


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn voters and classifier from labelled rows of the learning part.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic (0/1; other values and nulls are left out; repeated rows count
    once, an id with both labels is a row of each). At most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows are used. Without a toxic or a clean row the model scores every text 0.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", "toxic").distinct()
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = [r for y, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)) for r in known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most).collect()]
    few = spark.createDataFrame(picked, "doc_id long, toxic int")
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic"), "toxicity")

    @F.pandas_udf("array<string>")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(text_markers(t)))

    counted = sample.select("toxic", F.explode(marked("text")).alias("marker")).groupBy("marker").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows"))
    sizes = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic_rows, rows = int(sizes[0] or 0), int(sizes[1])
    if not toxic_rows or toxic_rows == rows:
        return Model([], np.zeros(0, np.float32), -30.0, [])
    a, b = (F.col("toxic") + 0.5) / (toxic_rows + 1), (F.col("rows") - F.col("toxic") + 0.5) / (rows - toxic_rows + 1)
    strength = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("rows") - F.col("toxic") + 0.5))
    best = counted.where((F.col("rows") >= LEAST_ROWS) & (strength >= LEAST_STRENGTH)).orderBy(strength.desc(), "marker").limit(FEATURES)
    names = [r.marker for r in best.collect()]
    look = spark.sparkContext.broadcast(names)

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        lookup = Lookup(look.value)
        return texts.map(lookup)

    taken = sample.select("toxic", present("text").alias("found")).collect()
    x = np.zeros((len(taken), len(names)), np.float32)
    for i, r in enumerate(taken):
        x[i, r.found] = 1
    x, names = without_twins(x, names)
    toxic = np.array([r.toxic == 1 for r in taken])
    voters = choose_voters(x > 0, toxic)
    votes = x[:, voters] > 0
    told = label_model(np.column_stack([votes, votes.any(1)]), smooth=0.01, abstain=True)
    weights, bias = fit_linear(x, told.posterior)
    return Model(names, weights, bias, list(zip([*(names[v] for v in voters), "any of these"], told.on.tolist(), told.off.tolist())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with a double column ``_toxicity`` in 0 to 1; null and empty texts have the score of a text without
    any known marker. All columns are passed on (``_toxicity`` is replaced); repeated rows score alike."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    made: list = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Lookup(held.value.names))
        w, bias = held.value.weights.astype(np.float64), held.value.bias
        logit = np.array([bias + w[made[0](t)].sum() for t in texts], np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return bounded_batches(docs).withColumn("_toxicity", scored("text"))
