import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from traitloom.llm import toxicity as tox


def corpus(count, seed=2):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    bad = ["vile", "rotten", "zorkaa", "zorkbb", "zorkcc", "zorkdd"]
    rows, labels = [], []
    for d in range(count):
        toxic = draw.random() < 0.25
        text = [draw.choice(plain) for _ in range(draw.randrange(1, 60))]
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                text.insert(draw.randrange(len(text)), draw.choice(bad))
        rows.append((d, " ".join(text), int(toxic)))
        if draw.random() < 0.8:
            labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_texts_are_told_apart(spark):
    rows, labels = corpus(1500)
    extra = [(9000, None, 0), (9001, "", 0), (None, "vile and rotten", 1), (9002, "word " * 40_000 + "zorkee", 1), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(d, t, y) for d, t, y in rows + extra], "doc_id long, text string, toxic int")
    model = tox.fit(docs.drop("toxic"), spark.createDataFrame([*labels, (3, None), (None, 1), (4, 7)], "doc_id long, toxic int"))
    out = tox.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic", "_toxicity"]
    got = out.collect()
    assert all(0 <= r._toxicity <= 1 for r in got) and len(got) == len(rows) + 5
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r._toxicity >= 0.7) == (r.toxic == 1) for r in held]) > 0.98
    assert {r.doc_id: r._toxicity >= 0.7 for r in got if r.doc_id is None or r.doc_id >= 9000} == {9000: False, 9001: False, None: True, 9002: True}
    assert tox.score(docs.limit(0), model).count() == 0
    none = tox.fit(docs.drop("toxic"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r._toxicity for r in tox.score(docs, none).collect()) < 0.01


def test_held_out_is_the_crc(spark):
    got = spark.range(50).select("id", tox.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def planted_votes(rows=6000):
    draw = np.random.default_rng(7)
    truth = draw.random(rows) < 0.2
    rates = [(0.5, 0.002), (0.4, 0.01), (0.5, 0.1), (0.3, 0.001), (0.35, 0.004)]
    fired = np.column_stack([draw.random(rows) < np.where(truth, hit, miss) for hit, miss in rates])
    copies = np.column_stack([fired[:, 0] & (draw.random(rows) < 0.97) for _ in range(3)])
    annotators = draw.random(rows) < np.where(truth, 0.93, 0.02)
    return truth, np.column_stack([fired, copies, annotators]), rates


def test_label_model_estimates_accuracies_from_agreement():
    truth, fired, rates = planted_votes()
    got = tox.label_model(fired)
    for j, (hit, miss) in enumerate(rates):
        assert abs(got.on[j] - hit) < 0.06 and abs(got.off[j] - miss) < 0.02, (j, got.on[j], got.off[j])
    assert abs(got.on[-1] - 0.93) < 0.04 and abs(got.off[-1] - 0.02) < 0.015  # the annotators' mistakes are found
    assert got.together[0, 5:8].min() > 0.9 and got.together[:5, :5].max() < 0.15
    assert ((got.posterior > 0.5) == truth).mean() > (fired[:, -1] == truth).mean()
    draw = np.random.default_rng(8)
    for wrong in (np.full(len(truth), 0.5) - 0.3 * ~fired.any(1), draw.random(len(truth)) * 0.3 + 0.5 * fired.any(1)):
        again = tox.label_model(fired, wrong)
        assert np.abs(again.on - got.on).max() < 0.01 and np.abs(again.posterior - got.posterior).max() < 0.02


def test_copies_of_a_voter_count_once():
    truth, fired, _ = planted_votes()
    alone = tox.label_model(np.delete(fired, [5, 6, 7], 1))
    with_copies = tox.label_model(fired)
    assert np.abs(alone.posterior - with_copies.posterior).mean() < 0.02


def test_scores_are_those_of_brute_force(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(model.names, model.weights.astype(float)))
    for r in tox.score(docs, model).collect():
        split = r.text.lower().split()
        found = {m for w in split for m in ["=" + w] + [w[:n] + "*" for n in range(3, 8) if len(w) >= n]}
        begun = {w[:n] for w in split for n in range(3, 8) if len(w) >= n}
        found |= {b + "+" for b in begun if sum(w.startswith(b) for w in split) >= max(2, len(split) / 200)}
        logit = model.bias + sum(weight.get(m, 0.0) for m in found)
        assert abs(r._toxicity - 1 / (1 + np.exp(-logit))) < 1e-6


def test_voters_of_two_languages_that_abstain():
    """Voters never speak in texts of the other language; no label is given, and the posterior is the truth."""
    draw = np.random.default_rng(4)
    n = 4000
    truth, foreign = draw.random(n) < 0.2, draw.random(n) < 0.3
    own = [draw.random(n) < np.where(truth & ~foreign, 0.5, 0.001) for _ in range(6)]
    other = [draw.random(n) < np.where(truth & foreign, p, 0) for p in (0.95, 0.3)]
    votes = np.column_stack(own + other)
    got = tox.label_model(np.column_stack([votes, votes.any(1)]), abstain=True)
    assert ((got.posterior > 0.5) == truth)[votes.any(1)].mean() > 0.95
    assert (got.posterior[~votes.any(1)] < 0.5).all()
    assert (got.on[:-1] > 5 * got.off[:-1]).all()


def test_dense_beginnings():
    assert {m for m in tox.text_markers("abcd abce " + "x " * 300) if m[-1] == "+"} == {"abc+"}
    assert not {m for m in tox.text_markers("abcd abce " + "x " * 500) if m[-1] == "+"}
    assert not {m for m in tox.text_markers("abcd xyz") if m[-1] == "+"} and tox.text_markers(None) == set()
    known = ["abc+", "abc*", "=xyz", "abcd+"]
    for text in ("abcd abce " + "x " * 300, "abcd abcd", "abcd xyz", "", None):
        assert [known[k] for k in tox.Lookup(known)(text)] == [m for m in known if m in tox.text_markers(text)]


def test_labels_are_no_voter_on_the_tables(spark):
    """Of the tables' held-out documents at least nine in ten toxic ones are caught and one in two hundred clean ones is
    flagged at most; the model knows the labels only by the voters they chose."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = tox.fit(docs, labels)
    assert "annotators" not in {v[0] for v in model.voters} and model.voters[-1][0] == "any of these"
    held = labels.where("toxic is not null").where(tox.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("gold"))
    got = tox.score(docs.join(held, "doc_id"), model).groupBy("gold").agg(F.count("*").alias("n"), F.sum((F.col("_toxicity") >= 0.7).cast("int")).alias("hit")).collect()
    share = {r.gold: r.hit / r.n for r in got}
    print(share)
    assert share[1] >= 0.9 and share[0] <= 0.005
