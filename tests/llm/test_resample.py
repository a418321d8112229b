import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traitloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, source string"


def found(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[k : k + n]) for n in range(1, width + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, share=10, least=20, width=1, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of every row."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for text in texts for f in found(text, width)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    told = []
    for doc_id, text in rows:
        words, features = found(text, width)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(f)) for f in features)
        told.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in told if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in told), key=str)


def corpus(count, seed):
    draw = random.Random(seed)
    pool = [f"w{n}" for n in range(300)] + ["Ünïcode", "日本", "It's", "a-b", "_", "x\x00y", "3.14", " "]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.choice([3, 19, 20, 21, 60, 200]))) for _ in range(count)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(count + k, texts[5]) for k in range(40)]
    rows += [(-1, None), (-2, ""), (-3, "  \n"), (-4, "w1 " * 300_000), (None, texts[6]), (None, texts[6]), (3, texts[3]), (3, texts[3])]
    return rows, [" ".join(draw.choice(pool[:60]) for _ in range(30)) for _ in range(12)] + ["", None]


@pytest.mark.parametrize("width", [1, 3])
def test_features_do_not_depend_on_blocks(monkeypatch, width):
    texts = [t for _, t in corpus(60, 4)[0] if not t or len(t) < 5000]
    monkeypatch.setattr(resample, "BLOCK", 25)
    for text in texts:
        words, expected = found(text, width)
        told = list(resample.features(text, width, 997))
        assert sum(n for n, _ in told) == len(words)
        assert sorted(b for _, at in told for b in at.tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in expected)


def frames(spark, rows, target):
    return spark.createDataFrame([(d, t, "r", "s") for d, t in rows], SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("width,share,least,steps", [(1, 10, 20, 2), (1, 100, 0, 2), (2, 37, 20, 0), (3, 50, 1, 2)])
def test_draw_against_brute_force(spark, monkeypatch, width, share, least, steps):
    monkeypatch.setattr(resample.cutoff, "__defaults__", (50, steps))  # a coarse sketch, and a bracket that must widen
    rows, target = corpus(400, 1)
    docs, wanted = frames(spark, rows, target)
    got = resample.draw(docs, wanted, share, least, width, keep=("source",))
    assert got.columns == ["doc_id", "source", "n_features", "weight", "score", "rank"]
    told = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert told == brute(rows, target, share, least, width)


def test_ties_and_copies_of_a_row(spark):
    """Equal scores go to the smaller id; of rows alike in all, exactly as many as are due are drawn."""
    rows = spark.createDataFrame([(k, 5) for k in range(1000)] + [(0, 5)] * 500 + [(None, 5)], "doc_id long, score long")
    score, doc_id = resample.cutoff(rows, 700, 1501)
    assert (score, doc_id) == (5, 199)
    assert resample.cutoff(rows, 1501, 1501) == (5, None)
    assert resample.cutoff(rows, 0, 1501) is None
    text = "word " * 30
    same = spark.createDataFrame([(4, text)] * 30 + [(9, text)], "doc_id long, text string")
    drawn = resample.draw(same, same)
    assert sorted(r["rank"] for r in drawn.where("rank IS NOT NULL").collect()) == [1, 2, 3] and drawn.where("doc_id = 9 AND rank IS NOT NULL").count() == (1 if drawn.where("doc_id = 9").first().score > drawn.where("doc_id = 4").first().score else 0)


def test_empty_tables_and_short_texts(spark):
    rows, target = corpus(20, 2)
    docs, wanted = frames(spark, rows, target)
    assert resample.draw(docs.limit(0), wanted).count() == 0
    short = resample.draw(docs.where("length(text) < 30 OR text IS NULL"), wanted.limit(0))
    assert short.where(F.col("rank").isNotNull()).count() == 0 < short.count()
    assert short.where("doc_id = -1").select("n_features", "weight").first() == (0, 0)
