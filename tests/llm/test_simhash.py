import random
import re

import numpy as np
import pytest
import xxhash

from traitloom.llm import simhash
from traitloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "É Ü a b C\x0bd e f G h", "x " * 5000])
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text) == [plain_fingerprint(text)] == simhash.fingerprint(text, 4, 3)[:1]


def test_near_pairs_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # so that the other quarters split too
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps[100:] = (fps[100:] & ~np.uint64(0xFFFF)) | (fps[:300] & np.uint64(3))  # few values in one quarter
    for k in range(200, 400):
        fps[k] = fps[k - 200] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 6), replace=False).astype(np.uint64), initial=np.uint64(0))
    for quarter in range(4):
        got = {(int(i), int(j)) for a, b in simhash.near_pairs(fps, fps[::2], quarter, 4, 1) for i, j in zip(a, b)}
        x = np.bitwise_count(fps[:, None] ^ fps[None, ::2])
        near = (x <= 4) & (np.bitwise_count((fps[:, None] ^ fps[None, ::2]) >> np.uint64(16 * quarter) & np.uint64(0xFFFF)) <= 1)
        assert got >= {(int(i), int(j)) for i, j in zip(*np.nonzero(near))} and all(x[i, j] <= 4 for i, j in got)


@pytest.mark.parametrize("radius", [4, 8])
def test_links_find_every_class(spark, radius, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(simhash, "SHARD_MEMBERS", 200)
    monkeypatch.setattr(simhash, "TASK_QUERIES", 300)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rows = [(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(rows, "node long, fp long"), radius)).collect()}
    labels = list(range(len(fps)))
    changed = True
    close = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    while changed:
        changed = False
        for i, c in enumerate(close):
            low = min(labels[j] for j in c)
            for j in c:
                if labels[j] != low:
                    labels[j], changed = low, True
    assert [got.get(i, i) for i in range(len(fps))] == labels
    assert len(set(labels)) < len(fps)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", None), (4, "same text here now", "x"), (4, "same text here now", "x"), (9, "same TEXT here now", "x"), (None, "same text here now", "x"), (7, "long " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_classes(docs).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (7, 7), (9, 4)]
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 4, 4, 7] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.near_classes(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100}


def test_near_copies_of_documents(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(25)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base[:15]):  # one word in a hundred changed
        w = list(w)
        for at in range(50, 300, 100):
            w[at] = word()
        rows.append((100 + k, " ".join(w)))
    for k, w in enumerate(base[15:]):  # half of it shared
        rows.append((200 + k, " ".join(w[:150] + [word() for _ in range(150)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    near = {k for k in range(100, 115)}
    assert kept >= set(range(25)) | set(range(200, 210))
    assert len(near - kept) >= 14  # their similarity is 0.9


def varied(word, base, at):
    w = list(base)
    for k in at:
        w[k] = word()
    return " ".join(w)


def test_near_copies_are_confirmed_on_shingles(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(254)]  # 250 shingles; n changed words far apart change 5 n of them
        rows += [(k, " ".join(base)), (100 + k, varied(word, base, range(20, 250, 48))), (200 + k, varied(word, base, range(10, 250, 34)))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near, far = set(range(100, 160)), set(range(200, 260))
    assert len(near - kept) >= 58  # similarity 225 / 275 = 0.82
    assert far | set(range(60)) <= kept  # similarity 210 / 290 = 0.72, with the other variant less


def jaccard(a, b, width=5):
    x, y = ({tuple(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_and_precision_around_the_bound(spark):
    draw = random.Random(18)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows, near = [], []
    for k in range(300):
        size = draw.randrange(60, 500)
        base = [word() for _ in range(size)]
        changes = max(1, round((size - 4) / 5 * draw.uniform(0.06, 0.16)))
        other = varied(word, base, draw.sample(range(5, size - 5), changes))
        rows += [(k, " ".join(base)), (1000 + k, other)]
        near.append(jaccard(rows[-1][1], rows[-2][1]) >= 0.8)
    gone = {k for k in range(300)} - {r.doc_id - 1000 for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id >= 1000}
    assert 60 < sum(near) < 240
    assert all(near[k] for k in gone)  # precision 1
    assert len(gone) >= 0.95 * sum(near)


def test_large_class_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 20)
    rng = np.random.default_rng(3)
    base, rows = np.arange(100), []
    for node in range(200):  # similarities around 0.8
        some = rng.choice(100, rng.integers(86, 97), replace=False)
        rows.append((node, node % 2, np.unique(np.concatenate([base[some], 1000 + 50 * node + np.arange(rng.integers(0, 9))])).tolist()))
    sets = spark.createDataFrame([(n, c, 100, s) for n, c, s in rows], "node long, class long, n long, s array<long>")
    got = {r.node: r.root for r in components(simhash.confirmed_links(sets, 0.88)).collect()}
    pairs = [(a, b) for a, ca, sa in rows for b, cb, sb in rows if a < b and ca == cb and len({*sa} & {*sb}) / len({*sa} | {*sb}) >= 0.88]
    want = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want and 10 < len(want) < 190
