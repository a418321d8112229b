import random

import pytest

from traitloom.llm import decontaminate


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [20_000, 7])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
    monkeypatch.setattr(decontaminate, "CHUNK", 2000)
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(draw.randrange(5, 60)))) for i in range(40)]
    items += [(50, None), (51, " "), (52, "two words"), (53, items[3][1]), (None, items[4][1])]
    rows = []
    for d in range(80):
        words = [word() for _ in range(draw.choice([3, 50, 400, 4000]))]
        for _ in range(draw.randrange(3)):
            passage = draw.choice(items[:40])[1].split()
            if draw.random() < 0.5:
                passage[draw.randrange(len(passage))] = "changed"
            at = draw.randrange(len(words))
            words[at:at] = [w.upper() for w in passage] if draw.random() < 0.3 else passage
        rows.append((d, " \n".join(words)))
    rows += [(100, None), (101, ""), (102, "Two  words"), (103, "two words more"), (0, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in rows:
        have = shingles(t)
        for i, x in items:
            own = shingles(x)
            if own and len(own & have) >= 0.8 * len(own):
                want.append((d, i, len(own), len(own & have)))
    got = decontaminate.leaks(docs, bench)
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(want) > 40
    hit = {w[0] for w in want}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in hit), key=str)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_recall_of_scattered_items(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(draw.randrange(120, 400))]) for i in range(150)]
    rows = []
    for i, words in items:  # pieces in any order, far apart in a very long text
        cuts = sorted(draw.sample(range(10, len(words) - 10), len(words) // 40))
        pieces = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        draw.shuffle(pieces)
        rows.append((i, " ".join(" ".join([*p, *(word() for _ in range(2000))]) for p in pieces)))
    rows.append((500, " ".join(word() for _ in range(120_000)) + " " + " ".join(items[0][1])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(900, " ".join(word() for _ in range(50_000)))], "item_id long, text string")
    want = {(d, i) for (d, t), (i, w) in zip(rows, items) if len(shingles(" ".join(w)) & shingles(t)) >= 0.8 * len(shingles(" ".join(w)))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert (500, 0) in got and got - {(500, 0)} <= want and len(want) > 100
    assert len(got & want) >= 0.98 * len(want)
