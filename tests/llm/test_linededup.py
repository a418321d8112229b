import random
from collections import defaultdict

import numpy as np
import pytest

from traitloom.llm import linededup
from traitloom.llm.mphf import PerfectHash


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    assert sorted(PerfectHash.build(keys).index(keys)) == list(range(len(keys)))
    assert list(PerfectHash.build(keys[:0]).index(keys[:3])) == [-1, -1, -1]


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(d)
    gone = {k: max(i for i in h if i is not None) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3 and any(i is not None for i in h)}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_lines_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    draw = random.Random(3)
    pool = [f"  Shared LINE number {n} é with ample length\t" for n in range(30)] + ["short one", "", " \x0b ", "X" * 19, "ü" * 20]
    rows = [(d, "\n".join(draw.choice([draw.choice(pool), draw.choice(pool).strip().upper(), f"own line of document {d} {draw.random()}"]) for _ in range(draw.randrange(1, 9)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (5, rows[5][1]), (None, rows[6][1]), (103, ("y" * 40 + "\n") * 3000)]
    docs = spark.createDataFrame([(d, t, 1, "h") for d, t in rows], "doc_id long, text string, count long, hash string")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "count", "hash", "_deduped"]
    assert sorted(((r.doc_id, r._deduped.text, r._deduped.n_lines, r._deduped.n_dropped) for r in got.collect()), key=str) == brute(rows)
    assert sum(x[3] for x in brute(rows)) > 20
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
