import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """(text, form, n, prefix_chars, middle_chars) by the regular expression."""
    text, units = text or "", TOKEN.findall(text or "")
    digest, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, "plain", n, None, None
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m)


def odd_texts(count, seed):
    draw = random.Random(seed)
    shared = [" ".join(draw.choice(["word", "é", "日本語", "a", "\t", "\n\n", "x" * 50, "<S", "P>"]) for _ in range(draw.randrange(2000))) for _ in range(4)]
    out = ["", None, " ", "\n \t", "a", " a", "a ", "  a  b ", "é  b c", "<P> held", "a <", ">" * 9, "a" * 200_000, " " * 100_000, ("ab " * 60_000)]
    while len(out) < count:
        out.append("".join(draw.choice([draw.choice(shared), draw.choice(" \t\n\x0b\x0c\rab<>é"), draw.choice(["<S", "P>", "S>", "<"])]) for _ in range(draw.randrange(9))))
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_tokens_against_the_expression(monkeypatch, collide):
    """Small chunks and blocks, and hashes that all collide: counts and starts stay right."""
    monkeypatch.setattr(infill, "BITS", 4)
    monkeypatch.setattr(infill, "MOST", 40)
    monkeypatch.setattr(infill, "BLOCK", 64)
    summaries = infill.Summaries(2000, *([lambda chunk: len(chunk) % 3] if collide else []))
    for text in odd_texts(60, 1):
        data = (text or "")[:3000].encode()
        units = [u.encode() for u in TOKEN.findall(data.decode())]
        tokens = infill.Tokens(data, summaries)
        starts = np.cumsum([0, *map(len, units)]).tolist()
        assert tokens.n == len(units) and [tokens.start(k) for k in range(len(units) + 1)] == starts
        assert summaries.size == sum(len(c) for c, _ in summaries.held.values()) <= 2000
    assert collide or summaries.hits > 100


def test_chunks_do_not_depend_on_what_stands_before(monkeypatch):
    shared = np.random.default_rng(3).integers(32, 127, 60_000).astype(np.uint8)
    other = np.random.default_rng(4).integers(32, 127, 7_777).astype(np.uint8)
    alone, behind = infill.chunk_ends(shared), infill.chunk_ends(np.concatenate([other, shared])) - len(other)
    assert len(alone) > 15 and len(set(alone[2:].tolist()) - set(behind.tolist())) == 0
    monkeypatch.setattr(infill, "BLOCK", 1000)
    assert infill.chunk_ends(shared).tolist() == alone.tolist()


def test_documents_against_brute_force(spark):
    rows = list(enumerate(odd_texts(150, 2))) + [(7, "same id, other text"), (7, "same id, other text"), (None, "no id at all"), (2**60, "large id")]
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, form string, n int").repartition(5)
    got = infill.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "form", "n", "_infill"]
    got = got.withColumn("restored", infill.restore(F.col("_infill.text"), F.col("_infill.form"))).collect()
    told = sorted(((r.doc_id, r.text or "", *r._infill) for r in got), key=str)
    assert told == sorted(((d, t or "", *brute(d, t)) for d, t in rows), key=str)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r._infill.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
