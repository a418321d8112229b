"""The pipeline's stages against plain Python on a small corpus, and the queries' contracts."""

import random
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from traitloom.llm import decontaminate, queries, sentencepiece
from traitloom.llm.shingles import shingle_hashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of small tables with copies, near copies, repeated lines, leaks and toxic texts."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 8)))
    line = lambda: " ".join(word() for _ in range(12))
    items = [(i, " ".join(word() for _ in range(draw.randrange(15, 40)))) for i in range(10)]
    shared = [line() for _ in range(4)]
    docs, toxic = {}, {}
    for d in range(400):
        lines = [line() for _ in range(draw.randrange(2, 12))]
        if draw.random() < 0.2:
            lines.insert(0, draw.choice(shared))
        if draw.random() < 0.1:
            lines.append(f"{word()} {draw.choice(items)[1]} {word()}")
        toxic[d] = draw.random() < 0.2
        if toxic[d]:
            lines.append(f"{word()} {draw.choice(['vilest', 'rottenly', 'scummy'])} {word()}")
        docs[d] = "\n".join(lines)
    for d in range(400, 430):  # pairs of near copies: one word of the twin changed
        words = docs[d - 400].split(" ")
        words[len(words) // 2] = "changed"
        docs[d], toxic[d] = " ".join(words), toxic[d - 400]
    docs[430], toxic[430] = docs[60], toxic[60]
    docs[431], toxic[431] = None, False
    docs[432], toxic[432] = "", False
    folder = tmp_path_factory.mktemp("tables")
    rows = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marked = [(d, 1, int(toxic[d])) for d in docs if d % 3]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, toxic, items


def stage(name, spark, docs, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxic_documents_go_and_clean_ones_stay(spark, corpus):
    folder, docs, toxic, _ = corpus
    out = stage("toxicity", spark, read(spark, folder), folder)
    assert out.columns == COLUMNS
    kept = {r.doc_id: r.text for r in out.collect()}
    assert all(docs[d] == t for d, t in kept.items())
    assert sum(d in kept for d in docs if not toxic[d]) >= 0.99 * sum(not t for t in toxic.values())
    assert sum(d in kept for d in docs if toxic[d]) <= 0.05 * sum(toxic.values())


def test_lines_go(spark, corpus):
    folder, docs, _, _ = corpus
    out = stage("line_dedup", spark, read(spark, folder), folder)
    assert out.columns == COLUMNS
    holders = {}
    for d, t in docs.items():
        for k in {x.strip().lower() for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(d)
    gone = {k: max(h) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    want = {d: "\n".join(x for x in (t or "").split("\n") if gone.get(x.strip().lower(), d) == d) for d, t in docs.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()} and gone


def test_near_copies_go(spark, corpus):
    folder, docs, _, _ = corpus
    out = stage("simhash_near_dedup", spark, read(spark, folder), folder)
    assert out.columns == COLUMNS
    kept = {r.doc_id for r in out.collect()}
    sets = {d: set(shingle_hashes(t, 5).tolist()) for d, t in docs.items()}
    share = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    copies = {d: [e for e in docs if e < d and share(d, e) >= 0.8] for d in docs}
    assert 430 not in kept and not ({431, 432} <= kept) and {431, 432} & kept
    clean = [d for d in docs if not any(share(d, e) >= 0.6 for e in docs if e != d) and docs[d]]
    assert set(clean) <= kept
    near = [d for d in docs if copies[d]]
    assert len(near) > 15 and sum(d in kept for d in near) <= 0.2 * len(near)


def test_leaks_go(spark, corpus):
    folder, docs, _, items = corpus
    out = stage("benchmark_decontamination", spark, read(spark, folder), folder)
    assert out.columns == COLUMNS
    have = {d: set(shingle_hashes(t, 5).tolist()) for d, t in docs.items()}
    own = [set(shingle_hashes(t, 5).tolist()) for _, t in items]
    leaky = {d for d in docs if any(len(o & have[d]) >= decontaminate.THRESHOLD * len(o) for o in own)}
    assert {r.doc_id for r in out.collect()} == set(docs) - leaky and len(leaky) > 20


@pytest.mark.skipif(not Path(sentencepiece.MODEL).exists(), reason="no model file here")
def test_run_is_the_stages_one_after_another(spark, corpus, tmp_path):
    folder, docs, toxic, _ = corpus
    at = read(spark, folder)
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, at, folder).write.parquet(f"{tmp_path}/{n}")
        before, at = at, spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert at.columns == COLUMNS and 0 < at.count() <= before.count()
    want = sorted((r.doc_id, r.n_tokens, r.token_ids) for r in at.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.token_ids) for r in got) == want and all(r.round_trip for r in got)
    assert 0.5 * len(docs) < len(want) < sum(not t for t in toxic.values())


CONTRACT = {
    "op1_edit_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "edited_in_band": "boolean", "next_in_band": "boolean", "n_alike": "bigint"},
    "op3_kd_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_simhash_vptree": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract_columns(spark, corpus, name):
    folder, docs, *_ = corpus
    out = queries.QUERIES[name](spark, folder)
    assert out.dtypes == list(CONTRACT[name].items())  # in this order, what the contract adds at will last
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name == "op7_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
