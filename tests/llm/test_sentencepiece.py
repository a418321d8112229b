import random
import struct
from pathlib import Path

import pytest
import sentencepiece as library

import corpus_pipeline
from traitloom.llm import sentencepiece as sp

MODEL = Path(sp.MODEL)
ODD = [*" ab▁ \n\té́ﬁ①<s>x😀1日本\0\r\xa0", "  ", "<s>", "<0x41>", "ing", "▁▁", "hello", "der"]


def texts(count, seed=4):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randrange(14))) for _ in range(count)]


def message(number, kind, value):
    key = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    if kind == 0:
        return key + bytes([value])
    if kind == 5:
        return key + struct.pack("<f", value)
    return key + (bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])) + value


def unigram_model(squeeze):
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{n:02X}>", 0, 6) for n in range(256))]
    pieces += [(p, -s, 1) for p, s in [("▁", 2.5), ("a", 4), ("b", 4.5), ("ab", 5), ("▁a", 3.5), ("▁ab", 6), ("ing", 5.5), ("▁▁", 6.1), ("x", 5), ("é", 7), ("i", 6), ("n", 6), ("g", 6), ("he", 5), ("l", 6), ("hello", 9), *((c, 8) for c in "<s>041")]]
    body = b"".join(message(1, 2, message(1, 2, p.encode()) + message(2, 5, float(s)) + message(3, 0, k)) for p, s, k in pieces)
    trainer = message(3, 0, 1) + message(35, 0, 1)
    normal = message(1, 2, b"identity") + message(3, 0, 1) + message(4, 0, int(squeeze)) + message(5, 0, 1)
    return body + message(2, 2, trainer) + message(3, 2, normal)


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_parity(squeeze):
    data = unigram_model(squeeze)
    tokenizer, other = sp.build(sp.Model(data)), library.SentencePieceProcessor(model_proto=data)
    cases = [t for t in texts(2000) if "▁" not in t] if squeeze else texts(2000)
    assert [x.tolist() for x in sp.encode_texts(tokenizer, cases)] == other.encode(cases)


@pytest.mark.skipif(not MODEL.exists(), reason="no model file here")
def test_bpe_parity_and_decoding():
    data = MODEL.read_bytes()
    model = sp.Model(data)
    tokenizer, other, table = sp.build(model), library.SentencePieceProcessor(model_proto=data), sp.byte_table(model)
    cases = texts(3000)
    ids = [x.tolist() for x in sp.encode_texts(tokenizer, cases, chunk=50)]
    assert ids == other.encode(cases)
    decoded = [sp.decode_ids(table, i, True) for i in ids]
    assert decoded == other.decode(ids) == tokenizer.decode_batch(ids, skip_special_tokens=False)


@pytest.mark.skipif(not MODEL.exists(), reason="no model file here")
def test_a_wrong_id_is_told(monkeypatch):
    data = MODEL.read_bytes()
    model = sp.Model(data)
    ready = (sp.build(model), library.SentencePieceProcessor(model_proto=data), sp.byte_table(model), True)
    monkeypatch.setattr(sp, "encode_texts", lambda tokenizer, texts, f=sp.encode_texts: (x[::-1] for x in f(tokenizer, texts)))
    assert sp._pieces(["two words", "", "a"], ready).field("parity").to_pylist() == [False, True, True]


@pytest.mark.skipif(not MODEL.exists(), reason="no model file here")
def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Plain words", None), (3, "Plain words", None), (None, "word " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parity string")
    out = sp.tokenise(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "parity", "_pieces"]
    assert all(r._pieces.parity for r in got) and [r._pieces.decoded for r in got] == [r.text or "" for r in got]
    assert [len(r._pieces.token_ids) for r in got][:2] == [0, 0]
    assert sp.tokenise(docs.limit(0)).count() == 0


@pytest.mark.skipif(not MODEL.exists(), reason="no model file here")
def test_every_text_is_verified(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts(300))], "doc_id long, text string, lang string, source string")
    assert {r._pieces.parity for r in sp.tokenise(docs).collect()} == {True}
    assert {r.parity for r in corpus_pipeline.tokenise(spark, docs, "").collect()} == {True}


@pytest.mark.parametrize("unigram", [True, False])
@pytest.mark.parametrize("remembered", [0, 1 << 20])
def test_words_give_what_whole_texts_give(monkeypatch, unigram, remembered):
    if not unigram and not MODEL.exists():
        pytest.skip("no model file here")
    monkeypatch.setattr(sp, "REMEMBERED", remembered)
    data = unigram_model(False) if unigram else MODEL.read_bytes()
    model = sp.Model(data)
    words, other = sp.Words(model), library.SentencePieceProcessor(model_proto=data)
    cases = ["", " ", "   a", "a  ", "▁", "b" * 3000, *texts(2000)]
    for _ in range(2):
        ids = [x.tolist() for x in sp.encode_texts(words, cases, chunk=200)]
        assert ids == [x.tolist() for x in sp.encode_texts(sp.build(model), cases)] == other.encode(cases)
    assert bool(words.ids) == bool(remembered)


@pytest.mark.skipif(not MODEL.exists(), reason="no model file here")
def test_a_worker_encodes_a_word_once():
    ready, sent = sp._ready(MODEL.read_bytes(), 2), []
    words = sp.Words(sp.Model(MODEL.read_bytes()))
    words._learn = lambda new, keep=words._learn: (sent.extend(new), keep(new))
    out = sp._pieces(["one two two", "two one", "", "one three"] * 50, (words, *ready[1:]))
    assert isinstance(ready[0], sp.Words) and sorted(sent) == ["▁one", "▁three", "▁two"]
    assert set(out.field("parity").to_pylist()) == {True} and out.field("decoded").to_pylist()[:4] == ["one two two", "two one", "", "one three"]


def test_models_that_words_do_not_fit():
    model = sp.Model(unigram_model(True))
    assert not sp.Words.fit(model) and isinstance(sp._ready(unigram_model(True), 2)[0], type(sp.build(model)))
    model = sp.Model(unigram_model(False))
    assert sp.Words.fit(model)
    model.pieces.append(("own", 0.0, sp.USER_DEFINED))
    assert not sp.Words.fit(model)


def test_a_model_without_the_marker_encodes_words_one_by_one():
    model = sp.Model(unigram_model(False))
    model.pieces = [(p.replace(sp.MARK, "_"), s, kind) for p, s, kind in model.pieces]
    cases = ["a b", "ab ab  x", "hello ing"]
    assert [x.tolist() for x in sp.encode_texts(sp.Words(model), cases)] == [x.tolist() for x in sp.encode_texts(sp.build(model), cases)]
