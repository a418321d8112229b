import random
import zlib

import numpy as np

from traitloom.llm import langid


def corpus(count):
    draw = random.Random(6)
    parts = {"xx": ["tion", "ing", "the", "er"], "yy": ["ción", "ado", "que", "er"], "zz": ["keit", "ung", "der", "er"]}
    rows = []
    for d in range(count):
        lang = draw.choice(list(parts))
        words = ["".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(1, 80))]
        rows.append((d, " ".join(words), lang))
    return rows


def test_held_out_languages(spark):
    rows = corpus(900)
    extra = [(2000, None, "xx"), (2001, "", "yy"), (2002, "12 345 _ !? ½ ② ²", "xx"), (None, "keitung der", None), (2003, "keitung " * 30_000, None), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([(*r, "s") for r in rows + extra], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "_language"]
    got = out.collect()
    held = [r for r in got if r.lang and r.text and (r.doc_id or 0) < 2000 and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.array([r._language.lang_pred == r.lang for r in held])
    sure = np.array([r._language.score for r in held])
    assert len(held) > 100 and right.mean() > 0.97 and abs(sure.mean() - right.mean()) < 0.06
    assert all(0 <= r._language.score <= 1 for r in got)
    told = {r.doc_id: r._language.lang_pred for r in got}
    assert (told[2000], told[2001], told[2002], told[None], told[2003]) == ("und", "und", "und", "zz", "zz")
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.where("lang = 'none'"))
    assert {r._language.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_penalties_leave_weights_out():
    draw = np.random.default_rng(1)
    rows = [(np.sort(draw.choice(2000, 40, replace=False)), np.full(40, 40**-0.5)) for _ in range(300)]
    labels = np.array([int((r[0] < 1000).mean() > 0.5) for r in rows])
    weights, _ = langid.fit_weights(rows, labels, 2)
    assert (weights[2000:] == 0).all() and 0 < (weights[:2000] != 0).mean() <= 1
    assert weights[:1000, 1].mean() > weights[1000:2000, 1].mean()


def test_letters_are_those_of_unicode():
    import unicodedata

    for c in map(chr, [*range(0x3000), *range(0x1D400, 0x1D800), 0x10FFFF]):
        if not 0xD800 <= ord(c) < 0xE000:
            assert langid.has_letter("1" + c) == unicodedata.category(c).startswith("L"), hex(ord(c))


def plain_prediction(model, text):
    """The prediction by definition, gram by gram."""
    norm = "".join(c if c.isalnum() and not c.isdecimal() and not c.isdigit() or c == " " else " " for c in f" {text.lower()} ")
    norm = " ".join(norm.split(" ")) if "  " not in norm else __import__("re").sub(" +", " ", norm)
    count, mask = {}, 2**64 - 1
    for n in (1, 2, 3):
        for at in range(len(norm) - n + 1):
            key = 0
            for c in norm[at : at + n]:
                key = key * 1_000_003 + ord(c)
            bucket = ((key * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) & mask) >> 49
            count[bucket] = count.get(bucket, 0) + 1
    x = {b: (1 + np.log(c)) * model.idf[b] for b, c in count.items()}
    size = np.sqrt(sum(v * v for v in x.values()))
    logit = sum(v / size * model.weights[b].astype(float) for b, v in x.items()) + model.bias
    p = np.exp(logit / model.temperature - (logit / model.temperature).max())
    return model.languages[int(np.argmax(p))], float(p.max() / p.sum())


def test_predictions_are_those_of_brute_force(spark):
    docs = spark.createDataFrame([*corpus(300), (900, "La ciónÉ 12 x\ny", "yy")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for r in langid.identify(docs, model).collect():
        lang, score = plain_prediction(model, r.text)
        assert r._language.lang_pred == lang and abs(r._language.score - score) < 1e-4


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 400 * 600)
    names = [f"l{n:03d}" for n in range(400)]
    rows = [(k * 400 + n, " ".join([f"{chr(0x4E00 + n)}{chr(0x5E00 + n)}"] * (5 + k)), name) for k in range(4) for n, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted({lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5}) and len(model.languages) > 390
    right = [r._language.lang_pred == r.lang for r in langid.identify(docs, model).collect()]
    assert np.mean(right) > 0.9
